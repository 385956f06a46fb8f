"""Exact top-k by inner product in three phases with a uniform threshold.

Vectors become integers and lie in blocks of bounded size; their components
are cut into m lists of columns. A pair of a query block and a row block is one
unit of work; both sides of the grid of pairs are repeated, rows for each query
block and queries for each row block, so with blocks of 4096 a vector moves once
for 4096 of the other side.

1. Each list gives, per query, its k rows of highest partial score and its
   highest partial score; whole scores are worked out for these rows only. The
   k-th highest of them is a score that k rows reach: a safe cutoff.
2. The cutoff goes back to the pairs. A query whose highest partial scores in a
   pair do not add up to it is settled there, and pairs without an open query are
   left out. A row that reaches the cutoff has a partial score of a m-th of it or
   more in some list, so each list gives the entries from there on, and nothing
   else can be among the best.
3. What is still open, the whole scores of these entries, is worked out
   exactly, and the best k of what reaches the cutoff remain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surtido.llm.common import map_rows, settled, struct_of
from surtido.session import materialize


def _blocks(vectors: DataFrame, rows_each: int, count: int) -> DataFrame:
    """``count`` blocks of about ``rows_each`` vectors: ids, and integer rows of the narrowest width that holds them.

    A block that the hash made large comes in several pieces.
    """
    numbered = vectors.withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(count)).cast("int"))
    spread = numbered.repartition(count, "block").select("block", "vec_id", "embedding")
    schema = struct_of(block="int", piece="int", n="int", dims="int", width="int", ids="binary", rows="binary")

    def rows(taken: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[int, tuple[list, list]] = {}
        pieces: dict[int, int] = {}
        for block, vec_id, vector in taken:
            ids, values = held.setdefault(block, ([], []))
            ids.append(vec_id)
            values.append(np.floor(64 * np.asarray(vector, dtype=np.float64)))
            if len(ids) >= 2 * rows_each:
                yield _packed(block, pieces.get(block, 0), *held.pop(block))
                pieces[block] = pieces.get(block, 0) + 1
        for block, group in held.items():
            yield _packed(block, pieces.get(block, 0), *group)

    return map_rows(spread, rows, schema)


def _packed(block: int, piece: int, ids: list, values: list) -> tuple:
    dims = max(map(len, values))
    # Shorter vectors count as filled up with zeros.
    matrix = np.zeros((len(ids), dims))
    for i, v in enumerate(values):
        matrix[i, : len(v)] = v
    matrix = matrix.astype("<i8")
    low, high = int(matrix.min(initial=0)), int(matrix.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return block, piece, len(ids), dims, width, np.asarray(ids, "<i8").tobytes(), matrix.astype(f"<i{width}").tobytes()


def _matrix(n: int, dims: int, width: int, stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, f"<i{width}").reshape(n, dims)


def _exact(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in one number kind in which all their inner products are exact, with as many columns."""
    dims = max(q.shape[1], r.shape[1])
    q, r = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (q, r))
    # Python's numbers: the narrowest kinds do not hold the size of their lowest value.
    top = [max(-int(x.min(initial=0)), int(x.max(initial=0))) for x in (q, r)]
    bound = dims * top[0] * top[1]
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
    return q.astype(kind), r.astype(kind)


def _lists(q: np.ndarray, r: np.ndarray, m: int) -> list[np.ndarray]:
    return [q[:, part] @ r[:, part].T for part in np.array_split(np.arange(q.shape[1]), m)]


def _highest(scores: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k highest of each row, in any order."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:]


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, lists: int = 2, rows_each: int = 4096,
          queries_each: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best rows for every query: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows with another id. Components count as floor(64 * x). Ties go to the
    smaller id. Rows without an id, and vectors that are null, empty or hold a
    null or non-finite component, take no part. Repeated rows are candidates
    each; a repeated query is answered once. Fewer candidates than k give fewer
    rows, an empty table none; other columns are not read.
    """
    return settled(vectors.sparkSession, "top_k", lambda: _top_k(vectors, k, every, lists, rows_each, queries_each, id_col, vector_col))


def _top_k(vectors: DataFrame, k: int, every: int, lists: int, rows_each: int, queries_each: int, id_col: str,
           vector_col: str) -> DataFrame:
    e = F.col(vector_col).cast("array<double>")
    valid = materialize(
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), e.alias("embedding"))
        .filter("vec_id is not null and size(embedding) > 0")
        .filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
        .withColumn("row_id", F.monotonically_increasing_id()),
        "vectors")
    asked = valid.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    n_rows, n_queries = (max(1, math.ceil(x.count() / each)) for x, each in ((valid, rows_each), (asked, queries_each)))
    stored = materialize(_blocks(valid, rows_each, n_rows), "row_blocks")
    queries = materialize(
        _blocks(asked, queries_each, n_queries)
        .toDF("query_block", "query_piece", "q_n", "q_dims", "q_width", "q_ids", "q_rows"), "query_blocks")
    # Each row block meets each query block: the stated queries against all rows, block by block.
    cell, unit = ["query_block", "block"], ["query_block", "query_piece", "block", "piece"]
    tasks = min(n_rows * n_queries, max(4 * vectors.sparkSession.sparkContext.defaultParallelism, n_rows * n_queries // 16))
    grid = (
        stored.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))).repartition(tasks, *cell)
        .join(queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))).repartition(tasks, *cell), cell)
    )
    columns = [*unit, "n", "dims", "width", "ids", "rows", "q_n", "q_dims", "q_width", "q_ids", "q_rows"]
    gathered = materialize(
        map_rows(grid.select(*columns), _gather(k, lists),
                 struct_of(query_block="int", query_piece="int", block="int", piece="int", place="int", bound="long",
                           scores="array<long>")),
        "gathered")
    # Of what the blocks gave, the k-th highest of each query counts.
    query = ["query_block", "query_piece", "place"]
    best_first = Window.partitionBy(*query).orderBy(F.desc("score"))
    cutoffs = (
        gathered.select(*query, F.explode("scores").alias("score"))
        .withColumn("nth", F.row_number().over(best_first)).filter(F.col("nth") <= k)
        .groupBy(*query).agg(F.min("score").alias("low"), F.count("*").alias("found"))
        # With fewer than k candidates in all, every one of them is wanted.
        .select(*query, F.when(F.col("found") >= k, F.col("low")).otherwise(F.lit(_NONE)).alias("cut"))
    )
    open_ = open_queries(gathered, cutoffs).groupBy(*unit).agg(F.sort_array(F.collect_list(F.struct("place", "cut"))).alias("open"))
    found = map_rows(
        grid.join(open_, unit).select(*columns, F.col("open.place").alias("places"), F.col("open.cut").alias("cuts")),
        _resolve(k, lists), struct_of(query_id="long", vec_id="long", score="long"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        found.withColumn("rank", rank).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def open_queries(gathered: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Queries (``place`` in its block) and pairs of blocks that may still hold one of the best; at most a query block for each pair."""
    return gathered.drop("scores").join(cutoffs, ["query_block", "query_piece", "place"]).filter(F.col("bound") >= F.col("cut"))


_NONE = -(1 << 62)
_MOST = (1 << 63) - 1
#: Queries whose scores a task holds at once.
_AT_ONCE = 512


def _gather(k: int, lists: int):
    """Phase 1 for pairs of blocks: per query a bound on its scores there and the whole scores of its best partial ones."""

    def rows(taken: Iterator[tuple]) -> Iterator[tuple]:
        for *unit, n, dims, width, ids, stored, q_n, q_dims, q_width, q_ids, q_stored in taken:
            queries, r = _exact(_matrix(q_n, q_dims, q_width, q_stored), _matrix(n, dims, width, stored))
            query_ids, row_ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
            for start in range(0, q_n, _AT_ONCE):
                q = queries[start : start + _AT_ONCE]
                own = query_ids[start : start + _AT_ONCE, None] == row_ids[None, :]
                at, bound = [], 0
                for part in _lists(q, r, lists):
                    part[own] = part.min(initial=0) - 1  # own rows go to the end of every list
                    chosen = _highest(part, k)
                    at.append(chosen)
                    bound = bound + np.take_along_axis(part, chosen, axis=1).max(axis=1)
                at = np.concatenate(at, axis=1)
                for i in range(len(q)):
                    mine = np.unique(at[i])
                    mine = mine[~own[i, mine]]
                    if len(mine):
                        scores = np.sort((r[mine] @ q[i]).astype(np.int64))[::-1][:k]
                        yield *unit, start + i, min(int(bound[i]), _MOST), scores.tolist()

    return rows


def _resolve(k: int, lists: int):
    """Phases 2 and 3 for pairs of blocks with their open queries and cutoffs."""

    def rows(taken: Iterator[tuple]) -> Iterator[tuple]:
        for *_, n, dims, width, ids, stored, q_n, q_dims, q_width, q_ids, q_stored, places, cuts in taken:
            queries, r = _exact(_matrix(q_n, q_dims, q_width, q_stored), _matrix(n, dims, width, stored))
            row_ids = np.frombuffer(ids, "<i8")
            for start in range(0, len(places), _AT_ONCE):
                chosen = np.array(places[start : start + _AT_ONCE])
                q, query_ids = queries[chosen], np.frombuffer(q_ids, "<i8")[chosen]
                cut = np.array(cuts[start : start + _AT_ONCE])
                least = (-(-cut // lists)).astype(q.dtype)  # a whole number, as the partial scores are
                enough = np.zeros((len(q), n), dtype=bool)
                for part in _lists(q, r, lists):
                    enough |= part >= least[:, None]
                at_q, at_r = np.nonzero(enough & (query_ids[:, None] != row_ids[None, :]))
                for first in range(0, len(at_q), 1 << 16):
                    i, j = at_q[first : first + (1 << 16)], at_r[first : first + (1 << 16)]
                    score = (q[i] * r[j]).sum(axis=1).astype(np.int64)
                    good = score >= cut[i]
                    i, j, score = i[good], j[good], score[good]
                    order = np.lexsort((row_ids[j], -score, i))
                    i, j, score = i[order], j[order], score[order]
                    place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
                    for x in np.flatnonzero(place < k):
                        yield int(query_ids[i[x]]), int(row_ids[j[x]]), int(score[x])

    return rows


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
