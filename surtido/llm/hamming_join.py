"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

A document's set of word shingles gives a signature of symbols of 16 bits each.
The chance of a differing symbol is about one minus the similarity, so linked
documents differ in few symbols. Cut into chunks, two signatures with fewer
differing symbols than twice the number of chunks agree in some chunk but for
one symbol at most (pigeonhole), so each chunk is indexed with each of its
symbols left out in turn: no pair within that distance is lost. Links are
confirmed on full sets.

Groups are joined without writing out their pairs: first every bucket is
compared with one member and the links found make components; then only pairs
of different components are looked at, as far as signature distance and bounds
on the intersection leave a link possible. The bounds follow from the sizes, from
what each has in common with that one member, and from shingles nobody else has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from surtido.llm.common import kept_by_worker, release_shuffles, settled, struct_of
from surtido.llm.decontamination import ShingleFilter
from surtido.session import materialize

@dataclass(frozen=True)
class Index:
    """How signatures are cut: ``chunks`` chunks of ``width`` symbols."""

    chunks: int
    width: int

    @property
    def symbols(self) -> int:
        return self.chunks * self.width

    @property
    def most_apart(self) -> int:
        return 2 * self.chunks - 1


def index_for(percent: int) -> Index:
    """The smallest index that reaches 5.3 deviations beyond the mean distance of pairs at the threshold."""
    differ = 1 - percent / 100
    for width in ((6,) if percent >= 85 else (5,) if percent >= 75 else (4, 3, 2)):
        for chunks in range(2, 128 // width + 1):
            n = chunks * width
            if 2 * chunks - 1 >= n * differ + 5.3 * (n * differ * (1 - differ)) ** 0.5:
                return Index(chunks, width)
    raise ValueError(f"no index for {percent} percent")


_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Sets of hashed word shingles and their signatures, a block of texts at a time."""

    def __init__(self, words: int, symbols: int, longest: int):
        rng = np.random.default_rng(20)
        self.words = words
        self.byte = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.byte[65:91] = self.byte[97:123]                  # A-Z count as a-z
        self.space = np.zeros(256, dtype=bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.place = rng.integers(1, 2**63, words, dtype=np.uint64) * _U(2) + _U(1)
        self.flip = rng.integers(0, 2**63, symbols, dtype=np.uint64)
        self.turn = rng.integers(1, 2**63, symbols, dtype=np.uint64) * _U(2) + _U(1)
        self.power, self.back = self._powers(longest)

    @staticmethod
    def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
        base = 0x9E3779B97F4A7C15
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            powers = np.full(n + 1, b, dtype=np.uint64)
            powers[0] = 1
            out.append(np.multiply.accumulate(powers))
        return out[0], out[1]

    def shingles(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The sorted distinct shingles of each text."""
        inside = ~self.space[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[:-1][np.diff(offsets) > 0]
        begins[edges] = inside[edges]
        last = offsets[1:][np.diff(offsets) > 0] - 1
        ends[last] = inside[last]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if len(data) >= len(self.power):
            self.power, self.back = self._powers(len(data))
        upto = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.byte[data] * self.power[: len(data)], out=upto[1:])
        word = _mix((upto[ends] - upto[begins]) * self.back[begins] + (ends - begins).astype(np.uint64))
        first = np.searchsorted(begins, offsets)
        whole = np.zeros(max(0, len(word) - self.words + 1), dtype=np.uint64)
        for j in range(self.words):
            whole += word[j : j + len(whole)] * self.place[j]
        whole = _mix(whole)
        for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
            if e - s >= self.words:
                yield np.unique(whole[s : e - self.words + 1])
            elif e > s:
                short = (word[s:e] * self.place[: e - s]).sum(keepdims=True) + _U(e - s)
                yield _mix(_mix(short))
            else:
                yield np.empty(0, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> bytes:
        least = np.full(len(self.flip), np.iinfo(np.uint64).max, dtype=np.uint64)
        for start in range(0, len(shingles), 1024):
            part = (shingles[start : start + 1024, None] ^ self.flip) * self.turn
            np.minimum(least, part.min(axis=0), out=least)
        return (_mix(least) >> _U(48)).astype("<u2").tobytes()


def _texts(batches: Iterator[pa.RecordBatch], column: int, most: int = 2 << 20) -> Iterator[tuple]:
    """(batch part, bytes, offsets) over parts of about ``most`` bytes; a null is empty."""
    for batch in batches:
        start = 0
        texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
            end = min(end, len(texts))
            size = int(at[end] - at[start])
            data = np.frombuffer(texts.buffers()[2], np.uint8, size, int(at[start])) if size else np.empty(0, np.uint8)
            yield batch.slice(start, end - start), data, at[start : end + 1] - at[start]
            start = end


def _shingler(words: int, symbols: int) -> Shingler:
    return kept_by_worker(("shingler", words, symbols), lambda: Shingler(words, symbols, 2 << 20))


def sketches(docs: DataFrame, words: int, index: Index) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``set_id`` (null for no words) and ``signature`` of each document."""
    schema = struct_of(doc_id="long", text_hash="long", n_shingles="long", set_id="binary", signature="binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _shingler(words, index.symbols)
        for part, data, offsets in _texts(batches, 2):
            n, ids, signatures = [], [], []
            for s in shingler.shingles(data, offsets):
                n.append(len(s))
                ids.append(_set_id(s) if len(s) else None)
                signatures.append(shingler.signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                 pa.array(signatures, pa.binary())], schema=arrow)

    return _keyed(docs).mapInArrow(run, schema)


def _set_id(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return np.array([_mix(shingles).sum(), _mix(shingles ^ _U(0x5851F42D4C957F2D)).sum()], dtype="<u8").tobytes()


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def index_keys(signed: DataFrame, index: Index) -> DataFrame:
    """``key``, ``rid``: one key for each chunk and symbol left out; the upper bits say which."""
    schema = struct_of(key="long", rid="long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                rid = np.asarray(batch.column(0))
                symbols = _signatures(batch.column(1), index).astype(np.uint64)
                for c in range(index.chunks):
                    keys = []
                    for out in range(index.width):
                        key = np.zeros(len(rid), dtype=np.uint64)
                        for j in range(index.width):
                            if j != out:
                                key = _mix(key + symbols[:, c * index.width + j] + _U(1))
                        keys.append((key >> _U(8) | _U((c * index.width + out) << 56)).view(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys)), pa.array(np.tile(rid, index.width))], schema=arrow)

    return signed.select("rid", "signature").mapInArrow(run, schema)


def _signatures(column, index: Index) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), index.symbols)


def _size_allows(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _with_common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The columns of ``pairs``, the sizes ``n_a``, ``n_b`` of their full sets and ``common``, the size of the intersection."""
    whole = [sets.select(F.col("rid").alias(x), F.col("shingles").alias(f"set_{x}")) for x in ("a", "b")]
    return pairs.join(whole[0], "a").join(whole[1], "b").select(
        *pairs.columns, F.size("set_a").cast("long").alias("n_a"), F.size("set_b").cast("long").alias("n_b"),
        F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("common"))


def _linked(counted: DataFrame, percent: int) -> DataFrame:
    """Pairs with ``percent`` of their union in common or more."""
    # percent * union = percent * (n_a + n_b - common)
    return counted.filter((100 + percent) * F.col("common") >= percent * (F.col("n_a") + F.col("n_b"))).drop("n_a", "n_b", "common")


def components(links: DataFrame) -> DataFrame:
    """``rid``, ``root`` (the smallest of its component) for every end of a link.

    Large-star and small-star steps in turn until nothing changes; each state
    is a written table, so no plan grows and a lost executor costs one step.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        edges = materialize(small.select("e.a", "e.b").filter("a <> b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("rid"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("rid"), F.col("b").alias("root")).distinct())
        mark = now


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))


def _united(roots: DataFrame, joined: DataFrame) -> DataFrame:
    """``roots`` after their components were joined: ``joined`` has the roots whose component has a new one."""
    new = joined.select(F.col("rid").alias("root"), F.col("root").alias("new"))
    old = roots.join(new, "root", "left").select("rid", F.coalesce("new", "root").alias("root"))
    # A document without a link so far is its own root and in no row of roots.
    return old.union(joined.join(roots, "rid", "left_anti").select("rid", "root"))


def _cross_pairs(keys: DataFrame, pivot: DataFrame, counted: DataFrame, signed: DataFrame, sets: DataFrame,
                 roots: DataFrame, percent: int, index: Index, block: int = 2048) -> DataFrame:
    """Pairs ``a``, ``b`` of different components (``root_a``, ``root_b``) that share a key and may be linked, each of them once."""
    keys = _rooted(keys.select("key", "rid"), roots)
    by_root = keys.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = by_root.groupBy("key").agg(
        F.max_by("root", F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.max("n").alias("n_most"),
        F.count("*").alias("roots")).filter("roots > 1")
    held = keys.join(mixed, "key").select(
        "key", "rid", "root", (F.col("root") == F.col("most")).alias("in_most"),
        # Rows outside the largest component meet all rows; blocks of both sides bound a unit of work.
        F.ceil(F.col("n") / block).cast("int").alias("all_blocks"),
        F.ceil((F.col("n") - F.col("n_most")) / block).cast("int").alias("few_blocks"))
    held = materialize(held, "mixed")
    inside = held.select("rid").distinct()
    # How many of a document's shingles no other candidate has, its buckets' pivots included.
    alone = (
        sets.select("rid", F.explode("shingles").alias("shingle"))
        .groupBy("shingle").agg(F.count("*").alias("n"), F.min("rid").alias("rid")).filter("n = 1")
        .groupBy("rid").agg(F.count("*").alias("n_alone"))
    )
    # What each row has in common with the pivot of its bucket; the pivot with itself: all.
    ends = counted.select(F.explode(F.array(
        F.struct(F.col("a").alias("rid"), F.col("b").alias("pivot"), "common"),
        F.struct(F.col("b").alias("rid"), F.col("a").alias("pivot"), "common"))).alias("e")).select("e.*")
    held = held.join(pivot, "key").join(ends, ["rid", "pivot"], "left")
    facts = materialize(
        signed.join(inside, "rid", "left_semi").join(alone, "rid", "left")
        .select("rid", "n_shingles", F.coalesce("n_alone", F.lit(0)).alias("n_alone"), "signature"), "facts")
    salt = F.xxhash64("rid")
    few = held.filter("not in_most").select(
        "key", "rid", "root", "in_most", "common", F.lit(0).alias("side"), F.pmod(salt, "few_blocks").cast("int").alias("few"),
        F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("every"))
    every = held.select(
        "key", "rid", "root", "in_most", "common", F.lit(1).alias("side"),
        F.explode(F.sequence(F.lit(0), F.col("few_blocks") - 1)).alias("few"), F.pmod(salt, "all_blocks").cast("int").alias("every"))
    units = (
        few.unionByName(every).join(facts, "rid")
        .repartition("key", "few", "every").sortWithinPartitions("key", "few", "every", "side")
        .select("key", "few", "every", "side", "rid", "root", "n_shingles", "n_alone", "signature", "in_most",
                F.coalesce("common", "n_shingles").alias("common"))
    )
    schema = struct_of(a="long", b="long", root_a="long", root_b="long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            found = _open_pairs(unit, percent, index)
            if found.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=arrow)

    return units.mapInArrow(run, schema)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one unit after the other, from sorted batches."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = [np.asarray(batch.column(i)) for i in range(3)]
        new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in at])) + 1
        for start, end in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
            own = tuple(int(x[start]) for x in at)
            if own != current and held:
                yield pa.Table.from_batches(held)
                held = []
            current = own
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _open_pairs(unit: pa.Table, percent: int, index: Index) -> np.ndarray:
    """Rows of the two ends and their components."""
    side, rid, root, n, alone = (unit.column(i).to_numpy() for i in (3, 4, 5, 6, 7))
    signs = _signatures(unit.column(8), index)
    chunk, out = divmod(int(unit.column(0)[0].as_py()) >> 56, index.width)
    in_most, common = unit.column(9).to_numpy(), unit.column(10).to_numpy()
    # Shared with the pivot, and neither shared with it nor alone: what two rows have in common is in one of them.
    rest = np.maximum(n - common - alone, 0)
    few, every = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    pairs = []
    for start in range(0, len(few), 64):
        i, j = np.meshgrid(few[start : start + 64], every, indexing="ij")
        i, j = i.ravel(), j.ravel()
        # Two rows outside the largest component meet twice; once is enough.
        open_ = (root[i] != root[j]) & (in_most[j] | (rid[i] < rid[j])) & _size_allows(n[i], n[j], percent)
        most = np.minimum(common[i], common[j]) + np.minimum(rest[i], rest[j])
        open_ &= (100 + percent) * most >= percent * (n[i] + n[j])
        i, j = i[open_], j[open_]
        if not len(i):
            continue
        differ = (signs[i] != signs[j]).reshape(len(i), index.chunks, index.width)
        by_chunk = differ.sum(axis=2)
        # Of the keys that the two share, the first one gives the pair.
        first = (by_chunk <= 1).argmax(axis=1)
        left_out = np.where(by_chunk[np.arange(len(i)), first] == 0, 0, differ[np.arange(len(i)), first].argmax(axis=1))
        good = (by_chunk.sum(axis=1) <= index.most_apart) & (first == chunk) & (left_out == out)
        turned = rid[i[good]] > rid[j[good]]
        low, high = np.where(turned, j[good], i[good]), np.where(turned, i[good], j[good])
        pairs.append(np.stack([rid[low], rid[high], root[low], root[high]]))
    return np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.empty((4, 0), np.int64)


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every document.

    Two documents are linked if 100 * intersection >= ``percent`` * union of
    their sets of ``words``-word shingles (fewer words: all of them as one).
    ``component_id`` is the smallest id of the documents reachable by links, the
    document's own id included; ``kept`` marks the document that has it.

    Null, empty and blank texts have no shingles and are linked with nothing.
    Repeated rows are copies of one another: rows that share an id are all
    marked alike. A null id counts after all others: it is a component's id
    only if no member has one, and such rows are kept. Other columns are not
    read; an empty table gives an empty table.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def build() -> DataFrame:
        base, grouped = _grouped(plain, percent, words)
        ids = grouped.groupBy("root").agg(F.min("row.doc_id").alias("component_id"))
        of_set = grouped.join(ids, "root").select("set_id", "component_id")
        return base.join(of_set, "set_id", "left").select(
            "doc_id", "n_shingles",
            F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

    return settled(docs.sparkSession, "near_duplicates", build).withColumnRenamed("doc_id", id_col)


def one_of_each(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the document of the smallest id.

    Of repeated rows, and of rows of one id and text, one stays; documents
    without shingles (null or empty texts) stay, one for each id. Rows without
    an id come after those with one. Columns may have any names; an empty table
    gives an empty table.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def build() -> DataFrame:
        base, grouped = _grouped(plain, percent, words)
        chosen = grouped.groupBy("root").agg(F.min("row").alias("row")).select("row.doc_id", "row.text_hash")
        return chosen.unionByName(base.filter("set_id is null").select("doc_id", "text_hash").distinct()).toDF(
            "_of_id", "_of_hash")

    chosen = settled(docs.sparkSession, "one_of_each", build)
    names = [f"c{i}" for i in range(len(docs.columns))]  # by place, so that no name of the table can clash
    id_at, text_at = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    keyed = docs.toDF(*names).withColumns(
        {"_id": id_at.cast("long"), "_hash": F.xxhash64(F.coalesce(text_at.cast("string"), F.lit("")))})
    found = keyed.join(chosen, F.col("_id").eqNullSafe(F.col("_of_id")) & (F.col("_hash") == F.col("_of_hash")), "left_semi")
    return found.dropDuplicates(["_id", "_hash"]).select(*names).toDF(*docs.columns)


def _grouped(plain: DataFrame, percent: int, words: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all documents, and ``root`` and the first ``row`` of each class of equal sets."""
    index = index_for(percent)
    base = materialize(sketches(plain, words, index), "sketches")
    # Equal sets are one class; copies meet as partial results, not as rows. Rows without an id come last.
    classes = base.filter("set_id is not null").groupBy("set_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("row"),
        F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    signed = materialize(
        classes.select(F.monotonically_increasing_id().alias("rid"), "set_id", "row", "n_shingles", "signature"), "classes")
    in_bucket = F.count("*").over(Window.partitionBy("key"))
    keys = release_shuffles(materialize(index_keys(signed, index).withColumn("n", in_bucket).filter("n > 1"), "shared_keys"))
    # The member that shares most buckets is likest to the others: comparing with it links most of a group.
    shares = keys.groupBy("rid").agg(F.sum("n").alias("shares"))
    some = materialize(signed.join(shares, "rid"), "candidates")
    pivot = keys.join(some.select("rid", "shares"), "rid").groupBy("key").agg(
        F.max_by("rid", F.struct("shares", "rid")).alias("pivot"))
    pivots = materialize(
        keys.join(pivot, "key").filter("rid <> pivot")
        .select(F.least("rid", "pivot").alias("a"), F.greatest("rid", "pivot").alias("b")).distinct(), "pivot_pairs")
    pivot = materialize(pivot, "pivots")
    sets = release_shuffles(materialize(_sets(plain, some, words), "sets"))
    counted = release_shuffles(materialize(_with_common(pivots, sets), "pivot_counts"))
    first = _linked(counted, percent)
    roots = components(first)
    cross = _cross_pairs(keys, pivot, counted, some, sets, roots, percent, index)
    cross = release_shuffles(materialize(cross, "cross_pairs"))
    # Only components are joined now, so the steps read a link of two of them and no link a second time.
    joins = _linked(_with_common(cross, sets), percent).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    roots = _united(roots, components(joins))
    return base, _rooted(signed.select("rid", "set_id", "row"), roots)


def _sets(plain: DataFrame, some: DataFrame, words: int) -> DataFrame:
    """``rid``, ``shingles`` (sorted) of the given classes, read again from the text of one of their documents.

    A bitmap of the wanted hashes, of bounded size, keeps most other texts out
    of the shuffle; the join on id and hash removes what it lets through.
    """
    who = some.select("rid", *_identity("row.doc_id", "row.text_hash"))
    texts = (
        _passing(_keyed(plain), ShingleFilter(who, "of_hash")).select("text", *_identity("doc_id", "text_hash"))
        .dropDuplicates(["of_id", "no_id", "of_hash"]).join(who, ["of_id", "no_id", "of_hash"]).select("rid", "text")
    )
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _shingler(words, 0)
        for part, data, offsets in _texts(batches, 1):
            sets = [np.sort(s.view(np.int64)) for s in shingler.shingles(data, offsets)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, arrow[1].type)], schema=arrow)

    return texts.mapInArrow(run, schema)


def _identity(doc_id: str, text_hash: str) -> list[Column]:
    """``of_id``, ``no_id``, ``of_hash``, none of them null: one shuffle by them serves removal of copies and join."""
    return [F.coalesce(F.col(doc_id), F.lit(0)).cast("long").alias("of_id"), F.col(doc_id).isNull().alias("no_id"),
            F.col(text_hash).alias("of_hash")]


def _passing(keyed: DataFrame, wanted: ShingleFilter) -> DataFrame:
    """The rows whose ``text_hash`` may be wanted."""
    passing, load = wanted.reader()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = load()
        for batch in batches:
            at = passing(bitmap, np.asarray(batch.column(1)))
            if len(at):
                yield batch.take(pa.array(at))

    return keyed.mapInArrow(run, keyed.schema)
