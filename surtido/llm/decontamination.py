"""Which documents hold passages of a benchmark: a prefix-filtered join of word windows.

An item's windows are sequences of words; their tokens are word shingles. A
window occurs only where all its shingles do, so its prefix in the order from
rare to frequent is one shingle, the rarest in the corpus, and a window with a
shingle that the corpus lacks occurs nowhere.

1. One pass over the documents counts the shingles that the benchmark has.
2. Each window keeps its rarest shingle and that shingle's place in it.
3. A second pass finds these shingles. They join the windows on the shingle;
   the place must leave room for the window before and after (position and
   length bounds); what remains is compared word by word.

Both passes look shingles up in a bitmap of bounded size and lose none; what
the bitmap lets through in excess, the joins on the shingles' hashes remove.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surtido.llm.common import map_rows, settled, struct_of, whole_text
from surtido.session import materialize

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BUCKET = 1 << 15  # bits in one of Spark's bitmaps


#: Powers of the base modulo 2^64; letters of longer words take them in turn again.
_POWERS = np.cumprod(np.full(1 << 12, _BASE))


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text in lower case (A-Z) as bytes, where its words start and end, and their hashes."""
    text = _LOWER[np.frombuffer(raw, np.uint8)]
    inside = np.zeros(len(text) + 2, dtype=np.int8)
    inside[1:-1] = _IN_WORD[text]
    edge = np.flatnonzero(np.diff(inside))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return text, starts, ends, np.empty(0, np.uint64)
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
    letters = text[_IN_WORD[text]].astype(np.uint64) + np.uint64(1)
    return text, starts, ends, _mixed(np.add.reduceat(letters * _POWERS[within & (len(_POWERS) - 1)], before))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words, as signed numbers."""
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, np.int64)
    total = np.full(n, np.uint64(size))
    for k in range(size):
        total = total * _BASE + words[k : k + n]
    return _mixed(total).view(np.int64)


def _spelled(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, last: int) -> str:
    """Words first to last - 1, joined by spaces."""
    return b" ".join(text[starts[k] : ends[k]].tobytes() for k in range(first, last)).decode()


class ShingleFilter:
    """A bitmap with the bit of every wanted shingle set; a shingle without its bit is not wanted.

    A shingle of another size or a chance hit may pass; the size of the bitmap
    follows the number of shingles up to 2^28 bits, so it is never large, and
    beyond that lets more through.
    """

    def __init__(self, hashes: DataFrame, column: str):
        spark = hashes.sparkSession
        distinct = hashes.select(F.col(column).alias("h")).distinct()
        bits = min(28, max(15, (64 * distinct.count()).bit_length()))
        place = F.col("h").bitwiseAND(F.lit((1 << bits) - 1)) + 1  # Spark's first bucket begins at 1
        rows = (
            distinct.select(place.alias("at"))
            .groupBy(F.bitmap_bucket_number("at").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
            .toLocalIterator()
        )
        packed = np.zeros((1 << bits) // 8, dtype=np.uint8)
        for row in rows:
            at = (row.bucket - 1) * _BUCKET // 8
            packed[at : at + _BUCKET // 8] = np.frombuffer(row.bits, np.uint8)
        self.mask = np.int64((1 << bits) - 1)
        self.stored = spark.sparkContext.broadcast(zlib.compress(packed.tobytes(), 1))

    def reader(self):
        """In a task: places of the hashes that pass."""
        stored, mask = self.stored, self.mask

        def load() -> np.ndarray:
            return np.frombuffer(zlib.decompress(stored.value), np.uint8)

        return lambda bitmap, hashes: _set_bits(bitmap, hashes & mask), load


def _set_bits(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.flatnonzero(bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1)


def item_windows(items: DataFrame, length: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each distinct window and item: ``item_id`` (text), ``words``, ``n`` and ``hashes`` of its shingles."""

    def rows(taken: Iterator[tuple]) -> Iterator[tuple]:
        for item_id, raw in taken:
            text, starts, ends, words = words_of(raw)
            n = min(length, len(words))
            if not n:
                continue
            size = min(n, shingle)
            hashes = shingle_hashes(words, size)
            seen = set()
            for first in range(len(words) - n + 1):
                spelled = _spelled(text, starts, ends, first, first + n)
                if spelled not in seen:
                    seen.add(spelled)
                    yield item_id, spelled, n, size, hashes[first : first + n - size + 1].tolist()

    schema = struct_of(item_id="string", words="string", n="int", size="int", hashes="array<long>")
    whole = F.encode(whole_text(text_col), "UTF-8")
    return map_rows(items.select(F.col(id_col).cast("string"), whole), rows, schema)


def shingle_counts(docs: DataFrame, wanted: ShingleFilter, sizes: list[int], text_col: str) -> DataFrame:
    """``h`` and ``count`` of every shingle of the documents that passes the filter."""
    passing, load = wanted.reader()

    def rows(taken: Iterator[tuple]) -> Iterator[tuple]:
        bitmap, held, size = load(), [], 0
        for (raw,) in taken:
            words = words_of(raw)[3]
            for k in sizes:
                hashes = shingle_hashes(words, k)
                found = hashes[passing(bitmap, hashes)]
                held.append(found)
                size += len(found)
            if size > 1 << 18:
                yield from _counted(held)
                held, size = [], 0
        yield from _counted(held)

    schema = struct_of(h="long", count="long")
    found = map_rows(docs.select(F.encode(whole_text(text_col), "UTF-8")), rows, schema)
    return found.groupBy("h").agg(F.sum("count").alias("count"))


def _counted(held: list[np.ndarray]) -> Iterator[tuple]:
    if held:
        hashes, counts = np.unique(np.concatenate(held), return_counts=True)
        yield from zip(hashes.tolist(), counts.tolist())


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each distinct window by its rarest shingle: ``h``, ``place`` of the shingle in it, ``words``, ``n``, ``size``.

    Windows with a shingle that no document has are left out.
    """
    each = windows.select("words", "n", "size", F.posexplode("hashes").alias("place", "h"))
    rarest = F.min(F.struct("count", "h", "place")).alias("rarest")
    return (
        each.join(counts, "h", "left")
        .groupBy("words", "n", "size").agg(rarest, F.count_if(F.col("count").isNull()).alias("lacking"))
        .filter("lacking = 0").select("words", "n", "size", "rarest.h", "rarest.place")
    )


def prefix_hits(docs: DataFrame, wanted: ShingleFilter, sizes: list[int], length: int, id_col: str,
                text_col: str) -> DataFrame:
    """A row for each document with ``n_words``, and one for each of its shingles that passes the filter.

    The latter have ``h``, ``at`` (the place of the shingle in the document),
    ``size`` and ``around``: the words from ``lead`` words before it up to
    ``length`` words in all on either side of its first word.
    """
    passing, load = wanted.reader()

    def rows(taken: Iterator[tuple]) -> Iterator[tuple]:
        bitmap = load()
        for row_id, doc_id, raw in taken:
            text, starts, ends, words = words_of(raw)
            yield row_id, doc_id, len(words), None, None, None, None, None
            for k in sizes:
                hashes = shingle_hashes(words, k)
                for at in passing(bitmap, hashes).tolist():
                    # A window of fewer words than a whole one is its own shingle.
                    reach = length if k == max(sizes) else k
                    low, high = max(0, at - reach + k), min(len(words), at + reach)
                    yield row_id, doc_id, len(words), int(hashes[at]), at, k, at - low, _spelled(text, starts, ends, low, high)

    schema = struct_of(row_id="long", doc_id="long", n_words="long", h="long", at="int", size="int", lead="int", around="string")
    return map_rows(
        docs.select(F.monotonically_increasing_id(), F.col(id_col).cast("long"), F.encode(whole_text(text_col), "UTF-8")),
        rows, schema)


def occurrences(hits: DataFrame, prefix: DataFrame) -> DataFrame:
    """Distinct ``row_id``, ``start``, ``n`` and ``words`` where a window stands in a document."""
    start = F.col("at") - F.col("place")
    around = F.split("around", " ", -1)
    return (
        hits.filter("h is not null").join(prefix, ["h", "size"])
        .filter((start >= 0) & (start + F.col("n") <= F.col("n_words")) & (F.col("place") <= F.col("lead")))
        .filter(F.array_join(F.slice(around, F.col("lead") - F.col("place") + 1, F.col("n")), " ") == F.col("words"))
        .select("row_id", start.alias("start"), "n", "words")
    )


def _covered(found: DataFrame) -> DataFrame:
    """``n_hit``: the words of each document that some occurrence covers."""
    places = found.select("row_id", "start", (F.col("start") + F.col("n")).alias("end")).groupBy("row_id", "start").agg(
        F.max("end").alias("end"))
    earlier = Window.partitionBy("row_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.coalesce(F.max("end").over(earlier), F.lit(0)), F.col("start"))
    return places.select("row_id", F.greatest(F.col("end") - reached, F.lit(0)).alias("new")).groupBy("row_id").agg(
        F.sum("new").alias("n_hit"))


def find_contaminated(docs: DataFrame, items: DataFrame, length: int = 10, shingle: int = 5, id_col: str = "doc_id",
                      text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Which words of each document stand in a passage of ``length`` words of an item.

    Words are runs of ASCII letters and digits and of all other than ASCII
    characters, A-Z in lower case. A window is ``length`` consecutive words of
    an item, or all words of an item with fewer. Columns: the id, ``n_words``,
    ``n_hit`` (words inside an occurrence of a window), ``n_items`` (items with
    such windows), ``items_sha256`` (of their ids as texts, sorted, joined by
    commas) and ``contaminated`` (``n_hit`` > 0).

    One output row for each document row, repeated rows and null ids included;
    null and empty texts have no words. Rows of one item id are one item; a row
    without an item id marks words but is not counted or listed; items without
    words have no windows. Empty tables give empty results or documents without
    hits; other columns are not read.
    """
    return settled(docs.sparkSession, "contaminated", lambda: _contaminated(
        docs, items, length, shingle, id_col, text_col, item_col, item_text_col))


def _contaminated(docs: DataFrame, items: DataFrame, length: int, shingle: int, id_col: str, text_col: str,
                  item_col: str, item_text_col: str) -> DataFrame:
    windows = materialize(item_windows(items, length, shingle, item_col, item_text_col), "windows")
    distinct = windows.dropDuplicates(["words"]).drop("item_id")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most ``shingle`` numbers
    wanted = ShingleFilter(windows.select(F.explode("hashes").alias("h")), "h")
    counts = shingle_counts(docs, wanted, sizes, text_col)
    prefix = materialize(prefixes(distinct, counts), "prefixes")
    # Stored, so that row ids are given once.
    hits = materialize(prefix_hits(docs, ShingleFilter(prefix, "h"), sizes, length, id_col, text_col), "hits")
    found = materialize(occurrences(hits, prefix), "occurrences")
    listed = (
        found.select("row_id", "words").distinct()
        .join(windows.select("words", "item_id").filter("item_id is not null"), "words")
        .groupBy("row_id").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
        .select("row_id", F.size("ids").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    )
    none = F.coalesce(F.col("n_hit"), F.lit(0))
    return (
        hits.filter("h is null").select("row_id", F.col("doc_id").alias(id_col), "n_words")
        .join(_covered(found), "row_id", "left").join(listed, "row_id", "left")
        .select(
            id_col, "n_words", none.cast("long").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (none > 0).alias("contaminated"))
    )


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
SQL = f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS words
  FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
g AS (
  SELECT r, i, s.n, array_to_string(w[i : i + s.n - 1], ' ') AS words
  FROM (SELECT DISTINCT n FROM win) s, d, unnest(range(1, len(w) - s.n + 2)) AS t(i)),
m AS (SELECT g.r, g.i, g.n, win.item_id FROM g JOIN win USING (words)),
h AS (SELECT r, count(DISTINCT k) AS n_hit FROM m, unnest(range(i, i + n)) AS t(k) GROUP BY r),
t AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
         sha256(array_to_string(list_sort(list_distinct(list(item_id))), ',')) AS items_sha256
  FROM m WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
