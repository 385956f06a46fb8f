"""Removal of repeated passages by column-wise construction of a collection's Burrows-Wheeler order.

Whole documents would need one round a byte of the longest one. So the
documents of the collection are short contexts, which hold every passage of
``length`` bytes that can repeat:

* Of every ``W`` consecutive k-grams of a document (together ``length`` bytes)
  the one of least hash is an anchor. Equal passages choose the same anchor at
  the same place, so only anchors that occur twice matter, each with the bytes
  around it that such passages can reach.
* Equal contexts of an anchor are one with a count. A context that occurs
  twice is repeated as a whole.
* The different contexts of an anchor are one collection. One symbol of each is
  inserted a round, from the right end to the left, which updates the order of
  all suffixes and the common prefixes of neighbours. Because contexts are
  aligned at their anchor, the suffixes of one round only need their order
  among themselves. A suffix that has ``length`` bytes or more in common with a
  neighbour starts a repeated passage.

An anchor with very many different contexts is split by longer pieces of its
passages, so that no collection grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from surtido.llm.common import kept_by_worker, release_shuffles, settled
from surtido.llm.hamming_join import _mix, _texts
from surtido.session import materialize

_U = np.uint64
_PAD = 256            # a symbol beyond the end of a document
FAMILIES = 8


class Anchors:
    """Anchors and hashes of pieces of texts, a block at a time."""

    def __init__(self, length: int, k: int):
        self.length, self.k, self.window = length, k, length - k + 1
        rng = np.random.default_rng(2)
        self.byte = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self._powers(1 << 20)

    def _powers(self, n: int) -> None:
        base = 0x9E3779B97F4A7C15
        self.power, self.back = (
            np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]))
            for b in (base, pow(base, -1, 1 << 64)))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.power):
            self._powers(2 * len(data))
        upto = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.byte[data] * self.power[: len(data)], out=upto[1:])
        return upto

    def piece(self, upto: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from start to end, whatever stands before."""
        return _mix((upto[end] - upto[start]) * self.back[start])

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text number, place in it, anchor hash, context hash) of all anchors of a block."""
        k, window, n = self.k, self.window, len(data)
        if n < self.length:
            nothing = np.empty(0, np.int64)
            return nothing, nothing, nothing, nothing
        upto = self.prefix(data)
        grams = self.piece(upto, np.arange(n - k + 1), np.arange(k, n + 1))
        # The lower bits say where: of equal hashes the last one counts.
        low = _U((1 << max(21, n.bit_length())) - 1)
        least = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
        span = 1
        while 2 * span <= window:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < window:
            least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
        start = np.arange(len(least))
        text = np.searchsorted(offsets, start, side="right") - 1
        chosen = np.zeros(n, dtype=bool)
        chosen[(low - (least[start + self.length <= offsets[text + 1]] & low)).astype(np.int64)] = True
        at = np.flatnonzero(chosen)
        text = np.searchsorted(offsets, at, side="right") - 1
        left, right = self.reach(at - offsets[text], (offsets[1:] - offsets[:-1])[text])
        context = self.piece(upto, at - left, at + k + right)
        context = _mix(context + left.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + (right.astype(np.uint64) << _U(32)))
        return text, at - offsets[text], grams[at].view(np.int64), context.view(np.int64)

    def reach(self, place, size):
        """How many bytes of the text before and behind an anchor its passages can reach."""
        return np.minimum(self.window - 1, place), np.minimum(self.window - 1, size - place - self.k)


def _anchors(length: int, k: int) -> Anchors:
    return kept_by_worker(("anchors", length, k), lambda: Anchors(length, k))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _list_type(kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(kind, containsNull=False)


def _anchored(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Per document with anchors: ``doc_id``, ``text_hash``, ``size`` and its anchors as parallel lists."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("size", T.LongType()),
        T.StructField("places", _list_type(T.LongType())), T.StructField("anchors", _list_type(T.LongType())),
        T.StructField("contexts", _list_type(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _anchors(length, k)
        # The finder holds some twenty arrays of eight bytes for each byte of a block.
        for part, data, offsets in _texts(batches, 2, 512 << 10):
            text, place, anchor, context = finder.of(data, offsets)
            first = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x)).cast(f.type)
                     for x, f in zip((place, anchor, context), list(arrow)[3:])]
            whole = pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.diff(offsets)), *lists], schema=arrow)
            yield whole.filter(pa.array(np.diff(first) > 0))

    return _keyed(docs).mapInArrow(run, schema)


def _contexts(docs: DataFrame, wanted: DataFrame, length: int, k: int) -> DataFrame:
    """The bytes of the wanted contexts, one row each; for split anchors one row for each family they can be in.

    ``anchor``, ``family`` (-1: not split), ``core``, ``context``, ``counted``, ``left``, ``right``, ``bytes``
    (without the anchor itself).
    """
    window = length - k + 1
    step = -(-window // FAMILIES)
    names = ("anchor", "context", "place", "split", "counted")
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("anchor", T.LongType()), ("family", T.IntegerType()), ("core", T.LongType()), ("context", T.LongType()),
        ("counted", T.BooleanType()), ("left", T.IntegerType()), ("right", T.IntegerType()), ("bytes", T.BinaryType()))])
    arrow = to_arrow_schema(schema)
    by_doc = wanted.groupBy("of_id", "of_hash").agg(F.collect_list(F.struct(*names)).alias("wanted"))
    texts = _keyed(docs).join(
        by_doc, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _anchors(length, k)
        for part, data, offsets in _texts(batches, 0):
            upto = finder.prefix(data)
            lists = part.column(1)
            of = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(lists)))
            rows = lists.flatten()
            anchor, context, place, split, counted = (
                rows.field(n).to_numpy(zero_copy_only=False) for n in names)
            at = offsets[of] + place
            left, right = finder.reach(place, np.diff(offsets)[of])
            out: list[list] = [[] for _ in schema]

            def add(i: np.ndarray, family: int, core: np.ndarray) -> None:
                raw = data.tobytes() if not out[7] else add.raw
                add.raw = raw
                starts, mids, ends = at[i] - left[i], at[i], at[i] + k + right[i]
                values = [raw[s:m] + raw[m + k : e] for s, m, e in zip(starts.tolist(), mids.tolist(), ends.tolist())]
                for column, value in zip(out, (anchor[i], np.full(len(i), family), core, context[i], counted[i], left[i], right[i])):
                    column.append(value)
                out[7].extend(values)

            plain = np.flatnonzero(~split)
            if len(plain):
                add(plain, -1, np.zeros(len(plain), np.int64))
            for family in range(FAMILIES if split.any() else 0):
                # Passages that start d bytes before the anchor, for d in [low, high], all hold the core.
                low, high = family * step, min(window - 1, (family + 1) * step - 1)
                behind = length - k - high
                i = np.flatnonzero(split & (left >= low) & (right >= behind))
                if low <= high and len(i):
                    add(i, family, finder.piece(upto, at[i] - low, at[i] + k + behind).view(np.int64))
            if out[7]:
                columns = [np.concatenate(c) for c in out[:7]]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c).cast(f.type) for c, f in zip(columns, arrow)), pa.array(out[7], pa.binary())], schema=arrow)

    return texts.select("text", "wanted").mapInArrow(run, schema)


def repeated_starts(symbols: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, length: int,
                    k: int) -> np.ndarray:
    """Row x start: whether the passage that starts there occurs in another row of its group.

    ``symbols`` has the window - 1 symbols before and behind the anchor of each
    row; rows are sorted by group. Start j lies window - 1 - j bytes before the
    anchor.
    """
    rows, window = len(group), length - k + 1
    order = np.arange(rows)
    fence = np.concatenate([[True], group[1:] != group[:-1], [True]])   # no neighbours across
    common = np.zeros(rows + 1, dtype=np.int64)
    common[fence] = -1
    out = np.zeros((rows, window), dtype=bool)

    def mark(start: int) -> None:
        good = np.maximum(common[:-1], common[1:]) >= length
        out[order[good], start] = True

    def insert(column: np.ndarray) -> None:
        nonlocal order, common
        own = column[order]
        same = own[1:] == own[:-1]
        if (same | fence[1:-1]).all():          # one symbol in each group: the order stays
            common[~fence] += 1
            return
        moved = np.argsort(group * 512 + own, kind="stable")   # group is the same before and after
        x, y = moved[:-1], moved[1:]
        alike = (group[1:] == group[:-1]) & (own[x] == own[y])
        new = np.zeros(rows + 1, dtype=np.int64)
        x, y, place = x[alike], y[alike], np.flatnonzero(alike) + 1
        least = common[y]
        apart = np.flatnonzero(y > x + 1)
        if len(apart):
            spans = np.stack([x[apart] + 1, y[apart] + 1], axis=1).ravel()
            least[apart] = np.minimum.reduceat(common, spans)[::2]
        new[place] = least + 1
        new[fence] = -1
        order, common = order[moved], new

    for j in range(2 * window - 3, window - 2, -1):
        insert(symbols[:, j])
    common[~fence] += k                         # the anchor itself
    mark(window - 1)
    for j in range(window - 2, -1, -1):
        insert(symbols[:, j])
        mark(j)
    start = np.arange(window)
    inside = (start >= window - 1 - left[:, None]) & (start + length <= window - 1 + k + right[:, None])
    return out & inside


def _matrix(values: list[bytes], left: np.ndarray, right: np.ndarray, window: int) -> np.ndarray:
    out = np.full((len(values), 2 * window - 2), _PAD, dtype=np.int16)
    for i, v in enumerate(values):
        out[i, window - 1 - left[i] : window - 1 + right[i]] = np.frombuffer(v, np.uint8)
    return out


def _collections(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of whole groups (the first three columns) of about ``most`` rows, from sorted batches."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if held and rows >= most and batch.num_rows:
            table = pa.Table.from_batches(held)
            cut = _last_group(table)
            if cut:
                yield table.slice(0, cut)
                held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        held.append(batch)
        rows += batch.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def _last_group(table: pa.Table) -> int:
    """Where the last group begins."""
    new = np.logical_or.reduce([(x := table.column(i).to_numpy())[1:] != x[:-1] for i in range(3)])
    at = np.flatnonzero(new)
    return int(at[-1]) + 1 if len(at) else 0


def _repeats(contexts: DataFrame, length: int, k: int, most: int) -> DataFrame:
    """``anchor``, ``context``, ``low``, ``high``: passages that start ``low`` to ``high`` - 1 bytes from the anchor repeat.

    For contexts that occur once; the others are only compared with.
    """
    window = length - k + 1
    step = -(-window // FAMILIES)
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("anchor", T.LongType()), ("context", T.LongType()), ("low", T.IntegerType()), ("high", T.IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _collections(batches, most):
            anchor, family, core, context, counted, left, right = (table.column(i).to_numpy() for i in range(7))
            new = np.concatenate([[False], (anchor[1:] != anchor[:-1]) | (family[1:] != family[:-1]) | (core[1:] != core[:-1])])
            group = np.cumsum(new)
            size = np.bincount(group)[group]
            some = np.flatnonzero(size > 1)
            if not len(some):
                continue
            values = table.column(7).take(pa.array(some)).to_pylist()
            found = repeated_starts(_matrix(values, left[some], right[some], window), group[some], left[some], right[some], length, k)
            split = family[some]
            if (split >= 0).any():
                before = window - 1 - np.arange(window)
                found &= (split[:, None] < 0) | (before // step == split[:, None])
            found[counted[some]] = False
            edge = np.diff(found.astype(np.int8), axis=1, prepend=0, append=0)
            row, low = np.nonzero(edge == 1)
            high = np.nonzero(edge == -1)[1]
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[some][row]), pa.array(context[some][row]),
                     *(pa.array((x - (window - 1)).astype(np.int32)) for x in (low, high))], schema=arrow)

    group = ["anchor", "family", "core"]
    return contexts.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, length: int = 200, k: int = 65, most_contexts: int = 1024,
                   most_split: int = 16384) -> DataFrame:
    """``doc_id``, ``text_hash``, ``spans``: per text with repeats the byte runs (start, end) they cover.

    Sorted by start, not yet merged where they overlap or touch. A byte is covered if it lies in a string of ``length`` bytes that starts
    anywhere else too. ``docs`` has ``doc_id`` and ``text``. A text is known by
    id and hash, so repeated rows share one row here.

    An anchor with more than ``most_contexts`` different contexts is split by
    longer pieces of its passages; a piece that still has more than
    ``most_split`` is settled passage by passage. Neither changes the result.
    """
    return settled(docs.sparkSession, "spans", lambda: _spans(docs, length, k, most_contexts, most_split))


def _spans(docs: DataFrame, length: int, k: int, most_contexts: int, most_split: int) -> DataFrame:
    window = length - k + 1
    table = release_shuffles(materialize(
        _anchored(docs, length, k).withColumn("rid", F.monotonically_increasing_id()), "anchors"))
    places = table.select("rid", "size", F.explode(F.arrays_zip("places", "anchors", "contexts")).alias("x")).select(
        "rid", F.col("x.anchors").alias("anchor"), F.col("x.contexts").alias("context"),
        F.col("x.places").cast("int").alias("place"),
        F.least(F.col("size") - F.col("x.places") - k, F.lit(window - 1)).cast("int").alias("right"))
    twice = table.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    held = release_shuffles(materialize(places.join(twice.select("anchor"), "anchor"), "repeated_anchors"))

    contexts = materialize(
        held.groupBy("anchor", "context").agg(
            F.count("*").alias("n"), F.min(F.struct("rid", "place")).alias("one")), "contexts")
    several = contexts.groupBy("anchor").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    owners = table.select("rid", F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"))
    wanted = (
        contexts.join(several, "anchor")
        .select("anchor", "context", F.col("one.rid").alias("rid"), F.col("one.place").alias("place"),
                (F.col("contexts") > most_contexts).alias("split"), (F.col("n") > 1).alias("counted"))
        .join(owners, "rid")
        # Repeated rows hold the same anchors; one of them is enough.
        .dropDuplicates(["anchor", "context"])
    )
    texts = release_shuffles(materialize(_contexts(docs, wanted, length, k), "context_bytes"))
    alike = texts.filter("family >= 0").groupBy("anchor", "family", "core").agg(F.count("*").alias("contexts"))
    large = alike.filter(F.col("contexts") > most_split)
    group = ["anchor", "family", "core"]
    found = _repeats(texts.join(large, group, "left_anti"), length, k, 4 * most_contexts).unionByName(
        _by_passage(texts.join(large, group, "left_semi"), length, k))
    found = release_shuffles(materialize(found, "repeats"))

    counted = contexts.filter("n > 1").select("anchor", "context")
    left = F.least(F.col("place"), F.lit(window - 1))
    whole = held.join(counted, ["anchor", "context"]).select(
        "rid", (F.col("place") - left).alias("start"), (F.col("place") + k + F.col("right")).alias("end"))
    parts = held.join(found, ["anchor", "context"]).select(
        "rid", (F.col("place") + F.col("low")).alias("start"), (F.col("place") + F.col("high") - 1 + length).alias("end"))
    runs = (
        whole.filter(F.col("end") - F.col("start") >= length).unionByName(parts)
        # Several anchors give the same run of a copied document; a task sends the longest from each start.
        .groupBy("rid", "start").agg(F.max("end").alias("end"))
        .groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("found"))
    )
    return (
        runs.join(owners, "rid")
        .select(F.col("of_id").alias("doc_id"), F.col("of_hash").alias("text_hash"), F.col("found").alias("spans"))
        .dropDuplicates(["doc_id", "text_hash"])
    )


def _by_passage(texts: DataFrame, length: int, k: int) -> DataFrame:
    """Like ``_repeats`` for collections that stay too large: each passage by a hash of all its bytes."""
    window = length - k + 1
    step = -(-window // FAMILIES)
    before = F.explode(F.sequence(F.col("family") * step, F.least(F.lit(window), (F.col("family") + 1) * step) - 1))
    rows = texts.withColumn("before", before).filter((F.col("left") >= F.col("before")) & (F.col("right") >= length - k - F.col("before")))
    passage = F.substring(F.col("bytes"), F.col("left") - F.col("before") + 1, F.lit(length - k))
    hashed = rows.select("anchor", "context", "counted", "before", F.md5(passage).alias("passage"))
    key = ["anchor", "before", "passage"]
    twice = hashed.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    return hashed.filter("not counted").join(twice, key).select(
        "anchor", "context", (-F.col("before")).cast("int").alias("low"), (1 - F.col("before")).cast("int").alias("high"))


def remove_repeats(docs: DataFrame, length: int = 200, k: int = 65, most_contexts: int = 1024, most_split: int = 16384,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (maximal removed runs) and ``kept`` (binary: the remaining bytes) of every document.

    Strings are judged on the input: where a passage repeats, all its
    occurrences go, in one document or in several. One output row for each
    input row: null and empty texts have no bytes; repeated rows are copies of
    one another; a null id is an id of its own; other columns are not read; an
    empty table gives an empty table.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spans = repeated_spans(plain, length, k, most_contexts, most_split)
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", spans.schema["spans"].dataType), T.StructField("kept", T.BinaryType())])
    arrow = to_arrow_schema(schema)
    rows = _with_spans(plain.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), spans, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _texts(batches, 1):
            runs, kept = _cut(part.column(2), data, offsets)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(offsets)), pa.array(runs, arrow[2].type), pa.array(kept, pa.binary())],
                schema=arrow)

    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)


def without_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns, with repeated passages cut out of the texts.

    All occurrences of a passage go, the first one too. A character of which a
    cut leaves a part goes as a whole. Null texts stay null; ids may be null or
    repeat (repeated rows are copies of one another); columns may have any
    names; an empty table gives an empty table.
    """
    spans = repeated_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), length)
    place = docs.columns.index(text_col)
    arrow = to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _texts(batches, place):
            runs, kept = _cut(part.column(part.num_columns - 1), data, offsets)
            old = part.column(place)
            new = pa.array([k.decode("utf-8", "ignore") if r else None for r, k in zip(runs, kept)], arrow[place].type)
            cut = pa.array([bool(r) for r in runs], pa.bool_())
            columns = list(part.columns[:-1])
            columns[place] = pc.if_else(cut, new, old.cast(arrow[place].type))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return _with_spans(docs, spans, id_col, text_col).mapInArrow(run, docs.schema)


def _with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns of ``docs`` by place and, as the last one, the spans of the text (null: none)."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # by place, so that no name of the table can clash
    id_at, text_at = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    keyed = docs.toDF(*names).withColumns(
        {"_id": id_at.cast("long"), "_hash": F.xxhash64(F.coalesce(text_at.cast("string"), F.lit("")))})
    joined = keyed.join(
        spans.toDF("_of_id", "_of_hash", "_spans"),
        F.col("_id").eqNullSafe(F.col("_of_id")) & (F.col("_hash") == F.col("_of_hash")), "left")
    return joined.select(*names, "_spans")


def _cut(spans: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[list[list[dict]], list[bytes]]:
    """The merged runs of each text and what is left without them."""
    raw, kept = data.tobytes(), []
    runs = [_merged(r or ()) for r in spans.to_pylist()]
    for start, end, own in zip(offsets[:-1].tolist(), offsets[1:].tolist(), runs):
        pieces, at = [], start
        for span in own:
            pieces.append(raw[at : start + span["start"]])
            at = start + span["end"]
        kept.append(b"".join([*pieces, raw[at:end]]))
    return runs, kept


def _merged(runs) -> list[dict]:
    """Maximal runs of sorted ones."""
    out: list[dict] = []
    for run in runs:
        if out and run["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], run["end"])
        else:
            out.append(dict(run))
    return out


def digests(cleaned: DataFrame) -> DataFrame:
    """The check columns of ``remove_repeats``' rows."""
    return cleaned.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
