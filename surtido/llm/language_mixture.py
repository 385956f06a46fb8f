"""Language identification by mixture inference.

Learning counts byte trigrams (lower case; ASCII other than letters is a space)
per language over all labelled rows, hashed to a fixed number of slots. For a
document, every word has a likelihood under each language, the product over
its trigrams, and expectation-maximisation finds the proportions of the
languages that explain its words best. Sets of languages are compared by
likelihood less a penalty for each further language; the document's language
is the largest proportion of the best set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLOTS = 1 << 16
UNDETERMINED = "und"

_SPACE = 32
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [c | 32 if chr(c).isalpha() else _SPACE for c in range(128)]


@dataclass
class Block:
    """The words of some texts as trigram slots; texts without a word have an empty run."""

    slots: np.ndarray         # by byte of a word: the trigram around it
    word_start: np.ndarray    # first of these of each word
    text_start: np.ndarray    # first word of each text, with the end of the last one


def _blocks(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, Block]]:
    """(first text, end, block) over pieces of about ``most`` bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    start = 0
    while start < len(texts):
        end = min(len(texts), start + max(1, int(np.searchsorted(np.cumsum(sizes[start : start + 4096]), most))))
        yield start, end, _block(texts.slice(start, end - start))
        start = end


def _block(texts: pa.Array) -> Block:
    low = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_binary())
    offsets = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1, low.offset * 8)
    size = int(offsets[-1] - offsets[0])
    if not size:
        nothing = np.empty(0, dtype=np.int64)
        return Block(nothing.astype(np.uint16), nothing, np.zeros(len(low) + 1, dtype=np.int64))
    data = _FOLD[np.frombuffer(low.buffers()[2], np.uint8, size, int(offsets[0]))]
    offsets = offsets - offsets[0]
    before, after = np.empty_like(data), np.empty_like(data)
    before[1:], after[:-1] = data[:-1], data[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    before[edges] = _SPACE
    after[np.append(edges[1:], size) - 1] = _SPACE
    inside = np.flatnonzero(data != _SPACE)
    b, d, a = (x[inside].astype(np.uint32) for x in (before, data, after))
    slots = ((b << 16 | d << 8 | a) * np.uint32(2654435761) >> np.uint32(16)).astype(np.uint16)
    word_start = np.flatnonzero(b == _SPACE)
    return Block(slots, word_start, np.searchsorted(inside[word_start], offsets))


def count_trigrams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang``, ``slot``, ``n`` over all rows that have both a language and a text."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("slot", T.IntegerType()),
                           T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            for start, end, block in _blocks(texts):
                names = sorted(set(langs[start:end]))
                number = np.array([names.index(x) for x in langs[start:end]])
                words = np.diff(block.text_start)
                per_word = np.diff(np.append(block.word_start, len(block.slots)))
                of = np.repeat(np.repeat(number, words), per_word)
                found = np.bincount(of * SLOTS + block.slots, minlength=len(names) * SLOTS).reshape(-1, SLOTS)
                for name, n in zip(names, found):
                    counts[name] = counts[name] + n if name in counts else n
        for name, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], schema=arrow)

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    found = rows.filter("lang is not null and text is not null").mapInArrow(run, schema)
    return found.groupBy("lang", "slot").agg(F.sum("n").alias("n"))


@dataclass
class LanguageModel:
    """Log-likelihoods of the trigram slots by language; SLOTS numbers for each language learned."""

    languages: list[str]
    log_likelihood: np.ndarray   # language x slot


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", smoothing: float = 0.5) -> LanguageModel:
    """Learn from all rows given. The driver receives ``SLOTS`` counts a language at most, whatever the rows."""
    counted = count_trigrams(docs, lang_col, text_col).toPandas()
    languages = sorted(counted["lang"].unique())
    n = np.zeros((len(languages), SLOTS))
    for k, name in enumerate(languages):
        own = counted[counted["lang"] == name]
        n[k, own["slot"]] = own["n"]
    seen = max(1, int((n.sum(axis=0) > 0).sum())) if len(languages) else 1
    # Slots that no language has seen count alike for all of them.
    n += smoothing
    share = np.log(n / (n.sum(axis=1, keepdims=True) - smoothing * (SLOTS - seen)))
    return LanguageModel(languages, share.astype(np.float32))


def proportions(model: LanguageModel, block: Block, rounds: int, penalty: float) -> np.ndarray:
    """Text x language: proportions under the best set; rows of zeros for texts without a word."""
    texts, languages = len(block.text_start) - 1, len(model.languages)
    out = np.zeros((texts, languages))
    if not languages or not len(block.word_start):
        return out
    # Per word: log-likelihood under each language, then relative to the best one.
    words = np.stack([np.add.reduceat(row[block.slots], block.word_start) for row in model.log_likelihood], axis=1)
    best = words.max(axis=1, keepdims=True)
    relative = np.exp(np.maximum(words - best, -30.0))
    counts = np.diff(block.text_start)
    some = np.flatnonzero(counts)
    first = block.text_start[:-1][some]
    counts = counts[some]

    def em(weights: np.ndarray, first: np.ndarray, counts: np.ndarray, allowed: np.ndarray):
        share = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(rounds):
            part = weights * np.repeat(share, counts, axis=0)
            part /= part.sum(axis=1, keepdims=True)
            share = np.add.reduceat(part, first, axis=0) / counts[:, None]
        like = np.log((weights * np.repeat(share, counts, axis=0)).sum(axis=1))
        return share, np.add.reduceat(like, first)

    alone = np.add.reduceat(np.log(relative), first, axis=0)
    share, full = em(relative, first, counts, np.ones((len(some), languages)))
    order = np.argsort(-share, axis=1, kind="stable")
    price = penalty * np.log(counts + 1.0)
    top = alone.argmax(axis=1)
    chosen = np.zeros_like(share)
    chosen[np.arange(len(some)), top] = 1.0
    value = alone.max(axis=1)
    # No set beats one language by more than all of them do: only such texts are looked at again.
    open_ = np.flatnonzero(full - price > value)
    for k in range(2, languages + 1):
        if not len(open_):
            break
        allowed = np.zeros((len(open_), languages))
        np.put_along_axis(allowed, order[open_, :k], 1.0, axis=1)
        rows = np.concatenate([np.arange(f, f + c) for f, c in zip(first[open_], counts[open_])])
        starts = np.cumsum(counts[open_]) - counts[open_]
        part, like = em(relative[rows], starts, counts[open_], allowed)
        gain = like - price[open_] * (k - 1)
        better = gain > value[open_]
        chosen[open_[better]], value[open_[better]] = part[better], gain[better]
        open_ = open_[full[open_] - price[open_] * k > value[open_]]
    out[some] = chosen
    return out


def identify(docs: DataFrame, model: LanguageModel, rounds: int = 6, penalty: float = 3.0, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The id column, ``languages`` (array of (lang, proportion), largest first), ``lang_pred`` and ``score``.

    ``score`` is the largest proportion. Null texts, texts without a letter and
    every text when nothing was learned are ``und`` with score 0 and no
    languages. One output row for each input row; ids may be null or repeat;
    other columns are not read.
    """
    listed = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("proportion", T.DoubleType())]))
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("languages", listed),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            for start, end, found, pred in _predicted(model, batch.column(1), rounds, penalty):
                score = np.where(pred >= 0, found.max(axis=1, initial=0.0), 0.0)
                sets = [
                    sorted(({"lang": names[j], "proportion": float(row[j])} for j in np.flatnonzero(row) if p >= 0),
                           key=lambda x: -x["proportion"]) for row, p in zip(found, pred)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(sets, arrow[1].type),
                     pa.array(names[pred], pa.string()), pa.array(score, pa.float64())], schema=arrow)

    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("row_id", id_col)


def _predicted(model: LanguageModel, texts: pa.Array, rounds: int, penalty: float) -> Iterator[tuple]:
    """(first text, end, proportions, number of the language or -1) over blocks of texts."""
    for start, end, block in _blocks(texts):
        found = proportions(model, block, rounds, penalty)
        pred = np.full(end - start, -1)
        if found.shape[1]:
            pred = np.where(found.max(axis=1) > 0, found.argmax(axis=1), -1)
        # A word needs no letter.
        some = np.flatnonzero(pred >= 0)
        pred[some[~_with_letter(texts.slice(start, end - start), some)]] = -1
        yield start, end, found, pred


def _with_letter(texts: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Whether each of the given rows holds a letter; those without a plain one are looked at one by one."""
    plain = np.asarray(pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False))[rows]
    return np.array([p or any(c.isalpha() for c in texts[int(i)].as_py() or "") for i, p in zip(rows, plain)], dtype=bool)


def keep_identified(docs: DataFrame, model: LanguageModel, rounds: int = 6, penalty: float = 3.0,
                    text_col: str = "text") -> DataFrame:
    """The rows whose language can be told, with all their columns.

    Some language is told of every text with a letter, so only null texts and
    texts without a letter go; proportions and sets of languages decide about
    no row and are not carried on. Where nothing was learned (no label at all,
    say), no language can be told of any text; then the same rows go.
    """
    place = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.string())
            if not shared.value.languages:
                yield batch.filter(pa.array(_with_letter(texts, np.arange(len(texts)))))
                continue
            for start, end, _, pred in _predicted(shared.value, texts, rounds, penalty):
                yield batch.slice(start, end - start).filter(pa.array(pred >= 0))

    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept out of learning, by its id alone; rows without an id are kept out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit_labelled(docs: DataFrame) -> LanguageModel:
    return fit(docs.filter(~held_out()))
