"""Secret scanning behind a trigram index.

Every rule's regular expression yields a Boolean query over trigrams that each
of its matches must hold (ASCII letters in lower case). The texts of a block
are indexed once: for every trigram that some rule asks for, the list of texts
that hold it. A rule's query intersects and unites these lists, and only the
texts that remain are searched with the expression itself. A rule from which
no trigram follows searches all texts. Blocks are pieces of Spark's own
partitions, so texts never move and no list grows beyond a block.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from surtido.llm.common import kept_by_worker


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of an ASCII ``pattern`` whose ``group`` has ``least`` bytes or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # shorter runs could only be dropped
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"(?:gh[pousr]_|github_pat_)[A-Za-z0-9_]{30,}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}"),
    # From the start of a run only: from every eyJ inside one, a long run would be read over and over.
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES

# A query is True (no condition), a trigram, or ("and" | "or", frozenset of queries).
_MOST_STRINGS = 64


def trigram_query(pattern: str):
    """The Boolean trigram query that every match of ``pattern`` satisfies."""
    strings, query = _of_sequence(sre_parser.parse(pattern.encode("ascii")))
    return query if strings is None else _and([query, _of_strings(strings)])


def _and(parts):
    parts = frozenset(p for p in parts if p is not True)
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", parts)


def _or(parts):
    parts = frozenset(parts)
    return True if True in parts else next(iter(parts)) if len(parts) == 1 else ("or", parts)


def _of_strings(strings: set[str]):
    return _or([_and([s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _of_sequence(nodes) -> tuple[set[str] | None, object]:
    """(all strings it can match, or None if too many; the query of what is not in them)."""
    run, whole, found = {""}, True, []
    for kind, value in nodes:
        strings, query = _of_node(kind, value)
        found.append(query)
        if strings is not None and len(run) * len(strings) <= _MOST_STRINGS:
            run = {a + b for a in run for b in strings}
        else:
            inner = _repeated(kind, value)
            if inner and len(run) * len(inner) <= _MOST_STRINGS:
                run = {a + b for a in run for b in inner}
            found.append(_of_strings(run))
            run, whole = strings or inner or {""}, False
    if not whole:
        found.append(_of_strings(run))
    return (run if whole else None), _and(found)


def _repeated(kind, value) -> set[str] | None:
    """The strings that stand at both ends of what is repeated once or more."""
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] > 0:
        return _of_sequence(value[2])[0]
    return None


def _of_node(kind, value) -> tuple[set[str] | None, object]:
    if kind is sre.LITERAL:
        return {chr(value).lower()}, True
    if kind is sre.IN:
        chars = set()
        for k, v in value:
            if k is sre.LITERAL:
                chars.add(chr(v).lower())
            elif k is sre.RANGE and v[1] - v[0] < 8:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= 8 else (None, True)
    if kind is sre.SUBPATTERN:
        return _of_sequence(value[3])
    if kind is sre.BRANCH:
        parts = [_of_sequence(p) for p in value[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= _MOST_STRINGS:
            return set().union(*(s for s, _ in parts)), True
        return None, _or([q if s is None else _and([q, _of_strings(s)]) for s, q in parts])
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = value
        strings, query = _of_sequence(inner)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, True
        if least == most and strings is not None and len(strings) ** least <= _MOST_STRINGS:
            out = {""}
            for _ in range(least):
                out = {a + b for a in out for b in strings}
            return out, True
        if least == 0:
            return None, True
        return None, query if strings is None else _and([query, _of_strings(strings)])
    if kind is sre.AT:
        return {""}, True
    return None, True


def _trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


class BlockScanner:
    """Indexes blocks of texts and finds the spans of all rules in them."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern.encode("ascii")), trigram_query(r.pattern)) for r in rules]
        self.trigrams = sorted(set().union(*(_trigrams(q) for _, _, q in self.rules)))
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32
        self.pairs = np.zeros(1 << 16, dtype=bool)
        codes = [int.from_bytes(t.encode("ascii"), "big") for t in self.trigrams]
        for code in codes:
            self.pairs[code >> 8] = True
        self.codes = np.array(codes, dtype=np.int64)

    def index(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """Trigram -> sorted numbers of the texts that hold it."""
        if len(data) < 3 or not self.trigrams:
            return {}
        low = self.fold[data]
        at = np.flatnonzero(self.pairs[low[:-2].astype(np.uint16) << 8 | low[1:-1]])
        code = low[at].astype(np.int64) << 16 | low[at + 1].astype(np.int64) << 8 | low[at + 2]
        which = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        real = self.codes[which] == code
        at, which = at[real], which[real]
        text = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[text + 1]
        texts = len(offsets) - 1
        held = np.unique(which[inside] * texts + text[inside])
        cuts = np.searchsorted(held, np.arange(len(self.codes) + 1) * texts)
        return {t: held[cuts[i] : cuts[i + 1]] - i * texts for i, t in enumerate(self.trigrams)}

    def candidates(self, query, postings: dict[str, np.ndarray], texts: int) -> np.ndarray:
        if query is True:
            return np.arange(texts)
        if isinstance(query, str):
            return postings.get(query, np.empty(0, dtype=np.int64))
        parts = sorted((self.candidates(q, postings, texts) for q in query[1]), key=len)
        out = parts[0]
        for part in parts[1:]:
            out = np.intersect1d(out, part, assume_unique=True) if query[0] == "and" else np.union1d(out, part)
        return out

    def spans(self, data: bytes, offsets: np.ndarray) -> dict[int, list[tuple[int, int, str]]]:
        """Text number -> (start, end, kind) in code points, by start, then in the order of the rules."""
        texts = len(offsets) - 1
        postings = self.index(np.frombuffer(data, np.uint8), offsets)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k, (rule, pattern, query) in enumerate(self.rules):
            for i in self.candidates(query, postings, texts).tolist():
                for m in pattern.finditer(data[offsets[i] : offsets[i + 1]]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found.setdefault(i, []).append((m.start(), k, m.end()))
        out = {}
        for i, rows in found.items():
            text = data[offsets[i] : offsets[i + 1]]
            place = _code_points(text, sorted({x for r in rows for x in (r[0], r[2])}))
            out[i] = [(place[s], place[e], self.rules[k][0].kind) for s, k, e in sorted(rows)]
        return out


def _code_points(text: bytes, places: list[int]) -> dict[int, int]:
    if text.isascii():
        return {p: p for p in places}
    out, at, count = {}, 0, 0
    for p in places:
        count += len(text[at:p].decode("utf-8"))
        out[p], at = count, p
    return out


def _blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[tuple]:
    """(block of whole rows, its texts as one piece of bytes, their offsets); a null is empty."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8))
        start = 0
        while start < len(texts):
            end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start : start + 4096]), most)))
            part = texts.slice(start, end - start)
            values = part.fill_null(b"")
            at = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
            data = values.buffers()[2].slice(at[0], at[-1] - at[0]).to_pybytes() if at[-1] > at[0] else b""
            yield batch.slice(start, end - start), data, at - at[0]
            start = min(end, len(texts))


_SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The id column and ``spans``: array of (start, end, kind), in code points, end exclusive.

    Sorted by start, then by the order of the rules. One output row for each
    input row: null and empty texts have an empty array, repeated rows and null
    ids stay, other columns are not read, an empty table gives an empty table.
    """
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("spans", _SPANS)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = kept_by_worker(("secrets", rules), lambda: BlockScanner(rules))
        for rows, data, offsets in _blocks(batches, "text"):
            spans = scanner.spans(data, offsets)
            listed = [[{"start": s, "end": e, "kind": k} for s, e, k in spans.get(i, ())] for i in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(listed, arrow[1].type)], schema=arrow)

    found = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text"))
    return found.mapInArrow(run, schema).withColumnRenamed("row_id", id_col)


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]",
                 text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span of a secret replaced by ``mask``.

    Overlapping and touching spans become one mask. Null texts stay null, empty
    ones empty; repeated rows stay, each masked alike; ids are not read; columns
    may have any names; an empty table gives an empty table.
    """
    place = docs.columns.index(text_col)
    arrow = to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = kept_by_worker(("secrets", rules), lambda: BlockScanner(rules))
        for rows, data, offsets in _blocks(batches, f"c{place}"):
            texts = rows.column(place)
            spans = scanner.spans(data, offsets)
            if spans:
                plain = texts.to_pylist()
                for i, found in spans.items():
                    plain[i] = _masked(plain[i], found, mask)
                texts = pa.array(plain, arrow[place].type)
            columns = [texts if i == place else c for i, c in enumerate(rows.columns)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(run, docs.schema)


def _masked(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    out, done = [], 0
    for start, end, _ in spans:
        if start > done or not out:
            out += [text[done:start], mask]
        done = max(done, end)
    return "".join([*out, text[done:]])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(scanned: DataFrame) -> DataFrame:
    """The check columns of ``scan_secrets``' rows."""
    kinds = [r.kind for r in BASE_RULES]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = _joined(F.filter("spans", lambda s: s["kind"].isin(*kinds)))
    return scanned.select(
        "doc_id", *map(count, kinds), F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"))
