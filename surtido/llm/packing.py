"""Packing by concatenation and cutting: prefix sums give every document its global place.

First pass: each partition tokenizes its documents once and stores their ids
with the count of ids before them in the partition. The partition totals, one
small row each, become partition offsets by a running sum. Second pass: every
document knows its global place and is cut where a sequence of fixed length
ends; a piece that begins or ends at a cut is a boundary record like any other
and says where it lies in its document and in its sequence.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surtido.llm.bpe_automaton import _byte_symbols
from surtido.llm.common import kept_by_worker, map_rows, struct_of, whole_text
from surtido.session import materialize

# Fixed value: how byte-level tokenizer files of this kind split a text.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_level_encoder(path: str):
    """Text -> numpy ids, as the ``tokenizers`` library gives them for this file.

    Where a merge's place in the list is its token's place in the vocabulary,
    the vocabulary alone says what merges first, and ``tiktoken`` gives the same
    ids several times as fast; other byte-level files go to ``tokenizers``, and
    so do texts that ``tiktoken`` refuses (a run of a million blanks is too much
    for its expression).
    """
    library = None

    def by_library(text: str) -> np.ndarray:
        nonlocal library
        if library is None:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
        return np.array(library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    before = spec.get("pre_tokenizer") or {}
    plain = (
        before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        and not spec.get("normalizer") and not spec["model"].get("end_of_word_suffix")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
        and [vocab[a + b] for a, b in merges] == list(range(256, 256 + len(merges)))
    )
    if plain:
        import tiktoken

        byte = {symbol: b for b, symbol in _byte_symbols().items()}
        ranks = {bytes(byte[ord(c)] for c in t): i for t, i in vocab.items() if t not in special}
        encoding = tiktoken.Encoding("file", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> np.ndarray:
            try:
                return encoding.encode_to_numpy(text, allowed_special="all")
            except ValueError:
                return by_library(text)

        return encode
    return by_library


def token_runs(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Stored: ``part``, ``before`` (ids before the document in its partition), ``doc_id``, ``n``, ``ids``."""
    schema = struct_of(part="int", before="long", doc_id="long", n="long", ids="binary")

    def rows(taken: Iterator[tuple]) -> Iterator[tuple]:
        encode = kept_by_worker(("bytes", tokenizer_path), lambda: byte_level_encoder(tokenizer_path))
        part, before = TaskContext.get().partitionId(), 0
        for doc_id, text in taken:
            ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
            yield part, before, doc_id, len(ids), _narrow(ids)
            before += len(ids)

    found = map_rows(docs.select(F.col(id_col).cast("long"), whole_text(text_col)), rows, schema)
    return materialize(found, "token_runs")


def _narrow(ids: np.ndarray) -> bytes:
    """The ids in two bytes each where they fit, marked by the first byte."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65536 else b"\x04" + ids.tobytes()


def _wide(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<u2" if stored[0] == 2 else "<u4", offset=1).astype("<u4")


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, with_ids: bool = True,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids; all but the last sequence are full.

    One row per piece: ``doc_id``, ``start`` (ids of its document before it),
    ``length``, ``ids_crc32`` (over little-endian 32-bit ids), ``doc_tokens``
    (with the end id), ``sequence_id``, ``offset``, ``padded_to`` (the length of
    its sequence with padding: ``length``, or for a shorter last sequence the
    next power of two) and, if asked for, ``ids`` (binary, little-endian 32-bit).

    Null and empty texts are documents of the end id alone; repeated rows and
    rows with a null id are documents of their own; an empty table has no
    pieces; other columns are not read. Documents follow one another in the
    order in which the input is read.
    """
    runs = token_runs(docs, tokenizer_path, end_id, id_col, text_col)
    totals = runs.groupBy("part").agg(F.sum("n").alias("n_part"))
    # One row for each partition of the input, so the running sum and the broadcast stay small.
    up_to = Window.orderBy("part")
    places = totals.select(
        "part",
        (F.sum("n_part").over(up_to) - F.col("n_part")).alias("base"),
        F.sum("n_part").over(up_to.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    placed = runs.join(F.broadcast(places), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("place"), "total", "ids")
    kinds = dict(doc_id="long", start="long", length="long", ids_crc32="long", doc_tokens="long",
                 sequence_id="long", offset="long", padded_to="long")
    schema = struct_of(**kinds, **({"ids": "binary"} if with_ids else {}))

    def rows(taken: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, place, total, stored in taken:
            ids = _wide(stored)
            full, rest = divmod(total, length)
            short = min(length, 1 << (rest - 1).bit_length()) if rest else length
            at = 0
            while at < len(ids):
                sequence, offset = divmod(place + at, length)
                piece = ids[at : at + length - offset].tobytes()
                n = len(piece) // 4
                yield (doc_id, at, n, zlib.crc32(piece), len(ids), sequence, offset,
                       length if sequence < full else short, *([piece] if with_ids else []))
                at += n

    return map_rows(placed, rows, schema)
