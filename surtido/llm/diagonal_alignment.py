"""Alignment of two tokenizers' tokens over the same texts by diagonal run skipping.

Both token sequences of a text end at byte offsets. While tokens match one to
one, the two arrays of ends agree at a constant index shift: probes of doubling
length jump such a stretch, and halving ones find where it ends. An irregular
group is walked token by token to the next common end; its links and the new
shift come from that walk.

How often an id pair is linked is counted over the corpus. Documents lie in
stored blocks of bounded size with their distinct pairs, so only those pairs,
and not the links, meet the counts by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import pickle
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from surtido.llm.bpe_automaton import _byte_symbols
from surtido.llm.common import arrow_batch, kept_by_worker, map_rows, settled, stored_blocks, struct_of, whole_text
from surtido.llm.packing import SPLIT_PATTERN
from surtido.session import materialize

_NO_BYTES = b"\xff"  # of ids that stand for no text: in no UTF-8
_B_BITS = 32  # a pair of ids is one long: the A id above the B id


def _numbers(values: list[int] | array) -> np.ndarray:
    return np.frombuffer(array("q", values), dtype=np.int64)


class ByteTokenizer:
    """A byte-level BPE file: ids of a text, special tokens' strings being plain text, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._path, self._library, self._fast = path, None, None
        vocab = spec["model"]["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        byte = {symbol: b for b, symbol in _byte_symbols().items()}
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes = [_NO_BYTES] * size
        for token, i in vocab.items():
            if token not in special:
                self.bytes[i] = bytes(byte[ord(c)] for c in token)
        self.lengths = np.array([len(b) for b in self.bytes])
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        before = spec.get("pre_tokenizer") or {}
        if (before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
                and not spec.get("normalizer")
                and [vocab[a + b] for a, b in merges] == list(range(256, 256 + len(merges)))):
            # A merge's place is its token's place: the vocabulary alone says what merges first.
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.bytes) if b != _NO_BYTES}
            self._fast = tiktoken.Encoding("file", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self._fast is not None:
            try:
                return self._fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            except ValueError:  # runs of a million blanks are too much for its expression
                pass
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
            self._library.no_truncation()
            self._library.no_padding()
            self._library.encode_special_tokens = True
        return _numbers(self._library.encode(text, add_special_tokens=False).ids)


class PieceTokenizer:
    """A sentencepiece model: ids of a text and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        for i in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(i)
            if self._model.is_control(i) or self._model.is_unknown(i) or self._model.is_unused(i):
                self.bytes.append(_NO_BYTES)
            elif self._model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes.append(piece.replace("▁", " ").encode())
        self.lengths = np.array([len(b) for b in self.bytes])

    def encode(self, text: str) -> np.ndarray:
        return _numbers(self._model.encode(text, num_threads=1))


def _ends(ids: np.ndarray, tokenizer: ByteTokenizer | PieceTokenizer, raw: bytes) -> list[int] | None:
    """Byte offsets at which the tokens end, or None where their bytes joined are not ``raw``."""
    table = tokenizer.bytes
    if b"".join([table[i] for i in ids.tolist()]) != raw:
        return None
    return np.cumsum(tokenizer.lengths[ids]).tolist()


def diagonal_runs(ea: list[int], eb: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one-to-one tokens, and the links of all irregular groups as two arrays of token places.

    A stretch (i, j, k) starts at a common end, after i A and j B tokens, and
    goes on to A token k; between two stretches lies one irregular group. The
    last one ends where both do.
    """
    n = len(ea)
    ea, eb = [*ea, -1], [*eb, -2]  # two ends that agree with nothing
    runs, la, lb = [], [], []
    i = j = 0
    while True:
        runs.append(i)
        runs.append(j)
        if ea[i] == eb[j]:
            i += 1
            j += 1
            step = 1
            while ea[i : i + step] == eb[j : j + step]:
                i += step
                j += step
                step *= 2
            while step > 1:
                step >>= 1
                if ea[i : i + step] == eb[j : j + step]:
                    i += step
                    j += step
        runs.append(i)
        if i == n:
            break
        x, y = ea[i], eb[j]
        la.append(i)
        lb.append(j)
        while x != y:
            if x < y:
                i += 1
                x = ea[i]
            else:
                j += 1
                y = eb[j]
            la.append(i)
            lb.append(j)
        i += 1
        j += 1
    return _numbers(runs).reshape(-1, 3), _numbers(la), _numbers(lb)


def _stretched(runs: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """A and B places of every stretch, ``extra`` more of each than it has tokens."""
    counts = runs[:, 2] - runs[:, 0] + extra
    total = np.cumsum(counts)
    within = np.arange(total[-1])
    before = total - counts
    return within + np.repeat(runs[:, 0] - before, counts), within + np.repeat(runs[:, 1] - before, counts)


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to size - 1 as the bytes of a number, and the shift that puts a byte behind them."""
    texts = [str(i).encode() for i in range(size)]
    if len(texts[-1]) > 7:
        raise ValueError(f"vocabulary of {size} ids")
    packed = np.frombuffer(b"".join(t.ljust(8, b"\0") for t in texts), "<u8")
    return packed, np.array([8 * len(t) for t in texts], dtype=np.uint64)


def _groups_text(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, digits) -> bytes:
    """``a1,a2|b1;a3|b2,b3`` from the ids and the groups' bounds (0 first) in tokens."""
    packed, shifts = digits
    at_a = np.arange(len(a)) + np.repeat(ends_b[:-1], np.diff(ends_a))
    at_b = np.arange(len(b)) + np.repeat(ends_a[1:], np.diff(ends_b))
    ids = np.empty(len(a) + len(b), dtype=np.int64)
    ids[at_a], ids[at_b] = a, b
    after = np.full(len(ids), ord(","), dtype=np.uint64)
    after[at_a[ends_a[1:] - 1]] = ord("|")
    after[at_b[ends_b[1:] - 1]] = ord(";")
    cells = (packed[ids] | after << shifts[ids]).view(np.uint8)
    return cells[cells != 0].tobytes()[:-1]


def align(text: str, first: ByteTokenizer, second: PieceTokenizer, digits) -> tuple[int, int, int, str, np.ndarray]:
    """A and B tokens, groups, hash of the groups, and the links as pair codes, of one text."""
    nothing = 0, 0, 0, "", np.empty(0, dtype=np.int64)
    if not text:
        return nothing
    raw = b" " + text.encode()
    b = second.encode(text)
    eb = _ends(b, second, raw)
    if eb is None:
        return nothing
    a = first.encode(" " + text)
    ea = _ends(a, first, raw)
    if ea is None:
        return nothing
    runs, la, lb = diagonal_runs(ea, eb)
    one_a, one_b = _stretched(runs, 0)
    at_a, at_b = np.concatenate([one_a, la]), np.concatenate([one_b, lb])
    ends_a, ends_b = _stretched(runs, 1)
    sha = hashlib.sha256(_groups_text(a, b, ends_a, ends_b, digits)).hexdigest()
    return len(a), len(b), len(ends_a) - 1, sha, (a[at_a] << _B_BITS) | b[at_b]


def aligned_blocks(docs: DataFrame, byte_path: str, piece_path: str, links_each: int, id_col: str, text_col: str) -> DataFrame:
    """Documents in blocks of about ``links_each`` links: the block's distinct pairs in order with how often each is
    linked, and ``told``, the documents' own values and the place of each link's pair, document after document."""
    schema = struct_of(block="long", pair="array<long>", n="array<int>", told="binary")

    def rows(taken: Iterator[tuple]) -> Iterator[tuple]:
        first = kept_by_worker(("bytes of ids", byte_path), lambda: ByteTokenizer(byte_path))
        second = kept_by_worker(("pieces", piece_path), lambda: PieceTokenizer(piece_path))
        size = max(len(first.bytes), len(second.bytes))
        digits = kept_by_worker(("digits", size), lambda: _digits(size))
        block, held, links, count = TaskContext.get().partitionId() << 32, [], [], 0

        def packed() -> tuple:
            place, pairs = pd.factorize(np.concatenate(links))  # by hash; sorting all links costs far more
            order = np.argsort(pairs)
            rank = np.empty(len(order), dtype="<i4")
            rank[order] = np.arange(len(order))
            n = np.bincount(place, minlength=len(order))[order]
            return block, pairs[order].tolist(), n.tolist(), pickle.dumps((held, rank[place].tobytes()))

        for doc_id, text in taken:
            *counts, sha, codes = align(text, first, second, digits)
            held.append((doc_id, *counts, sha, len(codes)))
            links.append(codes)
            count += len(codes)
            if count >= links_each or len(held) >= 1 << 16:
                yield packed()
                block, held, links, count = block + 1, [], [], 0
        if held:
            yield packed()

    return map_rows(docs.select(F.col(id_col).cast("long"), whole_text(text_col)), rows, schema,
                    batch_bytes=1 << 20)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair``, ``count`` over the corpus, and ``best``: no pair with the same B id is linked more often."""
    counted = (
        blocks.select(F.inline(F.arrays_zip("pair", "n"))).groupBy("pair").agg(F.sum("n").alias("count")))
    # The rows of one B id are at most as many as there are A ids.
    same_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1)))
    return counted.withColumn("best", F.col("count") == F.max("count").over(same_b))


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str, links_each: int = 1 << 18,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How two tokenizers' tokens lie over each other, one row for each input row.

    A are the tokens of a space and the text by the byte-level file, B those of
    the text by the piece model, which adds the space; strings of special tokens
    are plain text. Columns: the id, ``n_a``, ``n_b`` (tokens), ``n_groups``
    (cut where both end), ``n_links`` (A and B tokens that overlap), ``n_best``
    (links whose pair of ids is, over the corpus, the most frequent of its B
    id, ties included), ``count_sum`` (over links, how often their pair is
    linked in the corpus) and ``groups_sha256``.

    Null and empty texts, and texts whose tokens do not join to a space and the
    text (a text with U+2581), have no tokens: zeros and an empty hash. Repeated
    rows and rows with a null id count each; other columns are not read; an
    empty table gives an empty table.
    """
    return settled(docs.sparkSession, "aligned", lambda: _aligned(docs, byte_path, piece_path, links_each, id_col, text_col))


def _aligned(docs: DataFrame, byte_path: str, piece_path: str, links_each: int, id_col: str, text_col: str) -> DataFrame:
    blocks = stored_blocks(aligned_blocks(docs, byte_path, piece_path, links_each, id_col, text_col), "aligned_blocks")
    counts = materialize(pair_counts(blocks), "pair_counts")
    # Every block gets the counts of its own pairs, in the order of its pairs: first the block, then its pairs, one
    # after the other, so that no task holds the pairs of more than one block, however many blocks it has.
    wanted = blocks.select("block", F.explode("pair").alias("pair"))
    packed = (2 * F.col("count") + F.col("best").cast("long")).alias("packed")
    pairs = wanted.join(counts, "pair").select("block", "pair", packed, F.lit(None).cast("binary").alias("told"))
    nothing = F.lit(None).cast("long")
    heads = blocks.select("block", nothing.alias("pair"), nothing.alias("packed"), "told")
    sent = heads.unionByName(pairs).repartition("block").sortWithinPartitions("block", F.asc_nulls_first("pair"))
    schema = struct_of(doc_id="long", n_a="long", n_b="long", n_groups="long", n_links="long", n_best="long",
                       count_sum="long", groups_sha256="string")
    done = sent.select("packed", "told").mapInArrow(_totals(schema), schema)
    return done.withColumnRenamed("doc_id", id_col)


def _totals(schema: T.StructType):
    """Rows of the documents, from blocks that are each followed by the counts of their pairs."""
    arrow = to_arrow_schema(schema)

    def rows(told: bytes, packed: list[np.ndarray]) -> list[tuple]:
        held, links = pickle.loads(told)
        place, numbers = np.frombuffer(links, "<i4"), np.concatenate([*packed, np.empty(0, dtype=np.int64)])
        count, best, found, at = numbers >> 1, numbers & 1, [], 0
        for doc_id, n_a, n_b, n_groups, sha, n_links in held:
            mine = place[at : at + n_links]
            at += n_links
            found.append((doc_id, n_a, n_b, n_groups, n_links, int(best[mine].sum()), int(count[mine].sum()), sha))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, packed = None, []
        for batch in batches:
            heads = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False)).tolist()
            numbers = batch.column(0).fill_null(0).to_numpy()
            for start, end in zip([0, *(h + 1 for h in heads)], [*heads, batch.num_rows]):
                packed.append(numbers[start:end].copy())
                if end < batch.num_rows:  # the next block begins
                    if told is not None:
                        yield arrow_batch(rows(told, packed), arrow)
                    told, packed = batch.column(1)[end].as_py(), []
        if told is not None:
            yield arrow_batch(rows(told, packed), arrow)

    return run
