"""BPE encoding by a deterministic automaton over tokens, and decoding by its arc labels.

The automaton accepts exactly the correct tokenizations. It starts as one
state with a loop for every base symbol. Each merge (u, v) -> w is one gadget:
the state that u leads to loses its v arc, and wherever u can be read, w can
now be read as well, leading to a copy of the state that v leads to. So a
state belongs to a token: it is the state of the token's right part as it was
at the merge, less the arcs lost since; and an arc of w leaves a state if the
arc of u did at the time of the merge. Rows of the transition table are filled
by these rules when they are first used.

A prefix of a correct tokenization is the correct tokenization of that prefix,
so every position of a word is reached by one path at most. Encoding takes the
longest arc first and marks positions from which the end cannot be reached.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from surtido.llm.common import kept_by_worker, map_rows, struct_of, whole_text

_END = "\ue000"  # stands for the end-of-word suffix inside the automaton
_NEVER = 1 << 60


class MergeAutomaton:
    """The automaton of a merge list over tokens 0..n-1 (base symbols have no merge)."""

    def __init__(self, n_tokens: int, merges: list[tuple[int, int, int]]):
        self.left, self.right, self.rank = [-1] * n_tokens, [-1] * n_tokens, [_NEVER] * n_tokens
        self.lost: dict[int, int] = {}        # state << 24 | token: the merge that took the arc
        self.reachable = [True] * n_tokens
        self._table: dict[int, dict[int, bool]] = {}
        self._filled = 0
        for _, _, w in merges:
            self.reachable[w] = False
        for r, (u, v, w) in enumerate(merges):
            if self.left[w] >= 0:
                raise ValueError(f"two merges make token {w}")
            self.left[w], self.right[w], self.rank[w] = u, v, r
            # Where v can no longer follow u, the merge never applies.
            if self.reachable[u] and self.reachable[v] and self._has(u, v):
                self.reachable[w] = True
                self.lost[u << 24 | v] = r

    def _lost_at(self, state: int, token: int) -> int:
        found, until, lost = _NEVER, _NEVER, self.lost
        while state >= 0:
            at = lost.get(state << 24 | token, _NEVER)
            if at < until and at < found:
                found = at
            if self.rank[state] < until:
                until = self.rank[state]
            state = self.right[state]
        return found

    def _has(self, state: int, token: int) -> bool:
        until = _NEVER
        while True:
            at = self._lost_at(state, token)
            if at < _NEVER and at <= until:
                return False
            if self.left[token] < 0:
                return True
            until, token = self.rank[token], self.left[token]

    def arcs_of(self, state: int) -> dict[int, bool]:
        """The part filled so far of the transition table's row for ``state`` (-1: the start)."""
        row = self._table.get(state)
        if row is None:
            if self._filled >= 1_500_000:   # bounds the memory; rows fill again as they are used
                self._table.clear()
                self._filled = 0
            row = self._table[state] = {}
        return row

    def follows(self, token: int, state: int) -> bool:
        """Whether an arc of ``token`` leaves ``state``."""
        known = self.reachable[token] and (state < 0 or self._has(state, token))
        self.arcs_of(state)[token] = known
        self._filled += 1
        return known


class _Recent:
    """A store of bounded size: when the newer half is full, the older half goes."""

    def __init__(self, half: int):
        self.half, self.new, self.old = half, {}, {}

    def older(self, key):
        return self.old.get(key)

    def get(self, key):
        return self.new.get(key) or self.old.get(key)

    def put(self, key, value) -> None:
        if len(self.new) >= self.half:
            self.old = dict(self.new)
            self.new.clear()  # the same object: callers hold its get
        self.new[key] = value


class WordTokenizer:
    """Normalises, splits and encodes as the tokenizer file says; supports the file kind
    "NFC, one space, lower case, split by pattern, byte symbols, BPE with a word-end suffix".

    Character tables differ from one Unicode version to the next, so text that is
    not ASCII goes through the file's own normaliser and pre-tokeniser; the words
    that they give are encoded by the automaton, as all others.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] \
                or spec.get("decoder") or not suffix:
            raise ValueError(f"{path}: a tokenizer file of another kind")
        self.split = regex.compile(steps[0]["pattern"]["Regex"])
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str
        self.pre_split = library.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        vocab = model["vocab"]
        self.labels = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, i in [*vocab.items(), *self.special.items()]:
            self.labels[i] = text
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = MergeAutomaton(
            len(self.labels), [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        base = {v for v in vocab.values() if v not in self.special.values()}
        self.arcs: dict[str, int] = {}
        for text, i in vocab.items():
            if i in base:
                self.arcs[text[: -len(suffix)] + _END if text.endswith(suffix) and text != suffix else text] = i
        self.reach: dict[str, int] = {}     # longest arc by its first three symbols
        for text in self.arcs:
            if len(text) > 2:
                self.reach[text[:3]] = max(self.reach.get(text[:3], 0), len(text))
        self.symbol = _byte_symbols()
        self._chunks, self._words = _Recent(250_000), _Recent(200_000)

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-split word, given in byte symbols."""
        text = word + _END
        end, arcs, reach, known_arcs = len(text), self.arcs, self.reach, self.automaton.arcs_of
        follows = self.automaton.follows
        at, path, tried, dead, state = 0, [], [], set(), -1
        row, size = known_arcs(-1), reach.get(text[:3], 2)
        while True:
            while size > 0:
                token = arcs.get(text[at : at + size])
                if token is not None and at + size not in dead:
                    good = row.get(token)
                    if good or good is None and follows(token, state):
                        break
                size -= 1
            if size > 0:
                path.append(token)
                tried.append(size)
                at += size
                if at >= end:
                    return path
                size = reach.get(text[at : at + 3], 2)
                if at + size > end:
                    size = end - at
            elif path:
                dead.add(at)
                path.pop()
                size = tried.pop()
                at -= size
                size -= 1
            else:
                raise ValueError(f"no tokenization of {word!r}")
            state = path[-1] if path else -1
            row = known_arcs(state)

    def _word(self, word: str) -> bytes:
        ids = self._words.get(word)
        if ids is None:
            found = self.encode_word(word)
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(word) <= 64:
                self._words.put(word, ids)
        return ids

    def _split(self, chunk: str) -> list[str]:
        """Words of text without white space, in byte symbols."""
        if not chunk.isascii():
            return [word for word, _ in self.pre_split(self.normalise(chunk))]
        plain = chunk.lower()
        if plain.isalpha():
            return [plain]
        return [word.translate(self.symbol) for word in self.split.findall(plain)]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of text without white space, packed as little-endian 32-bit integers."""
        ids = self._chunks.older(chunk)
        if ids is None:
            words = self._split(chunk)
            ids = self._word(words[0]) if len(words) == 1 else b"".join(map(self._word, words))
        if len(chunk) <= 64:
            self._chunks.put(chunk, ids)
        return ids

    def encode(self, text: str) -> bytes:
        if self.special_at and "<|" in text and self.special_at.search(text):
            out, at = [], 0
            for m in self.special_at.finditer(text):
                out += [self._encode_plain(text[at : m.start()]), struct.pack("<I", self.special[m[0]])]
                at = m.end()
            return b"".join([*out, self._encode_plain(text[at:])])
        return self._encode_plain(text)

    def _encode_plain(self, text: str) -> bytes:
        # split() also cuts at the four separators 1C to 1F, which are no white space to the pattern.
        chunks = _SPACE.split(text) if _SEPARATOR.search(text) else text.split()
        known, chunk = self._chunks.new.get, self._chunk
        return b"".join([known(c) or chunk(c) for c in chunks if c])

    def decode(self, ids) -> str:
        """Labels of the arcs, with spaces between (the file names no decoder)."""
        return " ".join(map(self.labels.__getitem__, ids))


_SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATOR = regex.compile("[\x1c-\x1f]")


def _byte_symbols() -> dict[int, int]:
    """Byte -> printable code point: printable Latin-1 bytes stand for themselves, the rest follow from 256."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {**{b: b for b in own}, **{b: 256 + i for i, b in enumerate(rest)}}


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text and the text that its ids decode to.

    Columns: the id column, ``ids`` (binary: little-endian unsigned 32-bit
    integers, so a document of any length is one compact value) and ``decoded``.
    One output row for each input row: null and empty texts give no ids and an
    empty decoded text, repeated rows and null ids are kept as they are, other
    columns of the input are not read. Special tokens written out in a text
    become their ids. An empty table gives an empty table.
    """
    schema = struct_of(**{"row_id": "long", "ids": "binary", "decoded": "string"})

    def rows(taken: Iterator[tuple]) -> Iterator[tuple]:
        tok = kept_by_worker(("bpe", tokenizer_path), lambda: WordTokenizer(tokenizer_path))
        for row_id, text in taken:
            ids = tok.encode(text)
            yield row_id, ids, tok.decode(memoryview(ids).cast("I"))

    found = map_rows(docs.select(F.col(id_col).cast("long"), whole_text(text_col)), rows, schema)
    return found.withColumnRenamed("row_id", id_col)


def digests(coded: DataFrame) -> DataFrame:
    """The check columns of ``bpe_round_trip``'s rows."""
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
