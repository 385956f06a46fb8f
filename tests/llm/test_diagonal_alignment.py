"""Alignment of two tokenizers against all pairs of tokens of each text."""

import hashlib
import pickle
import random
from collections import Counter, defaultdict

import numpy as np
import odd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import types as T
from tokenizers import Tokenizer

from surtido.llm import diagonal_alignment
from surtido.llm.bpe_automaton import _byte_symbols
from surtido.llm.diagonal_alignment import ByteTokenizer, PieceTokenizer, _stretched, align_tokenizers, diagonal_runs

BYTES, PIECES = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def spans(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


class Plain:
    def __init__(self):
        self.first = Tokenizer.from_file(BYTES)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        self.byte = {chr(symbol): b for b, symbol in _byte_symbols().items()}

    def tokens(self, text):
        """A ids, B ids, groups, links of a text, or None."""
        if not text:
            return None
        a = self.first.encode(" " + text, add_special_tokens=False).ids
        b = self.second.encode(text)
        parts_a = [bytes(self.byte[c] for c in self.first.id_to_token(i)) for i in a]
        parts_b = []
        for i in b:
            piece = self.second.id_to_piece(i)
            parts_b.append(bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode())
        raw = (" " + text).encode()
        if b"".join(parts_a) != raw or b"".join(parts_b) != raw:
            return None
        at_a, at_b = spans(parts_a), spans(parts_b)
        cuts = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups, low = [], 0
        for high in cuts:
            groups.append(tuple([i for i, (s, e) in zip(ids, at) if low <= s and e <= high] for ids, at in ((a, at_a), (b, at_b))))
            low = high
        links, k = [], 0
        for i, (s, e) in zip(a, at_a):
            while k and at_b[k - 1][1] > s:
                k -= 1
            while k < len(b) and at_b[k][0] < e:
                if at_b[k][1] > s:
                    links.append((i, b[k]))
                k += 1
        return a, b, groups, links


def compare(spark, docs, **options):
    plain, rows = Plain(), docs.select("doc_id", "text").collect()
    told = [plain.tokens(r.text) for r in rows]
    count = Counter(x for t in told if t for x in t[3])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    wanted = []
    for r, t in zip(rows, told):
        key = (r.doc_id is None, r.doc_id)
        if t is None:
            wanted.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = t
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        wanted.append((key, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links),
                       sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    found = align_tokenizers(docs, BYTES, PIECES, **options)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(((r.doc_id is None, r.doc_id), *r[1:]) for r in found.collect()) == sorted(wanted)
    return wanted


def test_runs_against_all_pairs():
    rng = random.Random(1)
    for _ in range(2000):
        n, p, q = rng.randint(1, 60), rng.random(), rng.random()
        x, y = (sorted({i for i in range(1, n) if rng.random() < share} | {n}) for share in (p, q))
        runs, la, lb = diagonal_runs(x, y)
        ends_a, ends_b = _stretched(runs, 1)
        assert [x[k - 1] for k in ends_a[1:]] == [y[k - 1] for k in ends_b[1:]] == sorted(set(x) & set(y))
        one_a, one_b = _stretched(runs, 0)
        links = sorted([*zip(one_a.tolist(), one_b.tolist()), *zip(la.tolist(), lb.tolist())])
        assert links == [(i, j) for i in range(len(x)) for j in range(len(y))
                         if max([0, *x][i], [0, *y][j]) < min(x[i], y[j])]


def test_texts(spark):
    more = ["x▁y", "▁", "<s> </s> <unk> <0x41>", " lead", "trail  ", "  ", "\n\n\tcode(x) { return 1; }", "ﬁ １ Å",
            "aaaa" * 700, "the end.\r\n" * 30, "word" + " " * 3000 + "word", "العربية עברית हिन्दी ไทย"]
    wanted = compare(spark, odd.documents(spark, odd.texts() + more))
    assert sum(w[1] > 0 for w in wanted) > 25 and sum(w[1] == 0 for w in wanted) >= 3
    compare(spark, odd.documents(spark))


def test_blocks_of_any_size(spark):
    docs = odd.documents(spark, odd.texts() * 3).repartition(3)
    compare(spark, docs, links_each=1)
    compare(spark, docs, links_each=500)


def test_empty_table(spark):
    assert align_tokenizers(odd.documents(spark).limit(0), BYTES, PIECES).collect() == []


def test_long_blank_runs():
    first, second = ByteTokenizer(BYTES), PieceTokenizer(PIECES)
    for text in ("a" + " " * 1_200_000 + "b", "\n" * 1_200_000):
        assert b"".join(first.bytes[i] for i in first.encode(" " + text).tolist()) == (" " + text).encode()
        assert b"".join(second.bytes[i] for i in second.encode(text).tolist()) == (" " + text).encode()


def test_pairs_of_many_blocks_are_not_held_together(spark):
    """Before, lists of the pairs of up to 128 blocks were made at once in a task; now a block follows the other."""
    docs = odd.documents(spark, odd.texts()).repartition(2)
    plan = diagonal_alignment._aligned(docs, BYTES, PIECES, 100, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan

    def batches():  # a block's pairs may lie in several batches, and several blocks in one
        def head(doc_id, links):
            return pickle.dumps(([(doc_id, 1, 1, 1, "x", len(links))], np.array(links, dtype="<i4").tobytes()))

        rows = [(None, head(1, [0, 1, 1])), (5, None), (8, None), (None, head(2, [])), (None, head(3, [0])), (7, None)]
        for cut in ((0, 2), (2, 4), (4, 4), (4, 6)):
            some = rows[slice(*cut)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], type=t) for i, t in enumerate((pa.int64(), pa.binary()))], names=["packed", "told"])

    schema = T._parse_datatype_string(
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    found = [tuple(r.values()) for b in diagonal_alignment._totals(schema)(batches()) for r in b.to_pylist()]
    assert found == [(1, 1, 1, 1, 3, 1, 10, "x"), (2, 1, 1, 1, 0, 0, 0, "x"), (3, 1, 1, 1, 1, 1, 3, "x")]
