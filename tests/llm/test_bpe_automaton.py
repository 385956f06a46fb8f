import hashlib
import random
import unicodedata

import numpy as np
import odd
import public_tokenizers
import pytest
from conftest import SF
from tokenizers import Tokenizer

from surtido.llm import bpe_automaton
from surtido.llm.bpe_automaton import MergeAutomaton

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def merged(word, ranks):
    """Plain BPE: the merge of lowest rank, leftmost first, until none applies."""
    word = list(word)
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(word, word[1:])) if p in ranks), default=None)
        if best is None:
            return word
        i = best[1]
        word[i : i + 2] = [word[i] + word[i + 1]]


@pytest.mark.parametrize("seed", range(30))
def test_automaton_accepts_exactly_the_tokenization(seed):
    rng = random.Random(seed)
    tokens, merges = ["a", "b", "c"], []
    while len(merges) < 12:
        u, v = rng.choice(tokens), rng.choice(tokens)
        if u + v not in tokens and len(u + v) <= 6:
            merges.append((u, v))
            tokens.append(u + v)
    number = {t: i for i, t in enumerate(tokens)}
    automaton = MergeAutomaton(len(tokens), [(number[u], number[v], number[u + v]) for u, v in merges])
    ranks = {m: r for r, m in enumerate(merges)}
    for _ in range(60):
        word = "".join(rng.choices("abc", k=rng.randint(1, 12)))
        paths = [[]]
        complete = []
        while paths:
            path = paths.pop()
            at = sum(map(len, path))
            if at == len(word):
                complete.append(path)
            for t in tokens:
                if word.startswith(t, at) and automaton.follows(number[t], number[path[-1]] if path else -1):
                    paths.append([*path, t])
        assert complete == [merged(word, ranks)]


def expected(rows):
    library = Tokenizer.from_file(PATH)
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_the_library(spark):
    for docs in (odd.documents(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        found = bpe_automaton.digests(bpe_automaton.bpe_round_trip(docs, PATH)).collect()
        assert sorted(map(tuple, found), key=str) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_every_code_point_equals_the_library():
    library, own = Tokenizer.from_file(PATH), bpe_automaton.WordTokenizer(PATH)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    wrong = []
    for at in range(0, len(points), 512):
        text = " ".join(f"{c} a{c}B" for c in points[at : at + 512])
        if own.encode(text) != np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes():
            wrong.append(at)
    assert wrong == []


def test_sequences_of_marks_and_white_space_equal_the_library():
    library, own = Tokenizer.from_file(PATH), bpe_automaton.WordTokenizer(PATH)
    rng = random.Random(5)
    marks = [chr(c) for c in range(0x20000) if unicodedata.combining(chr(c))]
    others = [*"aeo<|'s\t\n\x1c\x1f\x85\xa0\u1680\u180e\u2003\u2028\u202f\u3000\u200b\ufeff\u1100\u1161\u11a8\u212b\u03a3\u0130"]
    texts = ["\u0740\u0899", *("".join(rng.choice(marks if rng.random() < 0.6 else others)
                                       for _ in range(rng.randint(1, 30))) for _ in range(20_000))]
    wrong = [t for t in texts if own.encode(t) != np.array(
        library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]
    assert wrong == []


def test_empty_table(spark):
    assert bpe_automaton.bpe_round_trip(odd.documents(spark).limit(0), PATH).collect() == []


def test_store_stays_bounded():
    store = bpe_automaton._Recent(10)
    for i in range(100):
        store.put(i, b"x")
    assert len(store.new) <= 10 and len(store.old) <= 10 and store.get(99) == b"x"
