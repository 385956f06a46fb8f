import hashlib
import random

import odd
import pytest
from conftest import SF

from surtido.llm import column_bwt


def expected(rows):
    out = []
    for (doc_id, text), marks in zip(rows, odd.covered([t for _, t in rows])):
        raw = (text or "").encode()
        kept = bytes(b for b, m in zip(raw, marks) if not m)
        runs = sum(m and not p for m, p in zip(marks, [False, *marks]))
        out.append((doc_id, len(raw), sum(marks), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(docs, **options):
    found = column_bwt.digests(column_bwt.remove_repeats(docs, **options)).collect()
    assert sorted(map(tuple, found), key=str) == expected([(r.doc_id, r.text) for r in docs.collect()])


def passages():
    rng = random.Random(5)

    def noise(n):
        return "".join(rng.choices("abcdefgh \n", k=n))

    base, common = noise(1500), "".join(rng.choices("xyz uvw", k=260))
    rows = ["a" * 1000, "ab" * 300, "c" * 200, "d" * 199, "c" * 200, base[:200], base[100:299], base[:201], None, "",
            "é" * 400, "\0" * 450, "\0" * 50 + base[500:700] + "\0" * 30]
    rows += [noise(rng.randint(0, 300)) + common[rng.randint(0, 40) : rng.randint(200, 260)] + noise(rng.randint(0, 300))
             for _ in range(60)]
    return rows + [base[: rng.randint(0, 800)] + "Q" + base[rng.randint(600, 1000) :] for _ in range(30)]


@pytest.mark.parametrize("most_contexts, most_split", [(1024, 16384), (4, 16384), (1, 8), (1, 1)])
def test_passages_and_split_collections(spark, most_contexts, most_split):
    check(odd.documents(spark, passages()), most_contexts=most_contexts, most_split=most_split)


def test_odd_rows(spark):
    check(odd.documents(spark))


def test_small_table(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_rows_keep_their_columns(spark):
    docs = odd.documents(spark, ["x" * 100 + "é" * 120 + "y" * i for i in (3, 4)] + ["plain", None])
    cut = column_bwt.without_repeats(docs)
    assert cut.schema.names == docs.schema.names
    rows = {r.doc_id: r.text for r in cut.collect()}
    assert rows[2] == "plain" and rows[3] is None and set(rows[0]) <= {"y"} and set(rows[1]) <= {"y"}


def test_empty_table(spark):
    docs = odd.documents(spark).limit(0)
    assert column_bwt.remove_repeats(docs).collect() == []
    assert column_bwt.without_repeats(docs).collect() == []
