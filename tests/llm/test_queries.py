"""Registered queries against their SQL, and the pipeline against a plain version."""

import zlib
from collections import defaultdict

import numpy as np
import odd
import public_tokenizers
import pytest
from compare import connection, differences
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from surtido.llm import column_bwt, hamming_join, secret_scan
from surtido.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connection(SF), ORACLES[name]) == []


def test_one_query_for_each_operator():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and len(QUERIES) == 13


def plain_pipeline(rows):
    """doc_id -> the text that reaches packing."""
    texts = {r.doc_id: r.text for r in rows if any(c.isalpha() for c in r.text or "")}
    smallest = odd.components(sorted((i, odd.shingles(t)) for i, t in texts.items()), 80)
    kept = sorted(i for i in texts if smallest[i] == i)
    out = {}
    for i, marks in zip(kept, odd.covered([texts[i] for i in kept])):
        text = bytes(b for b, m in zip(texts[i].encode(), marks) if not m).decode("utf-8", "ignore")
        spans = odd.base_secrets(text)
        pieces, done = [], 0
        for start, end, _ in spans:
            if start > done or not pieces:
                pieces += [text[done:start], "[secret]"]
            done = max(done, end)
        out[i] = "".join([*pieces, text[done:]])
    return out


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wanted = plain_pipeline(docs.collect())
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    pieces = defaultdict(list)
    for p in corpus_pipeline.run(spark, SF).collect():
        pieces[p.doc_id].append(p)
    assert set(pieces) == set(wanted)
    for i, text in wanted.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for p in pieces[i]:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        assert sum(p.length for p in pieces[i]) == len(ids)


def test_pipeline_without_labels(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    odd.documents(spark, [r.text for r in docs.collect()] + [None, "12 34 !!"]).withColumn(
        "lang", F.lit(None).cast("string")).write.parquet(f"{tmp_path}/documents.parquet")
    wanted = plain_pipeline(spark.read.parquet(f"{tmp_path}/documents.parquet").collect())
    found = {p.doc_id for p in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == set(wanted) and len(found) > 30


def test_stages_take_odd_and_empty_tables(spark):
    for docs in (odd.documents(spark), odd.documents(spark).limit(0)):
        names = docs.schema.names
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SF)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.schema.names == names
        docs.collect()


def test_columns_of_inner_names_keep_their_values(spark):
    rows = [(i, f"text number {i} of its own words and more {i} {i * i} ends here", f"m{i}", f"h{i}", f"s{i}") for i in range(5)]
    passage = " ".join(f"w{i}" for i in range(90))
    rows += [(5, passage + " first", "m5", "h5", "s5"), (6, "second one " + passage, "m6", "h6", "s6")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _hash string, _spans string")
    for step in (hamming_join.one_of_each, column_bwt.without_repeats, secret_scan.mask_secrets):
        kept = step(docs)
        assert kept.columns == docs.columns
        assert all((r._id, r._hash, r._spans) == tuple(f"{c}{r.doc_id}" for c in "mhs") for r in kept.collect())
    assert len(column_bwt.without_repeats(docs).filter("doc_id = 5").first().text) < 30


def test_a_long_run_of_token_starts_takes_linear_time(spark):
    text = "eyJ" * 700_000
    token = "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12
    docs = spark.createDataFrame([(1, text), (2, f"x {token} y"), (3, f"bearer={token}")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secret_scan.digests(secret_scan.scan_secrets(docs)).collect()}
    assert "jwt" not in spans[1] and f"jwt:2:{2 + len(token)}" in spans[2] and "jwt:7:" in spans[3]
