import hashlib
import random
import re

import odd
import pytest
from conftest import SF

from surtido.llm import secret_scan


def check(docs):
    kinds = ("assign", "access", "hex")
    want = []
    for r in docs.collect():
        spans = odd.base_secrets(r.text or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        want.append((r.doc_id, *(sum(k == x for _, _, k in spans) for x in kinds), hashlib.sha256(joined.encode()).hexdigest(), joined))
    rows = secret_scan.digests(secret_scan.scan_secrets(docs)).collect()
    found = []
    for r in rows:
        base = ",".join(x for x in r.spans.split(",") if x.split(":")[0] in kinds)
        found.append((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, base))
    assert sorted(found, key=str) == sorted(want, key=str)


def test_base_rules_equal_a_full_search(spark):
    check(odd.documents(spark))
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_every_rule_equals_a_full_search(spark):
    rng = random.Random(8)
    planted = ["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN " + "A" * 41 + "PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "github_pat_" + "x" * 29,
               "xoxb-" + "1a-" * 9, "xoxz-" + "1" * 30, "AIza" + "Z_-" * 12, "sk_live_" + "9" * 16, "rk_prod_" + "9" * 16, "sk_test_123",
               "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12, "eyJ" + "a" * 9 + ".b.c", "GHP_" + "a" * 40, "0123456789abcdef" * 2,
               "AKIA" + "Q" * 16, "token: " + "k" * 14, "API-KEY", "é", "👍", "\u017fecret=" + "q" * 20, "-", "_", ".", " ", "\n"]
    texts = ["".join(rng.choice(planted) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    texts += [p[: rng.randint(1, len(p))] for p in planted * 4]
    want = {}
    for i, text in enumerate(texts):
        want[i] = sorted((m.start(), m.end(), rule.kind) for rule in secret_scan.RULES
                         for m in re.compile(rule.pattern, re.ASCII).finditer(text) if len(m[rule.group]) >= rule.least)
    found = {r.doc_id: sorted((s.start, s.end, s.kind) for s in r.spans)
             for r in secret_scan.scan_secrets(odd.documents(spark, texts)).collect()}
    assert found == want
    assert {k for spans in want.values() for _, _, k in spans} == {rule.kind for rule in secret_scan.RULES}


def test_more_rules_add_spans_and_masks_cover_all(spark):
    text = "é ghp_" + "a1B2" * 9 + " and -----BEGIN RSA PRIVATE KEY----- token=" + "z" * 20
    docs = odd.documents(spark, [text, None, "clean"])
    spans = {r.doc_id: [(s.kind, text[s.start : s.end]) for s in r.spans] for r in secret_scan.scan_secrets(docs).collect()}
    assert spans == {0: [("github", "ghp_" + "a1B2" * 9), ("private_key", "-----BEGIN RSA PRIVATE KEY-----"),
                         ("assign", "token=" + "z" * 20)], 1: [], 2: []}
    masked = secret_scan.mask_secrets(docs)
    assert masked.schema.names == docs.schema.names
    assert [r.text for r in masked.orderBy("doc_id").collect()] == ["é [secret] and [secret] [secret]", None, "clean"]


@pytest.mark.parametrize("pattern, holds, lacks", [
    ("abcd|xyz+w", "abc bcd", "abd xy"), ("(?i:SeCret)[0-9]", "sec ecr cre ret", "sec ecr"), ("a.c", "", None),
    ("(?:foo){2}", "foo oof ofo", "foo"), ("pre(?:fix)?ed", "pre ree eed", "pre"),
])
def test_queries_follow_from_patterns(pattern, holds, lacks):
    query = secret_scan.trigram_query(pattern)

    def true(q, have):
        return q is True or (q in have if isinstance(q, str) else (all if q[0] == "and" else any)(true(p, have) for p in q[1]))

    assert true(query, set(holds.split()))
    if lacks is None:
        assert query is True
    else:
        assert not true(query, set(lacks.split()))


def test_overlaps_are_masked_once():
    assert secret_scan._masked("0123456789", [(1, 4, "a"), (2, 6, "b"), (6, 7, "c"), (8, 9, "d")], "#") == "0#7#9"


def test_empty_table(spark):
    docs = odd.documents(spark).limit(0)
    assert secret_scan.scan_secrets(docs).collect() == [] and secret_scan.mask_secrets(docs).collect() == []
