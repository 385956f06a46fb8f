import random
from collections import Counter

import odd
import regex
from conftest import SF

from surtido.llm import quality_cascade


def measures(text):
    text = text or ""
    words = odd.WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if odd.WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def plain_verdict(text):
    """Whether every rule lets the text pass, without any order."""
    n, chars, symbols, dups, repeats = measures(text)
    words = odd.WORD.findall(text or "")
    lines = (text or "").split("\n")
    full = sum(bool(odd.WORD.search(x)) for x in lines)
    return not (
        n < 50 or 100 * repeats > 50 * n or not 2 * n <= chars <= 20 * n or 10 * symbols > n or 100 * dups > 30 * full
        or 10 * sum(not regex.search(r"\p{L}", w) for w in words) > 3 * n
        or 10 * sum(bool(regex.match(r"[ \t]*[-*•]", x)) for x in lines) > 9 * full
        or 10 * sum(bool(regex.search(r"(\.\.\.|…)[ \t]*$", x)) for x in lines) > 3 * full)


def check(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = quality_cascade.assess(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        want = measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == plain_verdict(texts[r.doc_id])


def test_measures_equal_a_plain_count(spark):
    check(odd.documents(spark))
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_each_rule_rejects_as_the_plain_version(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]

    def lines(n, make):
        return "\n".join(make(" ".join(rng.sample(words, 8)), i) for i in range(n))

    texts = []
    for share in (0.0, 0.2, 0.28, 0.32, 0.5, 0.88, 0.92, 1.0):
        def some(i):
            return i < round(share * 50)
        texts += [
            lines(50, lambda x, i: f" - {x}" if some(i) else x), lines(50, lambda x, i: f"{x} ... " if some(i) else x),
            lines(50, lambda x, i: f"{x}…" if some(i) else x), lines(50, lambda x, i: "the same line again" if some(i) else x),
            lines(50, lambda x, i: f"{x} 12 34 56 78" if some(i) else x), lines(50, lambda x, i: f"{x} # & < |" if some(i) else x),
            lines(50, lambda x, i: x.replace(" ", "") * 3 if some(i) else x),
            lines(50, lambda x, i: " ".join(x.replace(" ", "")) if some(i) else x),
        ]
    docs = odd.documents(spark, texts)
    check(docs)
    rows = quality_cascade.cascade(quality_cascade.measures(docs), list(quality_cascade.RULES)).select("failed_rule").distinct().collect()
    assert {r.failed_rule for r in rows} >= {None, *(r.name for r in quality_cascade.RULES if r.name != "few_words")} - {"repeated_windows"}


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_cascade.assess(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").collect()
    clean = [r for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean) and sum(r.kept for r in junk) <= 0.1 * len(junk)


def test_order_changes_nothing(spark):
    measured = quality_cascade.measures(spark.read.parquet(f"{SF}/documents.parquet"))
    verdicts = []
    for rules in (quality_cascade.RULES, quality_cascade.RULES[::-1]):
        rows = quality_cascade.cascade(measured, list(rules)).select("doc_id", "failed_rule").collect()
        verdicts.append({r.doc_id: r.failed_rule is None for r in rows})
    assert verdicts[0] == verdicts[1] and not all(verdicts[0].values())


def test_rules_that_reject_more_for_less_come_first(spark):
    sample = quality_cascade.measures(spark.read.parquet(f"{SF}/documents.parquet"))
    never = quality_cascade.Rule("never", "n_words < 0")
    always = quality_cascade.Rule("always", "n_words >= 0")
    assert [r.name for r in quality_cascade.order_rules(sample, (never, always))] == ["always", "never"]


def test_costs_stand_clear_of_the_job(spark):
    sample = quality_cascade.measures(spark.read.parquet(f"{SF}/documents.parquet")).limit(500).cache()
    free = quality_cascade.Rule("free", "n_words < 0")
    words = "size(filter(words_, w -> not w rlike '(a|b)+c$')) < 0"
    one, four = (quality_cascade.Rule(f"x{n}", " or ".join([words.replace("c", "c" * (k + 1)) for k in range(n)])) for n in (1, 4))
    cost = quality_cascade.seconds_a_row(sample, (free, one, four))
    sample.unpersist()
    assert cost["free"] < cost["x1"] / 20 and 2 < cost["x4"] / cost["x1"] < 8


def test_the_sample_spreads_over_the_table(spark, monkeypatch):
    docs = spark.range(0, 20_000, 1, 4).selectExpr("id as doc_id", "concat('text ', id) as text")
    seen, order = [], quality_cascade.order_rules
    monkeypatch.setattr(quality_cascade, "order_rules", lambda sample, rules: seen.extend(
        r.doc_id for r in sample.select("doc_id").collect()) or order(sample, rules))
    quality_cascade.assess(docs)
    assert 300 < len(seen) <= 500
    assert all(sum(k * 5000 <= i < (k + 1) * 5000 for i in seen) > 50 for k in range(4))


def test_a_filter_on_the_result_stays_linear(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(60_000))
    docs = odd.documents(spark, [long, "short " * 60])
    assert quality_cascade.assess(docs).filter("n_repeat_words > 40000 and not kept").count() == 1


def test_plan_has_no_python(spark):
    plan = quality_cascade.assess(odd.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_empty_table(spark):
    assert quality_cascade.assess(odd.documents(spark).limit(0)).collect() == []
