import math
import re

import odd
import pytest

from surtido.llm import language_mixture


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, language_mixture.fit_labelled(docs)


def test_held_out_accuracy(learned):
    docs, model = learned
    both = language_mixture.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    rows = both.filter(language_mixture.held_out()).collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 and abs(sum(x.proportion for x in r.languages) - 1) < 1e-6 for r in rows)


def test_mixed_document_has_both_languages(spark, learned):
    docs, model = learned
    by_lang = {r.lang: r.text for r in docs.filter("n_chars > 1500").dropDuplicates(["lang"]).collect()}
    mixed = by_lang["en"][:1200] + "\n" + by_lang["de"][:600]
    found = language_mixture.identify(odd.documents(spark, [mixed]), model).first()
    assert [x.lang for x in found.languages][:2] == ["en", "de"] and 0.5 < found.score < 0.85


def plain_mixture(model, text, rounds=6, penalty=3.0):
    """Proportions by language, word by word: expectation-maximisation over each nested set in turn."""
    folded = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in text.lower().encode())
    words = []
    for word in re.findall(rb"[^ ]+", folded):
        around = b" " + word + b" "
        slots = [(around[i] << 16 | around[i + 1] << 8 | around[i + 2]) * 2654435761 % 2**32 >> 16 for i in range(len(word))]
        words.append([float(sum(row[s] for s in slots)) for row in model.log_likelihood])
    if not words:
        return {}
    like = [[math.exp(max(x - max(w), -30.0)) for x in w] for w in words]

    def em(languages):
        share = {j: 1 / len(languages) for j in languages}
        for _ in range(rounds):
            total = dict.fromkeys(languages, 0.0)
            for w in like:
                whole = sum(w[j] * share[j] for j in languages)
                for j in languages:
                    total[j] += w[j] * share[j] / whole
            share = {j: x / len(like) for j, x in total.items()}
        return share, sum(math.log(sum(w[j] * share[j] for j in languages)) for w in like)

    everything = range(len(model.languages))
    order = sorted(everything, key=lambda j, s=em(everything)[0]: -s[j])
    price = penalty * math.log(len(words) + 1)
    alone = [sum(math.log(w[j]) for w in like) for j in everything]
    best, value = {max(everything, key=lambda j: alone[j]): 1.0}, max(alone)
    for k in range(2, len(order) + 1):
        share, found = em(order[:k])
        if found - price * (k - 1) > value:
            best, value = share, found - price * (k - 1)
    return {model.languages[j]: x for j, x in best.items() if x}


def test_equals_a_plain_mixture(spark, learned):
    docs, model = learned
    texts = [r.text[:1500] for r in docs.filter("text is not null").orderBy("doc_id").limit(90).collect()]
    mixed = [a[:400] + " " + b[:300] + " " + c[:200] for a, b, c in zip(texts, texts[1:], texts[2:])]
    own = [*texts, *mixed, "a", "12 ab", "the und les", "=-= 3"]
    found = {r.doc_id: r for r in language_mixture.identify(odd.documents(spark, own), model).collect()}
    sizes = set()
    for i, text in enumerate(own):
        want = plain_mixture(model, text)
        got = {x.lang: x.proportion for x in found[i].languages}
        sizes.add(len(want))
        assert got == pytest.approx(want, abs=1e-3), text[:80]
        if want:
            assert want[found[i].lang_pred] == pytest.approx(max(want.values()), abs=1e-3)
    assert {0, 1, 2, 3} <= sizes


def test_odd_rows(spark, learned):
    docs = odd.documents(spark)
    rows = docs.collect()
    found = language_mixture.identify(docs, learned[1]).collect()
    assert sorted((str(r.doc_id) for r in found)) == sorted(str(r.doc_id) for r in rows)
    letters = {r.doc_id: any(c.isalpha() for c in r.text or "") for r in rows}
    for r in found:
        assert (r.lang_pred != "und") == letters[r.doc_id]
        assert (r.score > 0) == bool(r.languages) == letters[r.doc_id]
    kept = language_mixture.keep_identified(docs, learned[1])
    assert kept.schema.names == docs.schema.names
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if letters[r.doc_id])


def test_the_mixture_decides_about_no_row(spark, learned):
    docs, model = odd.documents(spark), learned[1]
    turned = language_mixture.LanguageModel(model.languages, model.log_likelihood[::-1].copy())
    kept = [sorted(str(r.doc_id) for r in language_mixture.keep_identified(docs, m).collect()) for m in (model, turned)]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < docs.count()
    assert "decide about no row" in " ".join(language_mixture.keep_identified.__doc__.split())


def test_learns_from_the_labelled_rows_alone(spark):
    from zlib import crc32

    docs = odd.documents(spark, ["alpha beta"] * 40)
    flags = {r.doc_id: r.out for r in docs.select("doc_id", language_mixture.held_out().alias("out")).collect()}
    assert flags == {i: crc32(str(i).encode()) % 4 == 2 for i in range(40)}
    n = docs.filter(~language_mixture.held_out() & docs.lang.isNotNull()).count()
    assert sum(r.n for r in language_mixture.count_trigrams(docs.filter(~language_mixture.held_out())).collect()) == 9 * n


def test_empty_tables(spark, learned):
    docs = odd.documents(spark)
    nothing = language_mixture.fit(docs.limit(0))
    assert nothing.languages == []
    assert {r.lang_pred for r in language_mixture.identify(docs, nothing).collect()} == {"und"}
    assert language_mixture.identify(docs.limit(0), learned[1]).collect() == []
