"""Contamination against a search of every window at every place."""

import hashlib
import random
import re

import odd

from surtido.llm.decontamination import find_contaminated, shingle_hashes, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, length=10):
    doc = words(text)
    hit, ids = [False] * len(doc), set()
    for item_id, item in items:
        own = words(item)
        n = min(length, len(own))
        for at in range(len(own) - n + 1 if n else 0):
            for start in range(len(doc) - n + 1):
                if doc[start : start + n] == own[at : at + n]:
                    hit[start : start + n] = [True] * n
                    if item_id is not None:
                        ids.add(str(item_id))
    listed = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    return len(doc), sum(hit), len(ids), listed, sum(hit) > 0


def compare(spark, docs, items, **options):
    table = spark.createDataFrame(
        [(i, t, "x", "y") for i, t in items], "item_id long, text string, words string, h string")
    found = find_contaminated(docs, table, **options)
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    length = options.get("length", 10)
    wanted = sorted(((r.doc_id is None, r.doc_id), *brute(r.text, items, length)) for r in docs.select("doc_id", "text").collect())
    assert sorted(((r.doc_id is None, r.doc_id), *r[1:]) for r in found.collect()) == wanted
    return wanted


def test_words_and_shingles():
    for text in [t or "" for t in odd.texts()] + ["", "A", "Ünïcode WORDS 9z", "x" * 10000 + " " + "x" * 9999]:
        raw, starts, ends, hashes = words_of(text.encode())
        assert [raw[a:b].tobytes().decode() for a, b in zip(starts, ends)] == words(text)
        assert len(set(hashes.tolist())) == len(set(words(text)))
        assert len(shingle_hashes(hashes, 5)) == max(0, len(words(text)) - 4)


def test_brute_force(spark):
    rng = random.Random(11)
    few = [f"w{i}" for i in range(6)] + ["É", "漢"]

    def prose(n):
        return " ".join(rng.choice(few) for _ in range(n))

    items = [(i, prose(rng.choice([10, 11, 14, 25, 40]))) for i in range(25)]
    items += [(30, "w1"), (31, "w2 w3 É"), (32, "W1, w2; w3 w4"), (33, None), (34, " .,! "), (35, ""), (None, prose(12)),
              (7, prose(13)), items[3], (36, items[4][1])]
    texts = [prose(rng.choice([0, 3, 9, 10, 60])) + " " + rng.choice(items[:25])[1][: rng.choice([8, 30, 300])]
             + "-" + prose(rng.choice([0, 5, 200])) for _ in range(60)]
    texts += [items[0][1].upper(), items[1][1].replace(" ", "\n...\n"), items[5][1] * 3, "w1" * 9]
    wanted = compare(spark, odd.documents(spark, texts), items)
    assert sum(w[5] for w in wanted) > 40 and any(w[3] > 3 for w in wanted)
    assert compare(spark, odd.documents(spark, texts), items[:25] + items[-2:])  # whole windows only
    compare(spark, odd.documents(spark, texts), items[25:31], length=3, shingle=2)


def test_odd_and_empty_tables(spark):
    items = [(1, "no five words here"), (2, odd.texts()[7]), (3, "the"), (4, "漢字 👍🏽"), (None, "line one")]
    compare(spark, odd.documents(spark), items)
    compare(spark, odd.documents(spark), [])
    compare(spark, odd.documents(spark), [(5, None), (6, "?")])
    compare(spark, odd.documents(spark).limit(0), items)


def test_hot_passage(spark):
    """One passage in most documents, many times over, and an item of one very frequent word."""
    passage = " ".join(f"p{i}" for i in range(30))
    docs = odd.documents(spark, [f"a{i} " + (passage + " the ") * (i % 5) + "the " * 40 for i in range(200)])
    compare(spark, docs, [(1, passage), (2, "the"), (3, passage + " more words at the end of it")])
