import random

import odd
import pytest
from conftest import SF

from surtido.llm import hamming_join


def check(docs, percent=85):
    rows = docs.collect()
    ids = components_of(rows, percent)
    found = hamming_join.near_duplicates(docs, percent).collect()
    assert len(found) == len(rows)
    for r in found:
        n, smallest = ids[r.doc_id]
        assert (r.n_shingles, r.component_id, r.kept) == (n, smallest, r.doc_id == smallest), r


def components_of(rows, percent):
    sets = {r.doc_id: odd.shingles(r.text) for r in rows if r.doc_id is not None}
    smallest = odd.components(sorted(sets.items()), percent)
    out = {i: (len(s), smallest[i]) for i, s in sets.items()}
    for r in rows:
        if r.doc_id is None:
            out[None] = (len(odd.shingles(r.text)), None)
    return out


def copies(seed, groups=8, each=25, length=90):
    """Groups of copies with different shares of changed words, so that similarities lie around the threshold."""
    rng = random.Random(seed)

    def word():
        return "".join(rng.choices("abcdefghijkl", k=5))

    rows = []
    for _ in range(groups):
        base = [word() for _ in range(length)]
        for _ in range(each):
            share = rng.choice([0.0, 0.005, 0.01, 0.02, 0.03])
            rows.append(" ".join(word() if rng.random() < share else w for w in base))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent, seed", [(85, 1), (80, 2)])
def test_groups_around_the_threshold(spark, percent, seed):
    check(odd.documents(spark, copies(seed)), percent)


def test_odd_rows_and_small_table(spark):
    check(odd.documents(spark))
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_blocks_of_large_buckets_lose_nothing(spark, monkeypatch):
    cross = hamming_join._cross_pairs
    monkeypatch.setattr(hamming_join, "_cross_pairs", lambda *a: cross(*a, block=3))
    check(odd.documents(spark, copies(3, groups=3, each=40)))


def test_index_holds_every_pair_within_its_distance():
    for percent in (85, 80):
        index = hamming_join.index_for(percent)
        differ = (100 - percent) / 100 * index.symbols
        assert index.most_apart > differ + 5 * (differ * percent / 100) ** 0.5 and index.symbols < 128


def test_one_of_each_keeps_columns_and_one_row(spark):
    docs = odd.documents(spark)
    kept = hamming_join.one_of_each(docs, 85)
    assert kept.schema.names == docs.schema.names
    ids = [r.doc_id for r in kept.collect()]
    smallest = {i for _, i in components_of(docs.collect(), 85).values()}
    assert len(ids) == len(set(ids)) and set(ids) == smallest


def test_long_chains_become_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    roots = {r.rid: r.root for r in hamming_join.components(links).collect()}
    assert roots == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_texts_of_no_candidate_are_not_shuffled(spark):
    rows = copies(4, groups=1, each=3) + [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(400)]
    docs = odd.documents(spark, rows)
    keyed = hamming_join._keyed(docs)
    some = keyed.filter("doc_id < 3").selectExpr("doc_id AS rid", "struct(doc_id, text_hash) AS row")
    plan = hamming_join._sets(docs.union(docs), some, 5)
    wanted = [r.text_hash for r in keyed.filter("doc_id < 3").collect()]
    passed = hamming_join._passing(keyed, hamming_join.ShingleFilter(some.select("row.text_hash"), "text_hash"))
    assert {r.text_hash for r in passed.collect()} >= set(wanted) and passed.count() < 40
    assert sorted(r.rid for r in plan.collect()) == [0, 1, 2]


def test_components_joined_later_keep_their_members(spark):
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (8, 8), (9, 8)], "rid long, root long")
    joined = spark.createDataFrame([(3, 1), (1, 1), (7, 1)], "rid long, root long")
    found = {r.rid: r.root for r in hamming_join._united(roots, joined).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 7: 1, 8: 8, 9: 8}


def test_empty_table(spark):
    docs = odd.documents(spark).limit(0)
    assert hamming_join.near_duplicates(docs).collect() == [] and hamming_join.one_of_each(docs).collect() == []
