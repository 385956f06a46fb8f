import math
import random

import pytest

from surtido.llm import uniform_threshold

KINDS = "vec_id long, embedding array<float>, label int"


def plain(rows, k, every):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in good if i % every == 0}.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], KINDS).selectExpr("*", "1 as score", "2 as block", "3 as row_id")


def vectors(seed, n=150, dims=6):
    rng = random.Random(seed)
    values = [i / 64 for i in range(-64, 65)]
    rows = [(i, [rng.choice(values) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, list(rows[3][1])) for i in range(40)]          # ties in great number
    return rows


@pytest.mark.parametrize("blocks", [(4096, 512), (16, 3)])
def test_equals_all_scores(spark, blocks):
    rows = vectors(1)
    rows += [(None, [1.0] * 6), (1000, None), (1001, []), (1020, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1040, [math.nan] * 6),
             (1060, [math.inf] * 6), (1080, [0.5, 0.25]), (1100, [0.0] * 6)]
    found = uniform_threshold.top_k(frame(spark, rows), rows_each=blocks[0], queries_each=blocks[1])
    assert sorted(map(tuple, found.collect())) == plain(rows, 20, 20)


def test_settled_queries_and_pairs_are_left_out(spark, monkeypatch):
    rng = random.Random(4)
    # A few long vectors, the rest short: the cutoffs lie above what most blocks can give.
    rows = [(i, [rng.choice((-1, 1)) * (4.0 if i < 60 else 0.25) for _ in range(8)]) for i in range(1200)]
    counts, kept = {}, uniform_threshold.open_queries

    def counted(gathered, cutoffs):
        counts["all"], counts["open"] = gathered.count(), kept(gathered, cutoffs).count()
        unit = ["query_block", "query_piece", "block", "piece"]
        counts["pairs"], counts["open pairs"] = (x.select(*unit).distinct().count() for x in (gathered, kept(gathered, cutoffs)))
        return kept(gathered, cutoffs)

    monkeypatch.setattr(uniform_threshold, "open_queries", counted)
    found = uniform_threshold.top_k(frame(spark, rows), rows_each=16, queries_each=4)
    assert sorted(map(tuple, found.collect())) == plain(rows, 20, 20)
    assert counts["open"] < 0.6 * counts["all"] and counts["open pairs"] < counts["pairs"]


@pytest.mark.parametrize("low, high", [(-2.0, 1.0), (-2.0, 2.0), (-512.0, 3.0), (-(2.0**24), 2.0**24)])
def test_every_width_is_exact(spark, low, high):
    rng = random.Random(6)
    rows = [(i, [rng.choice((low, high, 0.0, 1.0, -0.5)) for _ in range(5)]) for i in range(90)]
    found = uniform_threshold.top_k(frame(spark, rows), every=3, lists=3, rows_each=32, queries_each=8)
    assert sorted(map(tuple, found.collect())) == plain(rows, 20, 3)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**s), -float(2**t)]) for i, (s, t) in enumerate([(20, 3), (22, 21), (23, 1), (5, 5), (24, 24)])]
    assert sorted(map(tuple, uniform_threshold.top_k(frame(spark, rows), every=1).collect())) == plain(rows, 20, 1)


def test_fewer_rows_than_k_and_empty_table(spark):
    rows = vectors(2, n=8)[:8]
    assert sorted(map(tuple, uniform_threshold.top_k(frame(spark, rows), every=2).collect())) == plain(rows, 20, 2)
    assert uniform_threshold.top_k(frame(spark, rows).limit(0)).collect() == []
    assert uniform_threshold.top_k(frame(spark, [(0, [1.0])])).collect() == []
