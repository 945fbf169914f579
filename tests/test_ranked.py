"""The best documents by BM25 against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import ranked, reports, retrieval


def made(seed, n=900):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    pick = lambda k: [words[min(59, int(rng.expovariate(0.08)))] for _ in range(k)]
    docs = [(i, pick(rng.randrange(30))) for i in range(n)] + [(n, None), (n + 1, []), (n + 2, ["none", "known"])]
    docs += [(n + 10 + i, docs[5][1]) for i in range(40)]
    items = [(i, pick(rng.randrange(1, 9))) for i in range(50)] + [(50, []), (51, ["nowhere"]), (52, None), (53, ["w1", "w1", "w2"])]
    return items, docs


@pytest.mark.parametrize(("ties", "block"), [(True, 10**6), (False, 10**6), (True, 20)])
def test_equals_all_pairs(spark, monkeypatch, ties, block):
    monkeypatch.setattr(ranked, "QUERY_BLOCK", block)
    items, docs = made(3)
    a = spark.createDataFrame(items, "item int, t array<string>")
    b = spark.createDataFrame(docs, "doc int, t array<string>").repartition(3)
    every = retrieval.bm25(a, "item", "t", b, "doc", "t").withColumn("bm25", F.round("bm25", 6)).where("bm25 > 0")
    want = reports.top_with_ties(every, "item", "bm25", 7) if ties else every
    want = sorted((r.item, -r.bm25, r.doc) for r in want.collect())
    if not ties:
        want = [w for i, w in enumerate(want) if i < 7 or want[i - 7][0] != w[0]]
    got = sorted((r.item, -r.bm25, r.doc) for r in ranked.bm25_top(a, "item", "t", b, "doc", "t", 7, ties=ties).collect())
    assert [(i, d) for i, _, d in got] == [(i, d) for i, _, d in want]
    assert max(abs(x[1] - y[1]) for x, y in zip(got, want)) < 2e-6


def test_weights_and_plan(spark):
    items, docs = made(4)
    a, b = spark.createDataFrame(items, "item int, t array<string>"), spark.createDataFrame(docs, "doc int, t array<string>")
    weights = b.select("doc", (1 + F.col("doc") % 3).alias("weight"))
    out = ranked.bm25_top(a, "item", "t", b, "doc", "t", 4, weights=weights)
    every = retrieval.bm25(a, "item", "t", b, "doc", "t").withColumn("s", F.round("bm25", 6) * (1 + F.col("doc") % 3))
    want = {}
    for r in every.collect():
        want.setdefault(r.item, []).append((-r.s, r.doc))
    got = {}
    for r in out.collect():
        got.setdefault(r.item, []).append((-r.score, r.doc))
    assert {k: [d for _, d in sorted(v)] for k, v in got.items()} == {k: [d for _, d in sorted(v)[:4]] for k, v in want.items()}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_empty_sides(spark):
    a, b = spark.createDataFrame([(1, ["x"])], "item int, t array<string>"), spark.createDataFrame([(1, ["x"])], "doc int, t array<string>")
    for x, y in ((a.where("false"), b), (a, b.where("false"))):
        assert ranked.bm25_top(x, "item", "t", y, "doc", "t", 3).count() == 0
