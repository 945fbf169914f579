"""Cases that once cost more than the result is worth: long chains, crowded titles, queries in blocks, rules by the hundred."""

import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import dedup, joins, nearest, reports, requirements, retrieval

POST = "id long, company string, title string, location string, job_url string, canonical_url string, application_id string, seen long, rank double"


def test_display_dedup_of_a_chain_of_200(spark):
    rows = []
    for i in range(67):  # plain row, then two of one stable id, the second with the next plain row's URL
        here, after = f"https://x.com/p{i}", f"https://x.com/p{i + 1}"
        rows += [(here, ""), (f"https://acme.com/jobs/{1000 + i}", here), (f"https://acme.com/jobs/{1000 + i}", after)]
    rows = [(i, "", "Analyst", "", job, canonical, "", i, 1.0) for i, (job, canonical) in enumerate(rows)]
    assert len(rows) > 200
    kept = sorted(r.id for r in dedup.greedy_display(spark.createDataFrame(rows, POST), "seen", "rank").collect())
    assert kept == list(range(0, len(rows), 2))


def test_ten_thousand_equal_titles_with_ids_make_no_pairs(spark):
    df = spark.range(10_000).select(
        "id", F.lit("Acme").alias("company"), F.lit("Software Engineer").alias("title"), F.lit("Boston").alias("location"), F.concat(F.lit("https://acme.com/jobs/"), F.col("id") + 100_000).alias("job_url"), F.lit("").alias("canonical_url"), F.lit("").alias("application_id")
    )
    assert dedup.same_posting_pairs(df).count() == 0


def test_nearest_rows_in_blocks_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    x[50] = x[51]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [1.0, None] * 8), (1003, [1.0] * 3)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(np.maximum(0, unit @ unit.T), 6)
    want = {}
    for q in range(0, 400, 20):
        near = sorted((-score[q, j], j) for j in range(400) if j != q)
        want[q] = [(j, -s) for s, j in near[:5]]
    for block in (50_000, 7):
        monkeypatch.setattr(nearest, "QUERY_BLOCK", block)
        queries = df.where("id % 20 = 0 and id < 1000").select(F.col("id").alias("q"), "v")
        got = {}
        for r in nearest.nearest(queries, df, "q", "id", "v", "v", 5, others=True).collect():
            got.setdefault(r.q, []).append((r.id, r.cosine))
        assert {q: sorted(v, key=lambda t: (-t[1], t[0])) for q, v in got.items()} == want
    tied = nearest.nearest(df.where("id = 50").select(F.col("id").alias("q"), "v"), df, "q", "id", "v", "v", 1, ties=True).collect()
    assert {r.id for r in tied} == {50, 51}
    assert nearest.nearest(df.limit(0).select(F.col("id").alias("q"), "v"), df, "q", "id", "v", "v", 5).count() == 0


def test_rules_are_counted_in_several_aggregates(spark):
    rows = spark.createDataFrame([("a1", True), ("b1", False), ("a2", False), (None, True)], "t string, good boolean")
    rules = spark.createDataFrame([("a",), ("b",), ("1",), ("z",)], "pattern string")
    got = {r.pattern: (r.positives, r.negatives) for r in reports.rule_support(rules, rows, "t", "good", at_once=2).collect()}
    assert got == {"a": (1, 1), "b": (0, 1), "1": (1, 1), "z": (0, 0)}
    assert reports.rule_support(rules.limit(0), rows, "t", "good").count() == 0


def test_similar_sets_and_bm25_with_odd_rows(spark):
    items = spark.createDataFrame([(1, ["a", "b", "b"]), (2, []), (3, None)], "item long, t array<string>")
    docs = spark.createDataFrame([(10, ["a", "b"]), (11, ["a"] + [f"w{i}" for i in range(40)]), (12, []), (13, None), (14, ["x"])], "doc long, t array<string>")
    sets = {(r.item, r.doc): round(r.similarity, 6) for r in retrieval.similar_sets(items, docs, "item", "doc", "t", 0.35).collect()}
    assert sets == {(1, 10): 1.0}
    scored = {(r.item, r.doc): r.bm25 for r in retrieval.bm25(items, "item", "t", docs, "doc", "t").collect()}
    n, avg = 5, (2 + 41 + 1) / 5
    idf = lambda df: np.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, dl, df: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert set(scored) == {(1, 10), (1, 11)}
    assert abs(scored[1, 10] - (part(1, 2, 2) + 2 * part(1, 2, 1))) < 1e-9 and abs(scored[1, 11] - part(1, 41, 2)) < 1e-9


def test_grams_of_texts_are_not_broadcast(spark):
    a = spark.range(2000).select("id", F.concat(F.lit("Large Ring "), F.col("id") % 3).alias("t"))
    b = spark.createDataFrame([("ring",), ("large ring 1 set",), ("RING",), ("",), (None,)], "w string")
    found = joins.contains_join(a, b, "t", "w")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.w: r["count"] for r in found.groupBy("w").count().collect()} == {"ring": 2000, "RING": 2000, "large ring 1 set": 667}


def test_layered_facts_meet_each_wording_once(spark):
    facts = spark.createDataFrame([(i, ["alpha beta"], ["gamma"], "high" if i % 2 else "low") for i in range(40)] + [(99, None, ["delta"], None)], "fact_id long, m array<string>, d array<string>, s string")
    queries = spark.createDataFrame([(1, "Beta alpha"), (2, "alpha, beta"), (3, "gamma delta"), (4, "x"), (5, None)], "query_id int, t string")
    found = requirements.layered_facts(facts, queries, "query_id", "t", "fact_id", {"exact_method": "m", "domain": "d"}, "s")
    assert "keys=[query_id" not in found._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r.query_id, r.place, r.fact_id, r.score) for r in found.collect())
    assert [r[1:] for r in rows if r[0] == 1] == [r[1:] for r in rows if r[0] == 2] == [(i + 1, 2 * i + 1, 11.2) for i in range(15)]
    assert [r[1:] for r in rows if r[0] == 3] == [(i + 1, 2 * i + 1, 2.24) for i in range(15)] and {r[0] for r in rows} == {1, 2, 3}


def test_requirements_of_equal_texts_are_read_once(spark):
    texts = spark.range(5000).select("id", F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.concat(F.lit("Python needed, "), F.col("id") % 2)).alias("text"))
    found = requirements.extract_requirements(texts.unionByName(texts.where("id = 1")), "id", "text", [("Code", "Tools", ("python", "r"))])
    assert "Aggregate" in found._jdf.queryExecution().executedPlan().toString()  # over texts
    rows = found.collect()
    assert len(rows) == 4501 and {(r.requirement_id, r.label, tuple(r.literal_terms), r.source_text, r.hard) for r in rows} == {("JD-R001", "Code", ("python",), "Python needed", False)}
    assert found.columns == ["id", "requirement_id", "label", "category", "literal_terms", "source_text", "hard"]
