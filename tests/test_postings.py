import datetime

from pyspark.sql import functions as F

from siltstone.operators import postings as P


def col(spark, make, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_states(spark):
    assert col(spark, P.parse_time, "2024-01-02T03:04:05Z", "2024-01-02T03:04:05", "x", None) == [datetime.datetime(2024, 1, 2, 3, 4, 5)] * 2 + [None, None]
    assert col(spark, P.is_active, "开放", "closed", None) == [True, False, False]
    today = F.lit("2024-05-02").cast("date")
    assert col(spark, lambda c: P.deadline_passed(c, F.lit("date"), today), "2024-05-01", "2024-05-02", "soon", None) == [True, False, False, False]
    assert col(spark, P.interruption, "code: 37", "Please LOGIN", "timed out", "boom", None) == ["verification_required", "login_required", "network_error", "source_error", "source_error"]
    got = col(spark, lambda c: P.in_region(c, "(?i)united states|, ca", "(?i)india", "(?i)united states"), "Remote - India", "United States - New York", "", "Paris")
    assert got == [False, True, True, False]
    got = col(spark, lambda c: P.unsupported_core(F.lit("Analyst"), c, ["llm"], "核心职责", "大模型"), "核心职责是训练大模型", "大模型", None)
    assert got == [True, False, False]
    assert col(spark, lambda c: P.capture_error(F.lit("t"), c, F.lit("https://a.com")), "a complete description", "this text is truncated and", "short") == [None, "truncated", "no_description"]
    assert col(spark, lambda c: P.verification(c.cast("int"), F.lit("ok"), F.lit(0.6)), "404", "500", "200") == ["closed", "unknown", "open"]
    assert col(spark, P.initial_class, "Coursework Match", "Strong Transferable", "Adjacent", "x") == ["Direct", "Transferable", "Adjacent", "Unsupported"]


def test_ids(spark):
    at = F.lit("2024-01-01 03:00:00").cast("timestamp")
    got = col(spark, lambda c: P.archive_id(c, F.lit(12345), at, F.lit("")), "The Acme", "ab")
    assert got == ["APP-2023-ACM-12345", "APP-2023-ABX-12345"]
    assert col(spark, lambda c: P.archive_id(F.lit("x"), F.lit(1), at, c), "app-2020-abc-001") == ["APP-2020-ABC-001"]
    assert col(spark, P.archive_path, "APP-2020-ABC-001") == ["applications/2020/APP-2020-ABC-001"]
    a, b = col(spark, lambda c: P.distinct_url(F.lit("https://a.com/x#y"), c), "one", "two")
    assert a != b and a.startswith("https://a.com/x#posting-")
    same = col(spark, lambda c: P.capture_id(c, F.lit("t"), F.lit(""), F.lit("https://www.a.com/"), F.lit("d")), "Acme & Co", "acme and co")
    assert same[0] == same[1]


def test_capture_ids_of_two_hundred_thousand_pages_differ(spark):
    k = F.sha2(F.col("id").cast("string"), 256)
    c = P.capture_id(F.lit("a"), F.lit("t"), F.lit(""), F.lit(""), k)
    ids = spark.range(200_000).repartition(8).select(c.alias("c")).cache()
    assert ids.distinct().count() == 200_000
    assert ids.select(F.substring_index("c", "-", 3)).distinct().count() < 200_000  # the short ids alone do not
    ids.unpersist()


def test_reports_and_rules(spark):
    s = spark.createDataFrame([("a", 5, 1, 1, "ok", True), ("a", 1, 0, 0, "rate_limited", True), ("b", 0, 0, 0, "rate_limited", True)], "source string, scanned int, valid int, matched int, source_status string, accounted_for boolean")
    got = {r.source: (r.limited, r.enough, r.all_limited) for r in P.platform_validation(s, 1).collect()}
    assert got == {"a": (False, True, False), "b": (True, True, False)}
    rows = spark.createDataFrame([("Data lead", "uses R and SAS", 90), ("Sales", "R", 50)], "t string, d string, s int")
    rules = spark.createDataFrame([("include", "SAS", 20), ("exclude", "sales", 0)], "kind string, term string, boost int")
    assert [(r.s, r.blocked) for r in P.apply_rules(rows, rules, "t", "d", "s").collect()] == [(100, False), (50, True)]
    pool = spark.createDataFrame([("a", 1)], "c string, v int")
    jobs = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2)], "c string, v int")
    assert sorted(tuple(r) for r in P.all_companies(pool, jobs, "c", "v").collect()) == [("a", 1), ("b", 2)]
    q = spark.createDataFrame([(["x", "x", "y"],), (["y"],)], "issue_keys array<string>")
    assert {r.issue: r.n for r in P.quality_board(q).collect()} == {"x": 1, "y": 2}
    m = spark.createDataFrame([("r", "s1", "c", 0.7, 0), ("r", "s1", "c", 0.94, 1), ("q", "s2", "c", 0.7, 1)], "requirement_id string, snippet_id string, concept string, confidence double, n_facts int")
    assert {r.requirement_id: r.covered for r in P.template_cover(m).collect()} == {"r": True, "q": False}
    n = P.requirement_numbers(spark.createDataFrame([("b",), ("a",)], "label string"), [F.col("label")])
    assert {r.label: r.requirement_id for r in n.collect()} == {"a": "JD-R001", "b": "JD-R002"}
    o = spark.createDataFrame([(["c++"], "knows C++"), (["sql models"], "sql model work")], "t array<string>, x string")
    assert [round(r.v, 3) for r in o.select(P.term_overlap(F.col("t"), F.col("x")).alias("v")).collect()] == [1.0, 1.0]
    f = col(spark, lambda c: P.flagged_groups(F.lit("needs production deployment"), c, [["production"], ["fda"]]), "no production claims", "no fda claims")
    assert f == [True, False]
