"""J13 against a loop over all applications."""

from pyspark.sql import functions as F

from siltstone.functions import urls as U
from siltstone.operators.joins import page_matches


def test_tiers_ties_and_hot_hosts(spark):
    apps = [
        (1, "https://a.io/jobs/111", "", "2024-01-01"), (2, "https://a.io/jobs/222?utm_source=x", "", "2024-01-02"), (3, "https://a.io/list", "", "2024-02-01"), (4, "https://a.io/list", "", "2024-03-01"),
        (5, "https://b.io/x", "REQ-777", None), (6, None, None, None), (7, "", "", ""), (8, "not a url", "", "2024"),
    ]
    apps += [(100 + i, f"https://hot.io/p{i}", "", f"2024-05-{i % 28 + 1:02d}") for i in range(300)]
    pages = [(1, "https://a.io/jobs/111"), (2, "https://www.a.io/jobs/222"), (3, "https://a.io/list#x"), (4, "https://a.io/list"), (5, "https://hot.io/p7/"), (6, "https://hot.io/none"), (7, None), (8, ""), (9, "not a url"), (10, "https://c.io/"), (1, "https://a.io/jobs/111")]
    a = spark.createDataFrame(apps, "app long, job_url string, application_id string, updated string")
    p = spark.createDataFrame([(*x, 5, "k") for x in pages], "page long, url string, score int, k0 string")
    got = {r.page: tuple(r)[1:] for r in page_matches(p, a, "page", "url", "app", "job_url", "application_id", "updated").collect()}
    assert got == {
        1: (100, "exact-url", 1, 1, 1, False), 2: (95, "stable-job-id", 1, 2, 2, False), 3: (80, "canonical-url", 2, 4, None, True), 4: (100, "exact-url", 2, 4, None, True),
        5: (80, "canonical-url", 1, 107, 107, False), 6: (20, "same-host", 300, 379, None, False), 7: (0, "", 0, None, None, False), 8: (0, "", 0, None, None, False),
        9: (100, "exact-url", 1, 8, 8, False), 10: (0, "", 0, None, None, False),
    }
    assert U is not None


def test_pages_that_ask_nothing_are_dealt_to_all_tasks(spark):
    """Pages without a key, and pages that an upper tier has answered, ask the lower tiers nothing."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    a = spark.createDataFrame([(i, f"text {i}", "", "2024") for i in range(0, 4000, 2)], "app long, job_url string, application_id string, updated string")
    p = spark.createDataFrame([(i, f"text {i}") for i in range(4000)], "page long, url string")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = page_matches(p, a, "page", "url", "app", "job_url", "application_id", "updated")
        assert out.where("score = 100 and matched = page").count() == 2000 and out.where("score = 0 and matched is null").count() == 2000
        rows = [r["count"] for r in out.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert sum(rows) == 4000 and max(rows) < 1000


def test_id_of_a_page_is_no_key(spark):
    """A page without a URL is dealt by its id, and does not meet an application whose URL is that text."""
    p = spark.createDataFrame([(17, ""), (None, "x")], "page long, url string")
    a = spark.createDataFrame([(1, "17", "", "2024"), (2, "", "", "2024")], "app long, job_url string, application_id string, updated string")
    assert {tuple(r)[1:] for r in page_matches(p, a, "page", "url", "app", "job_url", "application_id", "updated").collect()} == {(0, "", 0, None, None, False)}
