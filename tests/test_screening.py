"""What tells the flavours of the screening rules apart."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import screening as S
from siltstone.sources import adapters as A

LONG_GAP = "we will not " + "x" * 45 + " sponsor"  # over 40 characters between the words, under 50


@pytest.mark.parametrize(
    ("text", "years"),
    [
        ("minimum 4 yrs", {"scan": 4, "server": None, "portal": None, "china": None, "collector": None}),
        ("至少 4 years", {"scan": None, "server": 4, "portal": None, "china": None, "collector": None}),
        ("5年及以上相关工作经验", {"scan": None, "server": 5, "portal": None, "china": None, "collector": None}),
        ("经验3-5年", {"scan": None, "server": None, "portal": None, "china": 5, "collector": 5}),
        ("需具备2年", {"scan": None, "server": None, "portal": 2, "china": None, "collector": 2}),
        ("7 years of professional experience, at least 2 years in R", {"scan": 7, "server": 7, "portal": 7, "china": None, "collector": 7}),
    ],
)
def test_years_by_flavour(spark, text, years):
    df = spark.createDataFrame([(text,), (None,)], "t string")
    got = df.select(*[S.required_years(F.col("t"), f).alias(f) for f in years]).collect()
    assert got[0].asDict() == years and set(got[1]) == {None}


def test_sponsorship_and_citizenship_by_flavour(spark):
    df = spark.createDataFrame([(LONG_GAP,), ("要求公民身份",)], "t string")
    c, none = F.col("t"), F.lit(None).cast("int")
    labels = [tuple(r) for r in df.select(S.sponsorship(c, "scan"), S.sponsorship(c, "server")).collect()]
    assert labels == [(S.BLOCKED, S.UNCLEAR), (S.UNCLEAR, S.UNCLEAR)]
    able = [tuple(r) for r in df.select(*[S.eligible(F.lit("t"), c, none, S.sponsorship(c, f), r) for f, r in (("scan", S.RUBRIC_SCAN), ("server", S.RUBRIC_US))]).collect()]
    assert able == [(False, True), (True, False)]


def test_server_titles_are_stored(spark):
    text = "PhD in biostatistics, clinical trial design, causal inference, R and Python, visa sponsorship available"
    rows = [(i, "Acme", t, "Boston", text, f"https://x.io/jobs/{i}", "", "board") for i, t in enumerate(["Machine Learning Scientist", "数据科学家", "Healthcare Consultant", "Plumber", "Biostatistician, Intern"])]
    c = spark.createDataFrame(rows, "source_id long, company string, title string, location string, content string, job_url string, application_id string, source string")
    kept = A.storable(c, spark.createDataFrame([], "fingerprint string")).collect()
    assert sorted((r.source_id, r.track) for r in kept) == [(0, "Pharma"), (1, "Pharma"), (2, "Pharma")]
    assert {tuple(r.skills)[:2] for r in kept} == {("Python", "R")}
