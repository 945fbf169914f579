"""What several results, or several rows, read of a text is computed once, with the same results."""

import time

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import joins, postings, verification
from siltstone.operators.retrieval import contains_phrase, ochiai, tokens
from siltstone.plans import catalogue
from siltstone.sources import adapters

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_section_without_its_end_is_looked_for_once(spark):
    df = spark.createDataFrame([(0, "Experience " * 100_000)], "i int, t string")
    began = time.time()
    assert df.select(F.length(T.section(F.col("t"), "experience", "never-there"))).first()[0] == 5000
    assert time.time() - began < 20
    odd = spark.createDataFrame([(0, "a EXPERIENCE b experience c Design d design"), (1, "experience\nx"), (2, "design"), (3, None), (4, "experiencedesign"), (5, "design experience")], "i int, t string")
    assert [r[1] for r in sorted(odd.select("i", T.section(F.col("t"), "experience", "design|plan")).collect())] == [" b experience c ", "\nx", "", "", "", ""]


def test_equal_texts_are_read_once(spark):
    for name in ("text_sections", "rubric_flavours", "direct_overlap"):
        assert "Aggregate" in plan(catalogue.queries()[name](spark, SMALL))
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, "")], "id int, t string")
    assert sorted(map(tuple, joins.read_once(rows, ["t"], {"n": F.length(F.coalesce("t", F.lit("none")))}).select("id", "n").collect())) == [(1, 1), (2, 4), (3, 1), (4, 0)]


def test_terms_overlap_as_their_patterns_do(spark):
    texts = ["machine learning", "Machine-Learning, R", "machine learnings", "c++ and .net", "c+", "net.", "统计分析 r", "统计", "", " ", None, "a\u0001b", "b", "x$0", "R", "or", "sas/r"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    old = F.when(contains_phrase(F.col("b"), F.col("a")) | contains_phrase(F.col("a"), F.col("b")), 1.0).otherwise(ochiai(tokens(F.col("a")), tokens(F.col("b"))))
    new = postings.term_overlap(F.array("a"), F.col("b"))
    assert df.where(~old.eqNullSafe(new)).count() == 0
    assert plan(df.select(new.alias("x"))).count("[\\.*+?^${}()|") == 0


def test_pages_and_snapshots_are_normalized_once(spark):
    rows = spark.createDataFrame([("t", "", "u", "u", 200, "page", None, None, None)], "title string, application_id string, official_url string, final_url string, status_code int, page_text string, posting_title string, posting_description string, posting_id string")
    assert plan(verification.verify(rows)).count("page_text") < 30
    given = spark.createDataFrame([("1", "Statistician", "x")], "source_id string, jobName string, jd string")
    assert plan(adapters.from_snapshot(given, "s")).count("jobName") < 20
