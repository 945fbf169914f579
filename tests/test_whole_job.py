"""Cases in which an operator once did less than its whole job."""

import datetime

from pyspark.sql import functions as F

from siltstone.functions import rules as R
from siltstone.operators import dedup
from siltstone.plans import catalogue

POST = "id int, company string, title string, location string, job_url string, canonical_url string, application_id string, seen int, rank double"


def test_display_dedup_holds_a_long_chain_together(spark):
    rows = []
    for i in range(14):  # plain row, then two of one stable id, the second with the next plain row's URL
        here, after = f"https://x.com/{'a' * (i + 1)}", f"https://x.com/{'a' * (i + 2)}"
        rows += [(here, ""), (f"https://acme.com/jobs/{1000 + i}", here), (f"https://acme.com/jobs/{1000 + i}", after)]
    rows = [(i, "", "Analyst", "", job, canonical, "", i, 1.0) for i, (job, canonical) in enumerate(rows)]
    df = spark.createDataFrame(rows, POST)
    pairs = {(r.a, r.b) for r in dedup.same_posting_pairs(df, displayed=True).collect()}
    assert {(i, i + 1) for i in range(len(rows) - 1)} <= pairs
    kept = []
    for i in range(len(rows)):
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    assert sorted(r.id for r in dedup.greedy_display(df, "seen", "rank").collect()) == kept


def test_each_deadline_signal_has_its_own_window(spark):
    gap = "x " * 50
    texts = [
        f"Deadline policy {gap} Closing date {gap} 2024-05-01",
        f"Deadline policy {gap} {gap} 2024-05-01",
        "Applications close 05-31-2024",
        "Last date to apply: 5.31.2024",
        "报名截止2024 年 5 月 1 日",
        "Deadline\n\n   May 2nd, 2024",
        "Deadline decided 5 2024",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", R.deadline(F.col("t")).alias("x"))
    got = [r.x for r in sorted(df.collect())]
    d = datetime.date
    assert got == [d(2024, 5, 1), None, d(2024, 5, 31), d(2024, 5, 31), d(2024, 5, 1), d(2024, 5, 2), None, None]


def test_fold_merge_sees_whole_texts(spark, tmp_path):
    seen = []
    for i, tail in enumerate("ab"):
        row = [(5, "s", "en", f"the same first words, then {tail}", 28)]
        spark.createDataFrame(row, "doc_id long, source string, lang string, text string, n_chars long").write.parquet(f"{tmp_path}/{i}/documents.parquet")
        seen.append(catalogue.queries()["fold_merge"](spark, f"{tmp_path}/{i}").first().evidence)
    assert seen[0] != seen[1]
