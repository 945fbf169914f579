import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

AT = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    from test_decontaminate_brute import leaked
    from test_jaccard import brute

    kept, now = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, AT)
        assert out.columns == docs.columns
        rows = [tuple(r) for r in out.collect()]
        kept[name] = {r[0]: r[1] for r in rows}
        now = spark.createDataFrame(rows, docs.schema)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["language_id"]) == {i for i, t in text.items() if any(c.isalpha() for c in t or "")}
    classes = brute(kept["language_id"])
    assert set(kept["jaccard_join"]) == {i for i, (c, _) in classes.items() if c == i}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{AT}/benchmark.parquet").collect()}
    assert set(kept["decontamination"]) == set(kept["jaccard_join"]) - {i for i, _ in leaked(kept["jaccard_join"], items)}
    assert set(kept["pii"]) == set(kept["decontamination"])
    assert any("[EMAIL]" in t for t in kept["pii"].values())
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, now, AT).collect()} == set(kept["pii"])


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, AT)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0
    empty = spark.read.parquet(f"{AT}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, AT).count() == 0


def test_odd_rows_pass_every_stage(spark):
    prose = [r.text for r in spark.read.parquet(f"{AT}/documents.parquet").where("lang = 'en' and length(text) > 300").limit(3).collect()]
    rows = [
        (1, prose[0], "en", "a", 1), (1, prose[0], "en", "a", 1), (2, prose[0], "en", None, None), (None, prose[1], "en", "a", 2), (3, None, "en", "a", 3), (4, "", None, "a", 4),
        (5, prose[2] + " " + " ".join([prose[1]] * 300), "en", "b", 5), (6, "1234 !?", "en", "b", 6),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ["version", "toks", "seed", "rep", "sig", "comp", "lang_pred", "queue", "block", "base", "class_id"]
    from pyspark.sql import functions as F

    learned = spark.read.parquet(f"{AT}/documents.parquet").where("lang is not null").select(*[c.split()[0] for c in schema.split(", ")])
    now = learned.withColumn("doc_id", F.col("doc_id") + 100_000).unionByName(spark.createDataFrame(rows, schema)).select("*", *[F.lit("x").alias(c) for c in extra])
    columns, ids = now.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, AT)
        assert out.columns == columns
        kept = [r for r in out.collect() if r.doc_id is None or r.doc_id < 100_000]
        ids[name] = sorted(str(r.doc_id) for r in kept)
        now = spark.createDataFrame(out.collect(), out.schema)
    assert ids["language_id"] == ["1", "1", "2", "5", "None"]
    assert "2" not in ids["jaccard_join"] and "None" in ids["jaccard_join"]
    assert corpus_pipeline.STAGES[-1][1](spark, now, AT).count() > 0
