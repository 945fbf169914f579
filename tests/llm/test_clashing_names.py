"""Every stage of the pipeline with input columns of the names that operators use inside."""

import corpus_pipeline
from siltstone.llm import langid

AT = "/root/testdata/sf0.001"
NAMES = ["leak", "__leak", "gone", "__gone", "judged", "__judged", "judged_lang", "__lang", "judged_score", "__score", "pii", "__pii", "sig", "rep", "toks", "a.b", "LEAK_", "h", "l", "k"]


def odd(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    return docs, docs.selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in NAMES])


def test_each_stage_keeps_columns_of_any_name(spark):
    docs, more = odd(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = sorted(tuple(r) for r in stage(spark, docs, AT).select("doc_id", "text", "n_chars").collect())
        out = stage(spark, more, AT)
        assert out.columns == more.columns, name
        rows = out.collect()
        assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in rows) == want, name
        assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in NAMES), name


def test_packing_reads_no_other_column(spark):
    docs, more = odd(spark)
    pack = corpus_pipeline.STAGES[-1][1]
    of = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in pack(spark, df, AT).collect())
    assert of(docs) == of(more)


def test_predict_replaces_its_own_outputs_alone(spark):
    filters = langid.fit(spark.read.parquet(f"{AT}/documents.parquet"))
    df = spark.createDataFrame([("hello there", 1, 2, 3)], "text string, judged int, judged_ int, lang_pred int")
    out = langid.predict(df, filters)
    assert sorted(out.columns) == ["judged", "judged_", "lang_pred", "score", "text"] and out.first()["judged"] == 1
