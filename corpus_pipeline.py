"""A training-data pipeline over `documents`: each stage's output is written as Parquet and read by the next.

Language ID rejects documents without letters or of no known language; the Jaccard join keeps the
smallest id of each group of near copies; decontamination drops documents with benchmark passages; PII
redacts the spans it finds; packing returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, jaccard, langid, packing, pii
from siltstone.names import fresh
from siltstone.store import Table, drop_folder, run_tables

# Share of known n-grams. Held-out labelled documents of all tables score 0.706 (a 70-character one with a key in it)
# and more; hex strings up to 0.676 and unlearned languages up to 0.679 (Dutch): the cut lies between.
MIN_LANGUAGE_SCORE = 0.69


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows whose text is in a learned language, judged row by row.

    Null and empty texts, texts without letters, and texts under MIN_LANGUAGE_SCORE go. Repeated rows are
    judged alike and all stay or go. Very long texts are read whole. Other columns, null or of any name,
    stay as they are; without labelled rows nothing is learned and nothing stays; empty gives empty.
    """
    filters = langid.fit(docs.where(~langid.held_out("doc_id")))
    lang, score = fresh(docs, "judged_lang"), fresh(docs, "judged_score")
    judged = langid.predict(docs, filters, lang_out=lang, score_out=score)
    return judged.where((F.col(lang) != langid.UND) & (F.col(score) >= MIN_LANGUAGE_SCORE)).drop(lang, score)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows of the smallest id of each class of near copies (whole texts, five words, 0.8).

    Texts without words are in no class and stay, and so do rows of a null id. Rows of one id are one
    document, judged by the text of the smallest digest: they stay or go together. Empty gives empty.
    """
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of `benchmark`.

    Null and empty texts hold none and stay; rows of a null id stay; rows of one id go together if any of
    them holds a passage. An empty benchmark drops nothing; empty gives empty.
    """
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each span of personal data by its kind in brackets, in whole texts; n_chars, where there is one, follows.

    Every row stays; a null text stays null, an empty one empty; equal rows give equal rows.
    """
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences (see packing.pack): a null text gives the end id alone, a null source is a
    queue of its own, repeated rows are documents of their own, a very long text is cut over many sequences,
    other columns are not read, empty gives empty.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("pii", redact_pii),
    ("packing", pack),
]

ORACLE_SQL = None  # language ID and the tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result is a table in the shared folder; the tables of earlier stages are deleted once the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES:
        with run_tables() as made:
            out = Table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        for uri in [*before, *made]:
            if uri != out.uri:
                drop_folder(spark, uri)
        docs, before = out.df, [out.uri]
    return docs
