"""Sinks: JSON, CSV and Parquet exports, batched files, grouped sync and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.names import column, fresh

LIST_SEPARATOR = " | "


def write_json(df: DataFrame, path: str, receipt: DataFrame | None = None) -> None:
    """K1: rows as JSON Lines, and a one-row receipt beside them. The commit protocol makes both appear whole."""
    df.write.mode("overwrite").json(path)
    if receipt is not None:
        receipt.coalesce(1).write.mode("overwrite").json(f"{path}.receipt")


def write_csv(df: DataFrame, path: str) -> None:
    """K2: CSV with list columns joined by a separator."""
    flat = [F.array_join(c, LIST_SEPARATOR).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export(df: DataFrame, path: str, kind: str) -> None:
    """Csv, json or parquet."""
    {"csv": write_csv, "json": write_json, "parquet": lambda d, p: d.write.mode("overwrite").parquet(p)}[kind](df, path)


def write_batches(df: DataFrame, ordinal: str, path: str, most_rows: int = 40, most_bytes: int = 1_000_000) -> DataFrame:
    """K4 as files: one folder per batch, rows in order inside; returns the batch sizes."""
    from siltstone.operators.merge import split_batches

    name = fresh(df, "line")
    rows = df.withColumn(name, F.to_json(F.struct(*[column(c) for c in df.columns])))
    numbered = split_batches(rows, ordinal, name, most_rows, most_bytes)
    files = numbered.select("batch", F.col(name).alias("value"), column(ordinal).alias("at")).repartition("batch").sortWithinPartitions("batch", "at", "value")
    files.select("batch", "value").write.mode("overwrite").partitionBy("batch").text(path)
    return numbered.groupBy("batch").agg(F.count("*").alias("n"))


def sync_messages(rows: DataFrame, complete: DataFrame, source: str = "source", size: int = 50) -> DataFrame:
    """Chunks of up to `size` rows per source, then one reconciliation message for each complete source."""
    from pyspark.sql import Window as W

    # Rows are numbered within hash buckets of a source, so that no source is numbered by one task.
    bucket = F.pmod(F.xxhash64(F.to_json(F.struct(*rows.columns))), F.lit(64))
    n = F.row_number().over(W.partitionBy(source, "__b").orderBy("__j")) - 1
    numbered = rows.select(source, F.to_json(F.struct(*rows.columns)).alias("__j"), bucket.alias("__b")).withColumn("chunk", F.floor(n / size))
    chunks = numbered.groupBy(source, "__b", "chunk").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("__j")).alias("payload"))
    none = F.array().cast("array<string>")
    done = complete.select(source).distinct().select(source, F.lit("reconcile").alias("kind"), F.lit(0).cast("bigint").alias("n"), none.alias("payload"))
    return chunks.select(source, F.lit("rows").alias("kind"), "n", "payload").unionByName(done)
