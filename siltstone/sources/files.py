"""File sources: JSON arrays, JSON Lines, CSV/TSV, manifests and directories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from siltstone.operators.joins import small


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, asked of the file system that Spark reads it with."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_json_list(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A file that holds one array of objects. A missing or malformed file, or one that holds no list, is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    whole = spark.read.text(path, wholetext=True).select(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>").alias("rows"))
    rows = whole.select(F.explode("rows").alias("v")).select(F.to_json("v").alias("j")).where(F.col("j").startswith("{"))
    return rows.select(F.from_json("j", schema).alias("r")).select("r.*")


def read_json_document(spark: SparkSession, path: str, schema: StructType, default: dict | None = None) -> DataFrame:
    """S3: one object, or a row of defaults where the file is missing or malformed."""
    empty = spark.createDataFrame([tuple((default or {}).get(f.name) for f in schema.fields)], schema)
    if not exists(spark, path):
        return empty
    found = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return empty if found.isEmpty() else found


def read_json_lines(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """JSON Lines; blank lines are skipped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


_FORMATS = {".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv", ".tsv": "tsv"}


def read_any(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """JSON, JSON Lines, CSV and TSV files as one table of strings; byte-order marks are dropped."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    out = spark.createDataFrame([], schema)
    for path in paths:
        kind = _FORMATS.get(path[path.rfind(".") :].lower())
        if kind == "json":
            one = read_json_list(spark, path, schema)
        elif kind == "jsonl":
            one = spark.read.schema(schema).json(path)
        elif kind in ("csv", "tsv"):
            one = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", "\t" if kind == "tsv" else ",").csv(path)
            one = one.toDF(*[c.lstrip("\ufeff") for c in one.columns])
            one = one.select(*[F.col(f"`{c}`") for c in one.columns if c in columns])
        else:
            raise ValueError(f"unknown format: {path}")
        out = out.unionByName(one, allowMissingColumns=True)
    return out.select(*columns)


def read_directory(spark: SparkSession, folder: str, suffix: str, schema: StructType | None = None, newer_than: str | None = None) -> DataFrame:
    """All files of a suffix below a folder, optionally only those modified after a run's marker; adds `file` and `modified`."""
    r = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
    if newer_than:
        r = r.option("modifiedAfter", newer_than)
    df = r.schema(schema).json(folder) if schema else r.json(folder)
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))


def latest_file(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The file modified last among those of a pattern."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


def read_manifest(spark: SparkSession, folder: str, manifest: str, schema: StructType) -> DataFrame:
    """Gzipped JSON Lines chunks that a manifest lists; one task per chunk, the chunk's name is kept."""
    names = [r["name"] for r in spark.read.json(f"{folder}/{manifest}", multiLine=True).select(F.explode("chunks").alias("name")).collect()]
    df = spark.read.schema(schema).json([f"{folder}/{n}" for n in names])
    return df.withColumn("chunk", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def unwrap(payload: str, paths: Sequence[str] = ("$.jobs", "$.data", "$.results")):
    """The first array that one of the paths holds in JSON text, or the text's own array, or the values of its map, as array<variant>."""
    v = F.try_parse_json(F.col(payload))
    found = [F.try_variant_get(v, p, "array<variant>") for p in paths]
    return F.coalesce(*found, F.try_variant_get(v, "$", "array<variant>"), F.map_values(F.try_variant_get(v, "$", "map<string,variant>")))


def query_plan(keywords: DataFrame, cities: DataFrame, cursor: int, batch: int) -> tuple[DataFrame, int]:
    """The next `batch` queries of keywords by cities from a cursor, wrapping around; and the next cursor.

    Both sides are configuration tables (order, keyword) and (order, city).
    """
    plan = keywords.select(F.col("order").alias("k"), "keyword").crossJoin(small(cities.select(F.col("order").alias("c"), "city")))
    n_cities = cities.count()
    total = keywords.count() * n_cities
    if not total:
        return plan.select("keyword", "city"), 0
    at = F.pmod(F.col("k") * n_cities + F.col("c") - cursor, F.lit(total))
    return plan.where(at < batch).orderBy(at).select("keyword", "city"), (cursor + min(batch, total)) % total


def company_dimension(base: DataFrame, more: DataFrame, key: str = "company", source: str = "source") -> DataFrame:
    """The union of two lists, one row per key; a row with a source is preferred, then the earlier one."""
    from siltstone.functions.text import company_key

    rows = base.withColumn("__o", F.lit(0)).unionByName(more.withColumn("__o", F.lit(1)), allowMissingColumns=True)
    rows = rows.withColumn("__k", company_key(F.col(key)))
    cols = [c for c in rows.columns if not c.startswith("__")]
    order = F.struct((F.coalesce(F.col(source), F.lit("")) == "").cast("int"), "__o", F.col(key))
    return rows.groupBy("__k").agg(F.min_by(F.struct(*cols), order).alias("r")).select("r.*")


def fenced_json(text: str, schema: str):
    """The first fenced JSON block of a Markdown text; null where it does not fit the schema."""
    return F.from_json(F.regexp_extract(F.col(text), r"(?s)```json\s*(\{.*?\})\s*```", 1), schema, {"mode": "PERMISSIVE"})
