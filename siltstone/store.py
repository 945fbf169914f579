"""Shared-folder storage: tables that cut lineage, and plain files that executors write."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_root(spark: SparkSession) -> str:
    """The shared folder, from spark.checkpoint.dir; where none is set, a folder in the warehouse.

    A warehouse on a local disk is shared on one machine only: on a cluster it raises an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_siltstone"
    if not spark.conf.get("spark.master", "local").startswith("local"):
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.getScheme() == "file":
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share: {root} is a disk of each")
    return root


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below the shared folder, as a full URI."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toString()


def drop_folder(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs inside; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("tables of this run", default=None)


@contextlib.contextmanager
def run_tables() -> Iterator[list[str]]:
    """The folders of all tables made inside, by this thread, and not yet dropped."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


class Table:
    """A DataFrame written to the shared folder; `df` reads it back, `drop` deletes it.

    Shuffle files of the write go as soon as it has ended. `batch_rows` bounds the rows of an Arrow batch.
    """

    def __init__(self, df: DataFrame, tag: str, batch_rows: int = 1000):
        self.spark = df.sparkSession
        self.uri = new_folder(self.spark, tag)
        with settings(self.spark, {_FILE_CLEANUP: "true", _BATCH_ROWS: str(batch_rows)}):
            df.write.parquet(self.uri)
        self.made = _made.get()
        if self.made is not None:
            self.made.append(self.uri)
        self.df = self.spark.read.schema(df.schema).parquet(self.uri)

    def drop(self) -> None:
        drop_folder(self.spark, self.uri)
        if self.made is not None and self.uri in self.made:
            self.made.remove(self.uri)
