"""Running totals over a global order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.names import fresh
from siltstone.store import Table


def numbered(df: DataFrame, order: Sequence[Column], row: str, sums: dict[str, Column]) -> Table:
    """df as a table with `row`, the row's number from 1 in the given order, and for each of `sums` the running total, the row's own included.

    Rows are dealt out by ranges of the order. Each range is numbered by itself and starts from the totals of the ranges
    before it, which are one small row each. Rows of equal order get numbers of their own, in any order among them.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, seq = fresh(df, "part"), fresh(df, "seq")
    # The place within a range is fixed by being written: a second look at rows of equal order finds the same.
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()).withColumn(seq, F.monotonically_increasing_id())
    dealt = Table(placed, "ranges")
    local = {name: F.sum(c) for name, c in {row: F.lit(1).cast("long"), **sums}.items()}
    totals = dealt.df.groupBy(part).agg(*[c.alias(f"t{i}") for i, c in enumerate(local.values())])
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # a row per range
    starts = totals.select(F.col(part).alias("start_of"), *[F.coalesce(F.sum(f"t{i}").over(before), F.lit(0)).alias(f"b{i}") for i in range(len(local))])
    here = W.partitionBy(part).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    run = dealt.df.select("*", *[c.over(here).alias(fresh(df, f"r{i}")) for i, c in enumerate(local.values())])
    run = run.join(F.broadcast(starts), F.col(part) == F.col("start_of"))
    out = Table(run.select(*[c for c in dealt.df.columns if c not in (part, seq)], *[(F.col(fresh(df, f"r{i}")) + F.col(f"b{i}")).alias(name) for i, name in enumerate(local)]), "numbered")
    dealt.drop()
    return out
