"""Connected components by alternating large-star and small-star rounds; nothing comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.store import Table

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (64-bit ids). Returns node, component (the smallest id reachable) for every node of an edge.

    Minima are combined before the shuffle, and joins on a hub can be split, so a hub needs no task of its
    own. Each round is a table in the shared folder; the rounds end when the edges stay as they are.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = Table(pairs, "components")
    for _ in range(MAX_ROUNDS):
        both = now.df.select("u", "v").unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = small.select("e.u", "e.v").where("u <> v").distinct()
        new = Table(small, "components")
        mark = lambda t: tuple(t.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        same = mark(new) == mark(now)
        now.drop()
        now = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
