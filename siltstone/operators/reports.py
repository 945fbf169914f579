"""Aggregations and report shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def count_if(test: Column) -> Column:
    return F.count_if(test).cast("bigint")


def ordered_distinct(df: DataFrame, key: str, value: str, order: str, out: str) -> DataFrame:
    """Per key the distinct values in order of first appearance (equal places: the smaller value). Null values are left out.

    Each value's first place is a minimum that is combined before the shuffle, so a key holds its distinct values alone.
    """
    first = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.min(order).alias("o"))
    return first.groupBy(F.col("k").alias(key)).agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "v"))), lambda p: p["v"]).alias(out))


def histogram(df: DataFrame, reason: str) -> DataFrame:
    """A4: counts per reason as one sorted map."""
    counts = df.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(reason, "n")))).alias("reasons"))


def sum_maps(df: DataFrame, counters: str) -> DataFrame:
    """Add counter maps key by key."""
    return df.select(F.explode(counters).alias("counter", "n")).groupBy("counter").agg(F.sum("n").alias("total"))


def counts_with_zero(df: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """A2: rows per key, with zero for known keys without rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return known.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1, clamped to the pages there are) of the ordered rows; sorted top-k, no global window."""
    total = df.count()
    number = max(1, min(number, -(-total // size) or 1))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def keep_last_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows of a history."""
    return df.orderBy(F.desc(order)).limit(n)


def top_with_ties(df: DataFrame, key: str, score: str, n: int) -> DataFrame:
    """Rows that reach the n-th highest score of their key; all rows if there are fewer."""
    return df.withColumn("__r", F.rank().over(W.partitionBy(key).orderBy(F.desc(score)))).where(F.col("__r") <= n).drop("__r")


def funnel(events: DataFrame, entity: str, stage: str, stages: Sequence[str]) -> DataFrame:
    """Entities that ever reached each stage or a later one, with step conversion in tenths of a percent."""
    rank = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col(stage))
    best = events.groupBy(entity).agg(F.max(rank).alias("best"))
    counts = best.agg(*[count_if(F.col("best") >= i + 1).alias(s) for i, s in enumerate(stages)])
    rows = counts.select(F.posexplode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("n")) for s in stages])).alias("i", "s"))
    rows = rows.select((F.col("i") + 1).alias("step"), "s.stage", "s.n")
    before = F.lag("n").over(W.orderBy("step"))
    return rows.withColumn("conversion", F.when(before > 0, F.floor(F.col("n") * 1000 / before + 0.5) / 10))


def rule_support(rules: DataFrame, rows: DataFrame, text: str, positive: str, pattern: str = "pattern", at_once: int = 200) -> DataFrame:
    """How many positive and negative rows each candidate pattern finds.

    rules is a configuration table; its patterns become constants, `at_once` of them counted in one aggregate
    over the rows, so each is compiled once and no pair of a row and a rule is formed.
    """
    found, known = None, sorted({r[0] for r in rules.select(pattern).where(F.col(pattern).isNotNull()).collect()})
    for a in range(0, len(known), at_once):
        part = known[a : a + at_once]
        hits = [(p, F.col(text).rlike(p)) for p in part]
        counts = rows.agg(*[c.alias(f"{k}{i}") for i, (_, hit) in enumerate(hits) for k, c in (("p", count_if(hit & F.col(positive))), ("n", count_if(hit & ~F.col(positive))))])
        each = F.array(*[F.struct(F.lit(p).alias(pattern), F.col(f"p{i}").alias("positives"), F.col(f"n{i}").alias("negatives")) for i, p in enumerate(part)])
        one = counts.select(F.inline(each))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return rules.select(pattern, F.lit(0).cast("bigint").alias("positives"), F.lit(0).cast("bigint").alias("negatives"))
    return rules.join(F.broadcast(found), pattern, "left").na.fill(0, ["positives", "negatives"])  # a row per rule


# Points of evidence classes in the fit score.
EVIDENCE_POINTS = {"Direct": 1.0, "Credential Direct": 1.0, "Strong Transferable": 0.76, "Coursework Match": 0.58, "Adjacent": 0.28, "Credential Status Gap": 0.16, "No Evidence": 0.0}


def fit_score(matches: DataFrame, key: str, points: dict[str, float] = EVIDENCE_POINTS) -> DataFrame:
    """Coverage percentages, a weighted blend, and caps for a large unsupported share.

    matches: key, keyword, status, classification, confidence.
    """
    c = F.col("classification")
    point = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in points.items() for x in kv]), c), F.lit(0.0))
    usable = matches.where((F.coalesce("keyword", F.lit("")) != "") | (F.coalesce("status", F.lit("")) != "") | (F.coalesce(c, F.lit("")) != ""))
    percent = lambda x: F.greatest(F.lit(0), F.least(F.lit(100), F.floor(x + 0.5)))
    a = usable.groupBy(key).agg(
        F.count("*").alias("total"),
        F.sum(point).alias("points"),
        F.sum(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("confidence", F.lit(0.0))))).alias("sure"),
        count_if(F.col("status") == "covered").alias("covered"),
        count_if(c.isin("Direct", "Credential Direct")).alias("direct"),
        count_if(c == "Strong Transferable").alias("transferable"),
        count_if(c == "Coursework Match").alias("coursework"),
        count_if(c.isin("Adjacent", "Credential Status Gap")).alias("adjacent"),
    )
    a = a.withColumn("unsupported", F.col("total") - F.col("direct") - F.col("transferable") - F.col("coursework") - F.col("adjacent"))
    a = a.withColumns(
        {
            "evidence_coverage": percent(F.col("points") / F.col("total") * 100),
            "direct_coverage": percent(F.col("direct") / F.col("total") * 100),
            "transferable_coverage": percent((F.col("direct") + F.col("transferable") + F.col("coursework")) / F.col("total") * 100),
            "cv_coverage": percent(F.col("covered") / F.col("total") * 100),
            "gap_risk": percent((F.col("unsupported") + F.col("adjacent") * 0.45) / F.col("total") * 100),
            "confidence": percent(F.col("sure") / F.col("total")),
        }
    )
    blend = percent(F.col("evidence_coverage") * 0.55 + F.col("direct_coverage") * 0.15 + F.col("cv_coverage") * 0.10 + F.col("confidence") * 0.10 + (100 - F.col("gap_risk")) * 0.10)
    share = F.col("unsupported") / F.col("total")
    score = F.when(share >= 0.6, F.least(blend, F.lit(49))).when(share >= 0.4, F.least(blend, F.lit(64))).otherwise(blend)
    return a.withColumn("score", score).drop("points", "sure")


def reminders(items: DataFrame, item: str, due: str, today: Column, days: Sequence[int] = (14, 7, 3, 1, 0)) -> DataFrame:
    """Items whose due date is exactly one of the lead times ahead."""
    left = F.datediff(F.col(due), today)
    return items.select(item, due, left.alias("days_left")).where(F.col("days_left").isin(*days))
