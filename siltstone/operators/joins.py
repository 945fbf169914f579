"""Join shapes of the application store: disjunctive, prioritized, multi-key, ranked and fuzzy joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import urls as U

BROADCAST_ROWS = 100_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast only what is known to have at most `limit` rows; beyond that the planner chooses."""
    return F.broadcast(df) if df.count() <= limit else df


def read_once(rows: DataFrame, keys: Sequence[str], results: dict[str, Column]) -> DataFrame:
    """Rows with `results`, expressions over the columns `keys` alone that are worth more than a join: equal keys are read once and joined back (nulls too)."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated: few texts can be much work
    found = rows.select(*keys).distinct().repartition(tasks, *keys).select(*[F.col(k).alias(f"__{k}") for k in keys], *[c.alias(n) for n, c in results.items()])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(found, same).drop(*[f"__{k}" for k in keys])


def or_equi_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: Sequence[tuple[Column, Column]], how: str = "left") -> DataFrame:
    """Join on any of several equalities, as a union of equi-joins over distinct id pairs.

    keys: (expression over left, expression over right); null or empty values never match. The fan-out of the
    disjunction stays: a left row pairs with each right row that any key matches, once.
    """
    pairs = None
    for a, b in keys:
        one = left.select(F.col(left_id).alias("__l"), a.alias("__k")).where("__k is not null and __k <> ''").join(
            right.select(F.col(right_id).alias("__r"), b.alias("__k")).where("__k is not null and __k <> ''"), "__k"
        ).select("__l", "__r")
        pairs = one if pairs is None else pairs.unionByName(one)
    pairs = pairs.distinct()
    if how in ("left_semi", "left_anti"):
        return left.join(pairs.select("__l").distinct(), F.col(left_id) == F.col("__l"), how)
    return left.join(pairs, F.col(left_id) == F.col("__l"), how).join(right, F.col("__r") == right[right_id], how).drop("__l", "__r")


def prioritized_lookup(left: DataFrame, right: DataFrame, left_id: str, keys: Sequence[tuple[Column, Column]], value: str, order: str) -> DataFrame:
    """Per left row the value of the first key that finds one; the first right row in `order` wins."""
    out, names = left, []
    for i, (a, b) in enumerate(keys):
        best = right.select(b.alias("__k"), F.col(value).alias("__v"), F.col(order).alias("__o")).where("__k is not null")
        best = best.groupBy("__k").agg(F.min_by("__v", "__o").alias(f"__v{i}"))
        out = out.withColumn("__a", a).join(best, F.col("__a") == F.col("__k"), "left").drop("__a", "__k")
        names.append(f"__v{i}")
    rule = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(i + 1)) for i, n in enumerate(names)], F.lit(0))
    return out.select(*left.columns, F.coalesce(*names).alias(value), rule.alias("matched_rule"))


def multi_key_lookup(left: DataFrame, keys: Column, right: DataFrame, right_key: str, left_id: str) -> DataFrame:
    """Left rows hold an array of keys; the first key in order that the right side knows wins."""
    spread = left.select(F.col(left_id).alias("__id"), F.posexplode(keys).alias("__p", "__k"))
    rest = [c for c in right.columns if c != right_key]
    hit = spread.join(right, F.col("__k") == F.col(right_key)).groupBy("__id").agg(F.min_by(F.struct(F.col("__k").alias("matched_key"), *rest), "__p").alias("__m"))
    return left.join(hit, F.col(left_id) == F.col("__id"), "left").select(*left.columns, "__m.*")


def unique_best(scored: DataFrame, key: str, score: str, at_least: float) -> DataFrame:
    """The top row of a key, if it is alone at the top and reaches `at_least`."""
    top = scored.withColumn("__r", F.rank().over(W.partitionBy(key).orderBy(F.desc(score)))).where("__r = 1").drop("__r")
    alone = top.withColumn("__n", F.count("*").over(W.partitionBy(key))).where("__n = 1").drop("__n")
    return alone.where(F.col(score) >= at_least)


def contains_join(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of which one text holds the other (equal ones too), ignoring case; empty texts never match.

    No nested loop: what a text holds has all its grams of up to three characters there too, so the shorter
    one is posted under its smallest such gram and the longer one under all of its own. Equal texts are compared
    once and their rows joined to the pairs. The joins sort: the planner takes the size of texts for that of
    their grams, and would send these through the driver.
    """
    x, y = F.lower(F.col(a)), F.lower(F.col(b))

    def grams(c, n):
        last = F.length(c) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(1), F.greatest(last + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    every = lambda c: F.array_distinct(F.concat(grams(c, 1), grams(c, 2), grams(c, 3)))
    one = lambda c: F.array_min(F.when(F.length(c) >= 3, grams(c, 3)).when(F.length(c) == 2, grams(c, 2)).otherwise(grams(c, 1)))
    xs, ys = left.select(x.alias("__x")).where("__x <> ''").distinct(), right.select(y.alias("__y")).where("__y <> ''").distinct()
    cx, cy = F.col("__x"), F.col("__y")
    held = xs.withColumn("__g", F.explode(every(cx))).hint("merge").join(ys.withColumn("__g", one(cy)), "__g").where(cx.contains(cy)).select("__x", "__y")
    holds = xs.withColumn("__g", one(cx)).join(ys.withColumn("__g", F.explode(every(cy))).hint("merge"), "__g").where(cy.contains(cx) & (cx != cy)).select("__x", "__y")
    pairs = held.unionByName(holds).hint("merge")
    return left.withColumn("__x", x).join(pairs, "__x").join(right.withColumn("__y", y).hint("merge"), "__y").drop("__x", "__y")


def saved_flags(jobs: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """Each job once, with whether it is saved."""
    marks = saved.select(key).distinct().withColumn("__s", F.lit(True))
    return jobs.join(marks, key, "left").withColumn("saved", F.coalesce("__s", F.lit(False))).drop("__s")


def alias_lookup(rows: DataFrame, company: Column, pool: DataFrame, pool_company: str, pool_keys: Column, order: str) -> DataFrame:
    """Rows with `pool_company`, the company of the pool that one of whose keys equals the row's; the first in `order` wins."""
    keys = pool.select(F.explode(pool_keys).alias("__k"), F.col(pool_company).alias("__c"), F.col(order).alias("__o")).where("__k <> ''")
    best = keys.groupBy("__k").agg(F.min_by("__c", "__o").alias(pool_company))
    return rows.withColumn("__a", company).join(best, F.col("__a") == F.col("__k"), "left").drop("__a", "__k")


def without_match(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """Left rows whose key the right side lacks; null keys stay."""
    known = right.select(right_key.alias("__k")).where("__k is not null").distinct()
    return left.withColumn("__l", left_key).join(known, F.col("__l") == F.col("__k"), "left_anti").drop("__l")


# The tiers of a page's match with an application, and the score from which a match counts.
TIERS = (("exact-url", 100), ("stable-job-id", 95), ("canonical-url", 80), ("same-host", 20))
LEAST_TIER = 80


def page_matches(pages: DataFrame, applications: DataFrame, page_id: str, url: str, row_id: str, job_url: str, application_id: str, updated: str) -> DataFrame:
    """Pages with score (100, 95, 80, 20 or 0), reason, n_tied, `recent` (the latest application of the page's best tier), matched and ambiguous.

    A page's tier is the best at which any application meets it: by the URL itself, the stable id, the canonical URL, the host.
    The application counts as matched if it is alone there and the tier has 80 points at least; several are ambiguous.
    Applications are first combined to one row per tier and key, so a host of any size is one row, and a page asks a tier
    only for what the tiers above did not give; pages that ask nothing are dealt by their id, as nulls would all go to one
    task. Null and empty keys meet nothing; of equal times the larger id is the later one.
    """
    keys = lambda u, given: (u, U.stable_id(u, given), U.canonical_url(u, U.IDENTITY), U.host(u))
    clean = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    asked, given = keys(F.col(url), None), keys(F.col(job_url), F.col(application_id))
    out = pages.select(F.col(page_id), *[clean(k).alias(f"k{i}") for i, k in enumerate(asked)], F.lit(0).alias("score"), F.lit(0).cast("long").alias("n_tied"), F.lit(None).cast(dict(applications.dtypes)[row_id]).alias("recent"))
    for i, (_, points) in enumerate(TIERS):
        # explode: the key is worked out once, not in a filter too
        known = applications.select(F.explode(F.array(clean(given[i]))).alias("t_key"), F.col(row_id).alias("row"), F.coalesce(updated, F.lit("")).alias("at")).where("t_key is not null")
        tier = known.groupBy("t_key").agg(F.count("*").alias("t_n"), F.max_by("row", F.struct("at", "row")).alias("t_recent"))
        asks = (F.col("score") == 0) & F.col(f"k{i}").isNotNull()
        out = out.withColumns({"__asks": asks, "__key": F.when(asks, F.col(f"k{i}")).otherwise(F.coalesce(F.col(page_id).cast("string"), F.lit("")))}).join(tier, (F.col("__key") == F.col("t_key")) & F.col("__asks"), "left")
        hit = F.col("t_key").isNotNull()
        out = out.withColumns({"score": F.when(hit, points).otherwise(F.col("score")), "n_tied": F.coalesce("t_n", "n_tied"), "recent": F.coalesce("t_recent", "recent")}).drop("t_key", "t_n", "t_recent", "__asks", "__key")
    counts = F.col("score") >= LEAST_TIER
    reason = F.coalesce(*[F.when(F.col("score") == points, reason) for reason, points in TIERS], F.lit(""))
    return out.select(page_id, "score", reason.alias("reason"), "n_tied", "recent", F.when(counts & (F.col("n_tied") == 1), F.col("recent")).alias("matched"), (counts & (F.col("n_tied") > 1)).alias("ambiguous"))
