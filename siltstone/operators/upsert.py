"""Identity-aware upsert (K6 with D10): incoming postings find the stored ones that they are, or each other, and are merged field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.dedup import same_posting, with_identity
from siltstone.store import Table

# What counts as unknown, and a status that does not replace that of an open posting.
UNKNOWN_COMPANY, UNCLEAR_VISA, TO_VERIFY, OPEN = "待核验公司", "JD 未明确", "待官网核验", "开放"
FIELDS = ("company", "title", "location", "job_url", "canonical_url", "application_id", "score", "visa", "evidence", "description", "skills", "source", "status", "discovered_at")
_IDENTITY = ("company", "title", "location", "job_url", "canonical_url", "application_id", "original_url")
_KEYED = ("k_company", "k_title", "k_place", "k_stable", "k_url", "k_named")


def _keys(own: bool) -> Column:
    """The values by which candidates meet; an incoming row also looks for its original URL."""
    given = lambda tag, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(tag), c))
    named = F.when((F.col("company") != "") & (F.col("title") != ""), F.concat_ws("\u0001", F.lit("r"), "company", "title"))
    found = [given("u:", F.col("job_url")), given("c:", F.col("k_url")), given("a:", F.col("application_id")), named]
    return F.array_distinct(F.filter(F.array(*found, *([] if own else [given("u:", F.col("original_url"))])), lambda x: x.isNotNull()))


def _meet(a: DataFrame, b: DataFrame, later: bool) -> DataFrame:
    """a_node, b_node of the pairs that share a key and are one posting; with `later` only those of a before b."""
    x = a.withColumn("key", F.explode(_keys(True))).alias("a")
    y = b.withColumn("key", F.explode(_keys(False))).alias("b")
    on = F.col("a.key") == F.col("b.key")
    on = on & (F.col("a.node") < F.col("b.node")) if later else on
    return x.join(y, on).where(same_posting("a", "b")).select(F.col("a.node").alias("a_node"), F.col("b.node").alias("b_node"))


def assign(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Seq, target (a stored id, or null), head (the seq of the first incoming row of the same new posting).

    An incoming row is the stored posting of the smallest id among those that share a URL, canonical URL, application id, or
    company and title with it and that the identity predicate accepts; several may claim one. A row without one goes with the first earlier
    such incoming row, and where that one goes, by pointer jumping. Rows of equal identity are one node before any pair is formed.
    """
    i = with_identity(incoming)
    groups = i.groupBy(*_IDENTITY, *_KEYED).agg(F.min("seq").alias("node"))
    alone = ~same_posting("x", "x")  # such as placeholder titles without an id: equal rows are postings of their own
    nodes = Table(groups.alias("x").withColumn("alone", alone), "import-nodes").df
    s = with_identity(stored.withColumn("original_url", F.lit(""))).withColumnRenamed("id", "node")
    claimed = _meet(s, nodes, False).groupBy(F.col("b_node").alias("node")).agg(F.min("a_node").alias("target"))
    free = nodes.join(claimed, "node", "left_anti")
    first = _meet(free, free, True).groupBy(F.col("b_node").alias("node")).agg(F.min("a_node").alias("head"))
    heads = Table(free.select("node").join(first, "node", "left").select("node", F.coalesce("head", "node").alias("head")), "import-heads")
    while True:
        up = heads.df.select(F.col("node").alias("n2"), F.col("head").alias("h2"))
        new = Table(heads.df.join(up, F.col("head") == F.col("n2")).select("node", F.col("h2").alias("head")), "import-heads")
        moved = not new.df.join(heads.df.select("node", F.col("head").alias("old")), "node").where("head <> old").isEmpty()
        heads.drop()
        heads = new
        if not moved:
            break
    known = nodes.select("node", "alone", *_IDENTITY).join(claimed, "node", "left").join(heads.df, "node", "left")
    same = None
    for c in _IDENTITY:
        one = F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}"))
        same = one if same is None else same & one
    rows = i.alias("r").join(known.alias("k"), same)
    head = F.when(F.col("k.target").isNull(), F.when(F.col("k.alone"), F.col("r.seq")).otherwise(F.col("k.head")))
    return rows.select("r.seq", F.col("k.target").alias("target"), head.alias("head"))


def identity_upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """K6: the stored postings after the incoming ones: id (null for a new posting), head (of a new one), FIELDS, n_merged, change.

    stored: id and FIELDS; incoming: seq (unique, the order), original_url and FIELDS, skills an array of strings. Incoming rows of one
    posting are taken in order. The title is the last one; company and visa are the last known ones; location, evidence, description,
    skills, canonical URL and application id the last that are not empty; the score is the largest; the URL and the time of
    discovery stay; the source is the last one with a description, if there was a source before; a status that waits for verification does
    not replace an open one. All of these are aggregates that are combined before the shuffle, so a posting may be claimed by any number of rows.
    """
    none = F.array().cast("array<string>")
    old = stored.select(F.col("id").alias("target"), F.lit(None).cast("bigint").alias("head"), F.lit(-1).cast("bigint").alias("seq"), *FIELDS)
    new = incoming.join(assign(stored, incoming), "seq").select("target", "head", "seq", *FIELDS)
    every = old.unionByName(new).withColumn("skills", F.coalesce("skills", none))
    text = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    last = lambda c, test: F.max_by(c, F.when(test, F.col("seq")))
    first = lambda c: F.min_by(c, "seq")
    verified = F.col("status") != TO_VERIFY
    agg = {
        "company": F.coalesce(last("company", F.col("company") != UNKNOWN_COMPANY), first("company")),
        "title": last("title", F.lit(True)),
        **{c: F.coalesce(last(c, text(c)), first(c)) for c in ("location", "canonical_url", "application_id", "evidence", "description")},
        "skills": F.coalesce(last("skills", F.size("skills") > 0), first("skills")),
        "job_url": first("job_url"),
        "discovered_at": first("discovered_at"),
        "score": F.max("score"),
        "visa": F.coalesce(last("visa", F.col("visa") != UNCLEAR_VISA), first("visa")),
        "source": F.coalesce(last("source", text("description") & (F.col("seq") >= 0)), F.min_by("source", F.when(text("source"), F.col("seq"))), first("source")),
        "settled": last("status", verified),
        "status": last("status", F.lit(True)),
    }
    out = every.groupBy("target", "head").agg(*[c.alias(k) for k, c in agg.items()], F.count_if(F.col("seq") >= 0).alias("n_merged"), F.max(F.col("seq") < 0).alias("had"))
    status = F.when((F.col("status") == TO_VERIFY) & (F.col("settled") == OPEN), F.lit(OPEN)).otherwise(F.col("status"))
    change = F.when(~F.col("had"), "inserted").when(F.col("n_merged") > 0, "updated").otherwise("kept")
    return out.withColumn("status", status).select(F.col("target").alias("id"), "head", *FIELDS, "n_merged", change.alias("change"))
