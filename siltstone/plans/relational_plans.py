"""Queries of joins, deduplication, merges, set operations, windows and reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions import urls as U
from siltstone.operators import dedup, joins, merge, reports
from siltstone.plans.posts import greedy_sql, same_posting_sql, stable_sql
from siltstone.plans.registry import Registry, table
from siltstone.plans.text_plans import canonical_sql

REG = Registry()


def n_rows():
    return F.count("*").alias("n")


@REG.add("""
    SELECT conv_id, turn, role, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1
""")
def dedup_last(spark, d):
    """D1."""
    return dedup.keep_last(table(spark, d, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n_chars"))


@REG.add("""
    SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1
""")
def dedup_best(spark, d):
    """The longest text per source, the earlier of equals."""
    return dedup.keep_best(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], "n_chars", "doc_id")


@REG.add("SELECT sha256(text) AS key, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def dedup_exact(spark, d):
    """D12, D13."""
    t = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    return t.groupBy("key").agg(F.min("doc_id").alias("doc_id"), n_rows())


_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '')"
_TITLE = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*/?([^/?#]*)', 1)"
_PLAIN = lambda x: f"regexp_replace(replace(lower({x}), '&', 'and'), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')"
_PLACEHOLDER = f"(lower(trim({_TITLE})) IN ({', '.join(repr(x) for x in T.PLACEHOLDER_TITLES)}) OR " + " OR ".join(f"regexp_matches(lower(trim({_TITLE})), '{f}')" for f in T._PLACEHOLDER_FORMS) + ")"
_POST = f"""
    SELECT page_id AS id, {_PLAIN(_HOST)} AS co, {_PLAIN(_TITLE)} AS ti, '' AS place, {stable_sql('url')} AS st, {canonical_sql(U.IDENTITY)} AS url, {_PLAIN(_TITLE)} <> '' AND NOT {_PLACEHOLDER} AS named FROM pages
"""


def _postings(spark, d):
    """Pages as postings: host as company, first path part as title, the URL's last part as location."""
    u = F.col("url")
    return table(spark, d, "pages").select(
        F.col("page_id").alias("id"),
        F.regexp_replace(F.lower(F.regexp_extract(u, "^[A-Za-z]+://([^/?#]*)", 1)), r"^www\.", "").alias("company"),
        F.regexp_extract(u, "^[A-Za-z]+://[^/?#]*/?([^/?#]*)", 1).alias("title"),
        F.lit("").alias("location"),
        u.alias("job_url"),
        F.lit("").alias("canonical_url"),
        F.lit("").alias("application_id"),
    )


@REG.add(same_posting_sql(_POST, False))
def resolve_pairs(spark, d):
    """D5 with blocking, on pages."""
    return dedup.same_posting_pairs(_postings(spark, d))


@REG.add("""
    SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN 'closed' ELSE o_orderstatus END AS status FROM orders UNION ALL
    SELECT -o_orderkey, 'first' FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
""")
def status_migration(spark, d):
    """Statuses of a list change, and a first event is inserted where there is none."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus").isin("F", "P"), "closed").otherwise(F.col("o_orderstatus")).alias("status"))
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    more = joins.without_match(o, done, F.col("o_orderkey"), F.col("l_orderkey")).select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("first").alias("status"))
    return o.unionByName(more)


@REG.add("SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AS saved FROM orders")
def saved_flags(spark, d):
    """J1."""
    saved = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return joins.saved_flags(table(spark, d, "orders").select("o_orderkey", "o_custkey"), saved, "o_custkey").select("o_orderkey", "saved")


@REG.add("""
    SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 2 THEN NULL ELSE n_name END AS company FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey
""")
def alias_company(spark, d):
    """A company by any of its pool's keys."""
    n = table(spark, d, "nation")
    pool = n.select("n_nationkey", F.col("n_name").alias("company"), F.array(F.concat(F.lit("a"), "n_nationkey"), F.concat(F.lit("b"), "n_nationkey")).alias("keys"))
    k = F.col("s_nationkey")
    asked = F.when(k % 3 == 0, F.concat(F.lit("a"), k)).when(k % 3 == 1, F.concat(F.lit("b"), k)).otherwise("c")
    return joins.alias_lookup(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), asked, pool, "company", F.col("keys"), "n_nationkey").select("s_suppkey", "company")


@REG.add("""
    SELECT c_custkey, 'unapplied' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL
    SELECT s_suppkey, 'unrequested' FROM supplier WHERE lower(s_name) || '::' || s_nationkey NOT IN (SELECT lower(s_name) || '::' || s_nationkey FROM supplier WHERE s_acctbal < 0)
""")
def unmatched_rows(spark, d):
    """Rows without a partner by id, and by a lower-case pair."""
    c, o, s = (table(spark, d, t) for t in ("customer", "orders", "supplier"))
    a = joins.without_match(c, o.where("o_orderstatus = 'P'"), F.col("c_custkey"), F.col("o_custkey")).select("c_custkey", F.lit("unapplied").alias("kind"))
    pair = F.concat_ws("::", F.lower("s_name"), F.col("s_nationkey"))
    b = joins.without_match(s, s.where("s_acctbal < 0").withColumn("s_name", F.upper("s_name")), pair, pair)
    return a.unionByName(b.select(F.col("s_suppkey").alias("c_custkey"), F.lit("unrequested").alias("kind")))


@REG.add("SELECT event_id, n_name FROM events LEFT JOIN nation ON n_nationkey = user_id")
def tasks_with_names(spark, d):
    """Tasks with their application's name by id; unknown ids stay."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("user_id"), "n_name")
    return table(spark, d, "events").select("event_id", "user_id").join(joins.small(n), "user_id", "left").select("event_id", "n_name")


@REG.add("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_custkey, o_orderkey) AS place FROM orders ORDER BY place LIMIT 250")
def sorted_jobs(spark, d):
    """Several keys, the first 250; the places are numbered after the limit."""
    top = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_custkey", "o_orderkey").limit(250).select("o_orderkey", "o_totalprice", "o_custkey")
    place = F.row_number().over(W.orderBy(F.desc("o_totalprice"), "o_custkey", "o_orderkey"))  # 250 rows
    return top.select("o_orderkey", "o_totalprice", place.cast("bigint").alias("place"))


@REG.add("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 7")
def point_lookup(spark, d):
    """A table scan by schema, and one row by its key, which reaches the scan as a filter."""
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").where("c_custkey = 7").limit(1)


@REG.add(f"""
    SELECT page_id AS id, {_HOST} AS company, {_TITLE} AS title, length(url) AS rank FROM pages WHERE page_id IN (
        {greedy_sql(same_posting_sql(_POST, True), "SELECT page_id AS id, page_id * 7919 % 1009 AS seen, length(url) AS rank FROM pages")})
""")
def display_dedup(spark, d):
    """D7 on pages."""
    p = _postings(spark, d).withColumns({"seen": F.col("id") * 7919 % 1009, "rank": F.length("job_url")})
    return dedup.greedy_display(p, "seen", "rank").select("id", "company", "title", "rank")


@REG.add("""
    WITH r AS (SELECT source, lang, doc_id, (doc_id % 9 = 0)::INT AS v, CASE WHEN doc_id % 4 = 1 THEN 0 ELSE least(n_chars, 100000) END AS n, CASE WHEN doc_id % 5 < 2 THEN CASE WHEN text <> '' THEN sha256(text) ELSE text END ELSE '' END AS e, ['s' || (doc_id % 7)] AS k, doc_id * 31 % 100 AS m FROM documents),
    g AS (SELECT source, lang, list({'v': v, 'n': coalesce(n, 0), 'x': doc_id * 7 % 13 * (coalesce(e, '') <> '')::INT, 'e': e, 'k': k, 'm': m, 'c': 1} ORDER BY doc_id) AS l FROM r GROUP BY 1, 2),
    f AS (SELECT source, lang, list_reduce(list_transform(l, lambda z: {'q': {'v': z.v, 'n': z.n, 'x': z.x, 'm': z.m}, 'e': z.e, 'k': z.k, 'c': z.c}), lambda a, b: {
        'q': {'v': CASE WHEN b.q > a.q THEN CASE WHEN b.q.v <> 0 THEN b.q.v ELSE a.q.v END ELSE CASE WHEN a.q.v <> 0 THEN a.q.v ELSE b.q.v END END,
              'n': CASE WHEN b.q > a.q THEN CASE WHEN b.q.n <> 0 THEN b.q.n ELSE a.q.n END ELSE CASE WHEN a.q.n <> 0 THEN a.q.n ELSE b.q.n END END,
              'x': CASE WHEN b.q > a.q THEN CASE WHEN b.q.x <> 0 THEN b.q.x ELSE a.q.x END ELSE CASE WHEN a.q.x <> 0 THEN a.q.x ELSE b.q.x END END, 'm': greatest(a.q.m, b.q.m)},
        'e': CASE WHEN b.q > a.q THEN CASE WHEN coalesce(b.e, '') = '' THEN a.e ELSE b.e END ELSE CASE WHEN coalesce(a.e, '') = '' THEN b.e ELSE a.e END END,
        'k': CASE WHEN list_contains(a.k, b.k[1]) THEN a.k ELSE list_concat(a.k, b.k) END, 'c': a.c + b.c}) AS x FROM g)
    SELECT source, lang, x.q.v AS verified, x.q.n AS description, x.q.x AS noted, coalesce(x.e, '') AS evidence, array_to_string(x.k, '|') AS skills, x.q.m AS score, CAST(x.c AS INT) AS n_merged FROM f
""")
def fold_merge(spark, d):
    """D3 on documents keyed by source and language: quality is verified, description, evidence and score; the digest of a whole text is the evidence."""
    evidence = F.when(F.col("doc_id") % 5 < 2, F.when(F.col("text") != "", F.sha2("text", 256)).otherwise(F.col("text"))).otherwise("")
    t = table(spark, d, "documents").select(
        "source", "lang", "doc_id",
        (F.col("doc_id") % 9 == 0).cast("int").alias("verified"),
        F.when(F.col("doc_id") % 4 == 1, 0).otherwise(F.least(F.col("n_chars"), F.lit(100_000))).alias("description"),
        (F.col("doc_id") * 7 % 13 * (F.coalesce(evidence, F.lit("")) != "").cast("int")).alias("noted"), evidence.alias("evidence"),
        F.array(F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string"))).alias("skills"),
        (F.col("doc_id") * 31 % 100).alias("score"),
    )
    out = merge.fold_merge(t, ["source", "lang"], "doc_id", ["verified", "description", "noted", "score"], ["evidence"], ["skills"], ["score"])
    return out.withColumns({"skills": F.array_join("skills", "|"), "evidence": F.coalesce("evidence", F.lit(""))})


@REG.add("""
    SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey OR (o_orderkey % 1500 = c_custkey AND o_orderstatus = 'F') GROUP BY c_custkey
""")
def or_join_fanout(spark, d):
    """A disjunctive join as a union of equi-joins; the fan-out stays."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    text = lambda x: x.cast("string")
    keys = [(text(F.col("c_custkey")), text(F.col("o_custkey"))), (text(F.col("c_custkey")), F.when(F.col("o_orderstatus") == "F", text(F.col("o_orderkey") % 1500)))]
    return joins.or_equi_join(c.select("c_custkey"), o, "c_custkey", "o_orderkey", keys).groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@REG.add("""
    SELECT o_orderkey, o_orderpriority, o_custkey % 2 = 0 AS saved FROM orders
    WHERE o_orderstatus <> 'P' AND o_totalprice > 1000
      AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
      AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)
""")
def semi_anti_visibility(spark, d):
    """J3-J5, F11."""
    o, line, c = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "customer")
    seen = o.where("o_orderstatus <> 'P' and o_totalprice > 1000")
    seen = seen.join(c.where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    seen = seen.join(line.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return seen.select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 2 == 0).alias("saved"))


@REG.add("""
    SELECT o_orderkey, l_linenumber, l_returnflag FROM orders LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS r FROM lineitem) x ON l_orderkey = o_orderkey AND r = 1
""")
def hash_left_last(spark, d):
    """Listing rows with their last detail row."""
    line = table(spark, d, "lineitem")
    last = line.groupBy("l_orderkey").agg(F.max_by(F.struct("l_linenumber", "l_returnflag"), F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")).alias("x"))
    o = table(spark, d, "orders").select("o_orderkey")
    return o.join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "x.l_linenumber", "x.l_returnflag")


@REG.add("""
    SELECT s_suppkey, coalesce(a.n_name, b.n_name) AS n_name, CASE WHEN a.n_nationkey IS NOT NULL THEN 1 WHEN b.n_nationkey IS NOT NULL THEN 2 ELSE 0 END AS matched_rule
    FROM supplier LEFT JOIN nation a ON a.n_nationkey = s_suppkey LEFT JOIN nation b ON b.n_nationkey = s_nationkey
""")
def prioritized_lookup(spark, d):
    """The first key that finds a row decides."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    keys = [(F.col("s_suppkey").cast("int"), F.col("n_nationkey")), (F.col("s_nationkey"), F.col("n_nationkey"))]
    return joins.prioritized_lookup(s.select("s_suppkey", "s_nationkey"), n, "s_suppkey", keys, "n_name", "n_nationkey").drop("s_nationkey")


@REG.add("""
    SELECT s_suppkey, coalesce(a.n_nationkey, b.n_nationkey) AS matched_key, coalesce(a.n_name, b.n_name) AS n_name
    FROM supplier LEFT JOIN nation a ON a.n_nationkey = s_suppkey LEFT JOIN nation b ON b.n_nationkey = s_nationkey
""")
def multi_key_lookup(spark, d):
    """An array of keys, the first known one wins."""
    s, n = table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_name")
    return joins.multi_key_lookup(s, F.array(F.col("s_suppkey").cast("int"), "s_nationkey"), n, "n_nationkey", "s_suppkey").drop("s_nationkey")


@REG.add("""
    WITH s AS (SELECT p.p_partkey AS part, l_suppkey AS supp, count(*) * 10 AS score FROM lineitem JOIN part p ON l_partkey = p_partkey GROUP BY 1, 2),
    r AS (SELECT *, rank() OVER (PARTITION BY part ORDER BY score DESC) AS r FROM s), t AS (SELECT *, count(*) OVER (PARTITION BY part) AS n FROM r WHERE r = 1)
    SELECT part, supp, score FROM t WHERE n = 1 AND score >= 20
""")
def ranked_match_unique(spark, d):
    """A unique top match above a threshold."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")).agg((F.count("*") * 10).alias("score"))
    known = table(spark, d, "part").select(F.col("p_partkey").alias("part"))
    return joins.unique_best(s.join(known, "part", "left_semi"), "part", "score", 20)


@REG.add("""
    SELECT p_partkey, word FROM part, (SELECT DISTINCT split_part(p_name, ' ', 2) AS word FROM part UNION SELECT DISTINCT upper(p_name) || ' set' FROM part) WHERE contains(lower(p_name), lower(word)) OR contains(lower(word), lower(p_name))
""")
def fuzzy_contains_join(spark, d):
    """Part names and the words and sets named after them, whichever holds the other."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    words = p.select(F.explode(F.array(F.split_part("p_name", F.lit(" "), F.lit(2)), F.concat(F.upper("p_name"), F.lit(" set")))).alias("word")).distinct()
    return joins.contains_join(p, words, "p_name", "word").select("p_partkey", "word")


@REG.add("""
    WITH p AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 3 <> 0), c AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 3 <> 1)
    SELECT coalesce(c.o_custkey, p.o_custkey) AS o_custkey, CASE WHEN p.o_custkey IS NULL THEN 'new' WHEN c.o_custkey IS NULL THEN 'missing' ELSE 'kept' END AS state
    FROM p FULL JOIN c ON p.o_custkey = c.o_custkey
""")
def snapshot_diff(spark, d):
    """J18, X2."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return merge.snapshot_diff(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 <> 1"), "o_custkey")


@REG.add("""
    WITH m AS (SELECT max(o_orderdate) AS now FROM orders)
    SELECT o_orderkey, o_orderdate + INTERVAL 14 DAY AS retained_until FROM orders, m WHERE o_orderkey % 2 = 0 AND o_orderdate >= now - INTERVAL 14 DAY
""")
def retention(spark, d):
    """Rows missing from the current snapshot stay for 14 days after they were seen."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    dated = o.crossJoin(F.broadcast(o.agg(F.max("o_orderdate").alias("now"))))  # a single row
    return merge.retain_missing(dated, o.where("o_orderkey % 2 = 1"), "o_orderkey", "o_orderdate", F.col("now"), 14).select("o_orderkey", "retained_until")


@REG.add("""
    SELECT count(*) AS fetched, count(*) FILTER (WHERE o_orderstatus = 'P') AS rejected, count(*) FILTER (WHERE o_orderstatus <> 'P') - count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus <> 'P') AS deduplicated,
           count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus <> 'P') AS imported, count(*) FILTER (WHERE o_orderstatus = 'O') AS open FROM orders
""")
def receipt(spark, d):
    """A1: all counters of a run in one pass."""
    kept = F.col("o_orderstatus") != "P"
    ids = F.count_distinct(F.when(kept, F.col("o_custkey")))
    return table(spark, d, "orders").agg(
        F.count("*").alias("fetched"),
        reports.count_if(~kept).alias("rejected"),
        (reports.count_if(kept) - ids).alias("deduplicated"),
        ids.alias("imported"),
        reports.count_if(F.col("o_orderstatus") == "O").alias("open"),
    )


@REG.add("""
    SELECT r_name AS region, n_name AS nation, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS failed
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name, n_name), (r_name), ())
""")
def region_state_counts(spark, d):
    """A3: both levels and the total at once."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    g = j.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), "c_acctbal").rollup("region", "nation")
    return g.agg(n_rows(), reports.count_if(F.col("c_acctbal") < 0).alias("failed"))


@REG.add("SELECT s.source, count(doc_id) AS n FROM (SELECT DISTINCT source FROM documents UNION SELECT 'manual') s LEFT JOIN documents d ON d.source = s.source GROUP BY 1")
def source_counts(spark, d):
    """A2, A5: rows per source, with zero for a known source without rows."""
    t = table(spark, d, "documents").select("source")
    known = t.distinct().unionByName(spark.createDataFrame([("manual",)], "source string"))
    return reports.counts_with_zero(t, "source", known)


@REG.add("""
    SELECT event_type, 'k' AS counter, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY event_type
""")
def counter_map_sum(spark, d):
    """Counter maps in JSON, added key by key."""
    e = table(spark, d, "events").select("event_type", F.from_json("props", "map<string,bigint>").alias("m"))
    return e.select("event_type", F.explode("m").alias("counter", "v")).groupBy("event_type", "counter").agg(F.sum("v").alias("total"), n_rows())


@REG.add("""
    WITH h AS (SELECT CAST(ts AS DATE) AS day, count(*) AS attempted, count(*) FILTER (WHERE event_type <> 'error') AS succeeded FROM events GROUP BY 1),
    l AS (SELECT *, round(succeeded / attempted, 4) AS rate, lag(round(succeeded / attempted, 4)) OVER (ORDER BY day) AS previous FROM h)
    SELECT day, attempted, succeeded, rate, previous, concat_ws('|', CASE WHEN rate < 0.79 THEN 'low_rate' END, CASE WHEN rate < previous * 0.98 THEN 'rate_drop' END) AS anomalies FROM l
""")
def health_anomalies(spark, d):
    """Daily success rates against the day before."""
    h = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("attempted"), reports.count_if(F.col("event_type") != "error").alias("succeeded"))
    h = h.withColumn("rate", F.round(F.col("succeeded") / F.col("attempted"), 4))
    h = h.withColumn("previous", F.lag("rate").over(W.orderBy("day")))  # one row per day
    flags = F.array(F.when(F.col("rate") < 0.79, F.lit("low_rate")), F.when(F.col("rate") < F.col("previous") * 0.98, F.lit("rate_drop")))
    return h.withColumn("anomalies", F.array_join(flags, "|"))


@REG.add("SELECT day, n FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) ORDER BY day DESC LIMIT 7")
def keep_last_n(spark, d):
    """W7."""
    return reports.keep_last_n(table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(n_rows()), "day", 7)


STAGES = ["view", "click", "signup", "purchase"]


@REG.add("""
    WITH b AS (SELECT user_id, max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END) AS best FROM events WHERE event_id % 17 = 3 GROUP BY 1),
    c AS (SELECT s.step, s.stage, count(*) FILTER (best >= s.step) AS n FROM b, (VALUES (1, 'view'), (2, 'click'), (3, 'signup'), (4, 'purchase')) AS s(step, stage) GROUP BY 1, 2)
    SELECT step, stage, n, CASE WHEN lag(n) OVER (ORDER BY step) > 0 THEN floor(n * 1000 / lag(n) OVER (ORDER BY step) + 0.5) / 10 END AS conversion FROM c
""".replace(" WHERE event_id % 17 = 3", ""))
def funnel(spark, d):
    """A19, W9."""
    return reports.funnel(table(spark, d, "events"), "user_id", "event_type", STAGES)


@REG.add("""
    SELECT source, count(*) AS n, count(l.doc_id) AS labelled, round(avg(quality), 6) AS good_rate, round(avg(toxic), 6) AS toxic_rate FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source
""")
def source_rates(spark, d):
    """A20."""
    t, lab = table(spark, d, "documents"), table(spark, d, "labels").withColumnRenamed("doc_id", "l")
    j = t.join(lab, F.col("doc_id") == F.col("l"), "left")
    return j.groupBy("source").agg(n_rows(), F.count("l").alias("labelled"), F.round(F.avg("quality"), 6).alias("good_rate"), F.round(F.avg("toxic"), 6).alias("toxic_rate"))


RULES = ["[0-9]{3}", "[*$%&#]{3}", "@", "loser", "Released under", "é", "zzzz"]


@REG.add(f"""
    SELECT pattern, count(doc_id) FILTER (quality = 1) AS positives, count(doc_id) FILTER (quality = 0) AS negatives
    FROM (SELECT unnest({RULES!r}) AS pattern) LEFT JOIN (SELECT d.doc_id, d.text, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id) ON regexp_matches(text, pattern) GROUP BY pattern
""")
def rule_support(spark, d):
    """How many good and bad rows each candidate rule finds."""
    rules = spark.createDataFrame([(r,) for r in RULES], "pattern string")
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("text", (F.col("quality") == 1).alias("good"))
    return reports.rule_support(rules, rows, "text", "good")


_CLASSES = ["Direct", "Strong Transferable", "Coursework Match", "Adjacent", "Credential Status Gap", "No Evidence"]


@REG.add("""
    WITH m AS (
        SELECT l_orderkey, [ 'Direct', 'Strong Transferable', 'Coursework Match', 'Adjacent', 'Credential Status Gap', 'No Evidence' ][CAST(l_partkey % 6 AS INT) + 1] AS c,
               CASE WHEN l_returnflag = 'N' THEN 'covered' ELSE 'unsupported_gap' END AS s, least(100, greatest(0, l_quantity * 2)) AS conf FROM lineitem),
    a AS (SELECT l_orderkey, count(*) AS total, sum(CASE c WHEN 'Direct' THEN 1.0::DOUBLE WHEN 'Strong Transferable' THEN 0.76::DOUBLE WHEN 'Coursework Match' THEN 0.58::DOUBLE WHEN 'Adjacent' THEN 0.28::DOUBLE WHEN 'Credential Status Gap' THEN 0.16::DOUBLE ELSE 0.0::DOUBLE END) AS pts,
                 sum(conf) AS sure, count(*) FILTER (s = 'covered') AS covered, count(*) FILTER (c = 'Direct') AS direct, count(*) FILTER (c = 'Strong Transferable') AS transferable,
                 count(*) FILTER (c = 'Coursework Match') AS coursework, count(*) FILTER (c IN ('Adjacent', 'Credential Status Gap')) AS adjacent, count(*) FILTER (c = 'No Evidence') AS unsupported FROM m GROUP BY 1),
    p AS (SELECT l_orderkey, total, direct, unsupported, floor(pts / total * 100 + 0.5) AS ev, floor(direct / total * 100 + 0.5) AS dc, floor(covered / total * 100 + 0.5) AS cc,
                 floor(sure / total + 0.5) AS cf, floor((unsupported + adjacent * 0.45::DOUBLE) / total * 100 + 0.5) AS gr FROM a)
    SELECT l_orderkey, total, direct, CAST(ev AS BIGINT) AS evidence_coverage, CAST(gr AS BIGINT) AS gap_risk,
           CAST(least(floor(ev * 0.55::DOUBLE + dc * 0.15::DOUBLE + cc * 0.10::DOUBLE + cf * 0.10::DOUBLE + (100 - gr) * 0.10::DOUBLE + 0.5), CASE WHEN unsupported / total >= 0.6 THEN 49 WHEN unsupported / total >= 0.4 THEN 64 ELSE 100 END) AS BIGINT) AS score FROM p
""")
def fit_score(spark, d):
    """A15."""
    label = F.element_at(F.array(*[F.lit(c) for c in _CLASSES]), (F.col("l_partkey") % 6 + 1).cast("int"))
    m = table(spark, d, "lineitem").select(
        "l_orderkey", F.lit("k").alias("keyword"), F.when(F.col("l_returnflag") == "N", "covered").otherwise("unsupported_gap").alias("status"),
        label.alias("classification"), (F.col("l_quantity") * 2).alias("confidence"),
    )
    s = reports.fit_score(m, "l_orderkey")
    return s.select("l_orderkey", "total", "direct", *[F.col(c).cast("bigint").alias(c) for c in ("evidence_coverage", "gap_risk", "score")])


@REG.add("""
    WITH b AS (SELECT p_brand AS project, l_suppkey AS requirement, max(l_discount) AS best FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
    SELECT project, count(*) AS n_requirements, round(sum(best), 6) AS weight FROM b GROUP BY 1 ORDER BY weight DESC, project LIMIT 8
""")
def project_rollup(spark, d):
    """Best evidence per project and requirement, then the eight strongest projects."""
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    best = j.groupBy(F.col("p_brand").alias("project"), "l_suppkey").agg(F.max("l_discount").alias("best"))
    return best.groupBy("project").agg(F.count("*").alias("n_requirements"), F.round(F.sum("best"), 6).alias("weight")).orderBy(F.desc("weight"), "project").limit(8)


@REG.add("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def status_pivot(spark, d):
    """A3, A17."""
    p = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return p.select("o_orderpriority", *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s.lower()) for s in "FOP"])


@REG.add("""
    SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND contains(lower(text), 'tion') ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20
""")
def facet_search_page(spark, d):
    """Facet and text filter, order, second page of twenty."""
    t = table(spark, d, "documents").where((F.col("lang") == "en") & F.lower("text").contains("tion")).select("doc_id", "source", "n_chars")
    return reports.page(t, [F.desc("n_chars"), F.col("doc_id")], 2, 20)


@REG.add("""
    SELECT kind, day, count(*) AS n FROM (
        SELECT 'order' AS kind, CAST(o_orderdate AS DATE) AS day FROM orders UNION ALL SELECT 'ship', CAST(l_shipdate AS DATE) FROM lineitem UNION ALL SELECT event_type, CAST(ts AS DATE) FROM events)
    WHERE month(day) = 1 GROUP BY 1, 2
""")
def calendar_union(spark, d):
    """Several kinds of dates as one tagged list."""
    one = lambda t, kind, day: table(spark, d, t).select(kind.alias("kind"), F.to_date(day).alias("day"))
    u = one("orders", F.lit("order"), "o_orderdate").unionByName(one("lineitem", F.lit("ship"), "l_shipdate")).unionByName(one("events", F.col("event_type"), "ts"))
    return u.where(F.month("day") == 1).groupBy("kind", "day").agg(n_rows())


@REG.add("""
    WITH t AS (SELECT CAST(max(o_orderdate) AS DATE) - 14 AS today FROM orders)
    SELECT o_orderkey, CAST(o_orderdate AS DATE) - today AS days_left FROM orders, t WHERE CAST(o_orderdate AS DATE) - today IN (14, 7, 3, 1, 0)
""")
def reminders(spark, d):
    """X6."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    dated = o.crossJoin(F.broadcast(o.agg(F.date_sub(F.max("o_orderdate").cast("date"), 14).alias("today"))))  # a single row
    return reports.reminders(dated, "o_orderkey", "o_orderdate", F.col("today")).select("o_orderkey", F.col("days_left").cast("bigint").alias("days_left"))


@REG.add("""
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN b.p WHEN b.o_orderkey IS NULL THEN a.p ELSE greatest(a.p, b.p) END AS price,
           CASE WHEN a.o_orderkey IS NULL THEN b.s WHEN b.o_orderkey IS NULL THEN a.s WHEN length(b.s) > length(a.s) THEN b.s ELSE a.s END AS note,
           CASE WHEN a.o_orderkey IS NULL THEN 'inserted' WHEN b.o_orderkey IS NULL THEN 'kept' ELSE 'updated' END AS change
    FROM (SELECT o_orderkey, o_totalprice AS p, o_orderpriority AS s FROM orders WHERE o_orderkey % 3 <> 0) a
    FULL JOIN (SELECT o_orderkey, 2000.0::DOUBLE AS p, 'a longer note than before' AS s FROM orders WHERE o_orderkey % 3 <> 1) b ON a.o_orderkey = b.o_orderkey
""")
def upsert_merge(spark, d):
    """K5, K6: field by field, larger price, longer note."""
    o = table(spark, d, "orders")
    old = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("note"))
    new = o.where("o_orderkey % 3 <> 1").select("o_orderkey", F.lit(2000.0).alias("price"), F.lit("a longer note than before").alias("note"))
    return merge.upsert_fields(old, new, "o_orderkey", {"price": "max", "note": "longest"})


@REG.add("""
    WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, coalesce(octet_length(encode(text)), 0) AS n FROM documents),
    s AS (SELECT i, doc_id, n, 0::BIGINT AS batch, 1 AS many, 2 + n AS size FROM r WHERE i = 1 UNION ALL
          SELECT r.i, r.doc_id, r.n, CASE WHEN many >= 40 OR size + 1 + r.n > 1000000 THEN batch + 1 ELSE batch END, CASE WHEN many >= 40 OR size + 1 + r.n > 1000000 THEN 1 ELSE many + 1 END,
                 CASE WHEN many >= 40 OR size + 1 + r.n > 1000000 THEN 2 + r.n ELSE size + 1 + r.n END FROM s JOIN r ON r.i = s.i + 1)
    SELECT batch, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last, CAST(sum(n) AS BIGINT) AS bytes FROM s GROUP BY batch
""")
def batch_split(spark, d):
    """K4: greedy batches of at most 40 rows and a megabyte; a null text has no bytes."""
    t = table(spark, d, "documents").select("doc_id", "text")
    b = merge.split_batches(t, "doc_id", "text", 40, 1_000_000)
    return b.groupBy("batch").agg(n_rows(), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("bigint").alias("bytes"))


@REG.add("""
    SELECT event_type, user_id, max(ts) AS last_seen, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 95) GROUP BY 1, 2
""")
def incremental_skip(spark, d):
    """Rows whose key is not yet in the state."""
    e = table(spark, d, "events")
    done = e.where("event_type = 'purchase' and value > 95").select("user_id").distinct()
    return e.join(done, "user_id", "left_anti").groupBy("event_type", "user_id").agg(F.max("ts").alias("last_seen"), n_rows())


@REG.add("""
    SELECT source, array_to_string(list_sort(list_distinct(list(lang))), '|') AS langs, count(*) AS n FROM documents GROUP BY source
""")
def union_sorted(spark, d):
    """A22, A24."""
    return table(spark, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), "|").alias("langs"), n_rows())


@REG.add("""
    WITH days AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error') * 4 < count(*) AS complete, row_number() OVER (ORDER BY CAST(ts AS DATE)) AS i FROM events GROUP BY 1),
    l AS (SELECT user_id, max(i) AS last_scan FROM (SELECT user_id, CAST(ts AS DATE) AS day FROM events) JOIN days USING (day) GROUP BY 1)
    SELECT user_id, last_scan, (SELECT count(*) FROM days WHERE complete AND i > last_scan) AS misses, (SELECT count(*) FROM days WHERE complete AND i > last_scan) >= 2 AS expired FROM l
""")
def expiry_misses(spark, d):
    """T1, T2 in batch form: complete scans (less than a fourth of errors) since an entity was last seen; two misses expire it."""
    from siltstone.streaming.expiry import batch_misses

    e = table(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    days = e.groupBy("day").agg((F.count_if(F.col("event_type") == "error") * 4 < F.count("*")).alias("complete"))
    days = days.withColumn("i", F.row_number().over(W.orderBy("day")).cast("bigint"))  # one row per scan
    return batch_misses(e.join(days, "day").select("user_id", "i"), "user_id", "i", days.where("complete").select("i"))


@REG.add("""
    WITH f AS (SELECT source, lang, min(doc_id) AS o FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) SELECT source, list(lang ORDER BY o, lang) AS langs FROM f GROUP BY 1
""")
def union_first_seen(spark, d):
    """Distinct values in order of first appearance."""
    return reports.ordered_distinct(table(spark, d, "documents").select("source", "lang", "doc_id"), "source", "lang", "doc_id", "langs")


QUERIES, ORACLES = REG.queries, REG.oracles
