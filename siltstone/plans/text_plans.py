"""Queries of projections, rules and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import rules as R
from siltstone.functions import text as T
from siltstone.functions import urls as U
from siltstone.operators import dedup
from siltstone.plans.registry import Registry, table

REG = Registry()
_KEYS = lambda keys: ", ".join(f"'{k}'" for k in keys)


def canonical_sql(flavour: U.Flavour, url: str = "url") -> str:
    """The same canonical form in DuckDB SQL."""
    parts = "'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?(#.*)?$'"
    g = lambda n: f"regexp_extract({url}, {parts}, {n})"
    drop = f"AND lower(string_split(x, '=')[1]) NOT IN ({_KEYS(flavour.drop)})" if flavour.drop else ""
    q = f"array_to_string(list_sort(list_filter(string_split(substr({g(4)}, 2), '&'), lambda x: x <> '' {drop})), '&')" if flavour.keep_query else "''"
    frag = f"|| CASE WHEN regexp_matches({g(5)}, '(job|position|posting|opening|vacancy|requisition|req|jid|id)[=/:_-]', 'i') THEN {g(5)} ELSE '' END" if flavour.job_fragment else ""
    return (
        f"lower({g(1)}) || '://' || regexp_replace(lower({g(2)}), '^www\\.', '') || coalesce(nullif(regexp_replace({g(3)}, '/+$', ''), ''), '/')"
        f" || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END {frag}"
    )


HOST_SQL = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"


@REG.add(f"SELECT page_id, {canonical_sql(U.MERGE)} AS merge_url, {canonical_sql(U.AGGREGATOR)} AS aggregator_url, {canonical_sql(U.METRICS)} AS metrics_url, {canonical_sql(U.IDENTITY)} AS identity_url FROM pages")
def url_canonical(spark, d):
    """P2a, P2b, P2e, P2f."""
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id",
        U.canonical_url(u, U.MERGE).alias("merge_url"),
        U.canonical_url(u, U.AGGREGATOR).alias("aggregator_url"),
        U.canonical_url(u, U.METRICS).alias("metrics_url"),
        U.canonical_url(u, U.IDENTITY).alias("identity_url"),
    )


@REG.add(f"""
    WITH p AS (SELECT page_id, {HOST_SQL} AS host, {canonical_sql(U.METRICS)} AS u, length(html) AS n FROM pages),
    b AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY n DESC, page_id) AS r FROM p)
    SELECT host, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS html_chars, min(page_id) AS first_page FROM b WHERE r = 1 GROUP BY host
""")
def url_dedup_best(spark, d):
    """Canonical URLs, the longest page of each, pages per host."""
    u = F.col("url")
    p = table(spark, d, "pages").select("page_id", U.host(u).alias("host"), U.canonical_url(u, U.METRICS).alias("u"), F.length("html").alias("n"))
    best = dedup.keep_best(p, ["u"], "n", "page_id")
    return best.groupBy("host").agg(F.count("*").alias("n_pages"), F.sum("n").cast("bigint").alias("html_chars"), F.min("page_id").alias("first_page"))


_SQUEEZE = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_STRIP = lambda x: _SQUEEZE(
    f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '<script\\b[^>]*>.*?</script>', ' ', 'gis'), '<style\\b[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' ', 'gi'), '&amp;', '&', 'gi')"
)


@REG.add(f"SELECT page_id, sha256({_STRIP('html')}) AS text_sha256, length({_STRIP('html')}) AS n_chars FROM pages")
def html_strip(spark, d):
    """P13."""
    t = table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("t"))
    return t.select("page_id", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), F.length("t").cast("bigint").alias("n_chars"))


@REG.add(f"""
    SELECT page_id, regexp_replace(coalesce(nullif({_STRIP("regexp_extract(html, '<h1\\b[^>]*>(.*?)</h1>', 1, 'is')")}, ''),
           {_STRIP("regexp_extract(html, '<title\\b[^>]*>(.*?)</title>', 1, 'is')")}), '\\s+[|-]\\s+[^|-]+$', '') AS title FROM pages
""")
def html_title(spark, d):
    """P14."""
    return table(spark, d, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@REG.add(r"""
    SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a\b[^>]*?\bhref=["'']([^"''#]+)["'']', 1, 'i')) AS link FROM pages
""")
def html_links(spark, d):
    """P15."""
    return table(spark, d, "pages").select("page_id", F.explode(T.html_links(F.col("html"))).alias("link"))


_IDENT = lambda x: f"regexp_replace(replace(lower(coalesce({x}, '')), '&', 'and'), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')"


@REG.add(f"SELECT page_id, {_IDENT('url')} AS identity, substr(sha256('url:' || {canonical_sql(U.MERGE)}), 1, 24) AS job_key FROM pages")
def identity_key_hash(spark, d):
    """P3, P9, P10."""
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", T.identity_text(u).alias("identity"), T.sha_key(F.concat(F.lit("url:"), U.canonical_url(u, U.MERGE))).alias("job_key"))


@REG.add("""
    SELECT page_id, list_reduce(list_transform(string_split(url, ''), lambda x: CAST(unicode(x) AS BIGINT)),
           lambda h, c: (xor(h, c) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) AS h FROM pages WHERE length(url) > 0
""")
def fnv_hash(spark, d):
    """P11."""
    return table(spark, d, "pages").where("length(url) > 0").select("page_id", T.fnv1a(F.col("url")).alias("h"))


TAGS = [("article", R.word("the", "le", "der", "el")), ("mail", "@"), ("digits", "[0-9]{4}"), ("licence", "license"), ("shout", "[A-Z]{4}"), ("markup", "[*$%&#]{3}"), ("lines", "\n")]
TRACKS = [("noisy", "[*$%&#]{3}"), ("loud", "[A-Z]{6}"), ("licensed", "Released under"), ("contact", "@[a-z0-9]+[.]"), ("plain", "[a-z]")]
_CASE = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TRACKS)
_LIST = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in TAGS)


@REG.add(f"SELECT doc_id, array_to_string(list_filter([{_LIST}], lambda x: x IS NOT NULL)[1:4], '|') AS tags FROM documents")
def rule_tags(spark, d):
    """Ordered labels, at most four."""
    return table(spark, d, "documents").select("doc_id", F.array_join(R.all_matches(F.col("text"), TAGS, 4), "|").alias("tags"))


@REG.add(f"SELECT track, count(*) AS n FROM (SELECT CASE {_CASE} ELSE 'none' END AS track FROM documents) GROUP BY track")
def first_match_track(spark, d):
    """P23, P24."""
    return table(spark, d, "documents").select(R.first_match(F.col("text"), TRACKS, "none").alias("track")).groupBy("track").agg(F.count("*").alias("n"))


@REG.add(r"""
    SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])(no|not|never)([^a-z0-9]|$)') THEN 'blocked'
                        WHEN regexp_matches(lower(text), '(^|[^a-z0-9])(was|was,|license)([^a-z0-9]|$)') THEN 'supported' ELSE 'unknown' END AS visa FROM documents
""")
def blocked_before_supported(spark, d):
    """P25."""
    t = F.lower("text")
    return table(spark, d, "documents").select("doc_id", R.blocked_or_supported(t, R.word("no", "not", "never"), R.word("was", "was,", "license")).alias("visa"))


REJECT_SQL = """
    SELECT reason, count(*) AS n FROM (
        SELECT CASE WHEN coalesce(trim(text), '') = '' THEN 'empty' WHEN length(text) < 200 THEN 'short'
                    WHEN regexp_matches(text, '[*$%&#]{3}') THEN 'noisy' WHEN lang <> 'en' THEN 'language'
                    WHEN regexp_matches(text, 'Released under') THEN 'licence' ELSE 'kept' END AS reason FROM documents) GROUP BY reason
"""


@REG.add(REJECT_SQL)
def reject_ladder(spark, d):
    """Each row has exactly one reason."""
    t = F.col("text")
    reason = R.ladder(
        [
            ("empty", F.coalesce(F.trim(t), F.lit("")) == ""),
            ("short", F.length(t) < 200),
            ("noisy", t.rlike("[*$%&#]{3}")),
            ("language", F.col("lang") != "en"),
            ("licence", t.rlike("Released under")),
        ]
    )
    return table(spark, d, "documents").select(F.coalesce(reason, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@REG.add("SELECT page_id, list_max(list_transform(regexp_extract_all(html, '([0-9]{1,6})[ ]?(px|em|%|;)', 1), lambda x: CAST(x AS INTEGER))) AS largest FROM pages")
def number_extract_max(spark, d):
    """P26."""
    return table(spark, d, "pages").select("page_id", R.largest_number(F.col("html"), "([0-9]{1,6})[ ]?(px|em|%|;)").alias("largest"))


@REG.add("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS due FROM orders
""")
def deadline_extract(spark, d):
    """Texts made from order dates in several forms; an impossible date and a text without signal give null."""
    o, day = table(spark, d, "orders"), F.col("o_orderdate")
    n = F.col("o_orderkey") % 4
    text = (
        F.when(n == 0, F.concat(F.lit("Posted on "), F.date_format(day, "yyyy-MM-dd")))
        .when(n == 1, F.concat(F.lit("About the role. Application deadline: "), F.date_format(day, "yyyy/M/d"), F.lit(".")))
        .when(n == 2, F.concat(F.lit("Apply by "), F.date_format(day, "MMMM d, yyyy"), F.lit(" at noon")))
        .otherwise(F.concat(F.lit("Closing date: "), F.date_format(day, "yyyy"), F.lit("-02-31")))
    )
    return o.select("o_orderkey", R.deadline(text).alias("due"))


RUBRIC = [("(^|[^a-z])the([^a-z]|$)", 10), ("tion", 12), ("ing", 8), ("[0-9]", 5), ("\n", 5)]
_PTS = " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {n} ELSE 0 END" for p, n in RUBRIC)
_SCORE = f"greatest(0, least(100, 40 + least({_PTS}, 30) + least(20, length(text) // 200) - CASE WHEN regexp_matches(text, '[*$%&#]{{3}}') THEN 40 ELSE 0 END))"


def rubric(text):
    """A rubric on documents: base, capped points, capped length bonus, gap penalty, clamp."""
    return R.clamp(40 + R.points(text, RUBRIC, 30) + F.least(F.lit(20), F.floor(F.length(text) / 200)) - F.when(text.rlike("[*$%&#]{3}"), 40).otherwise(0)).cast("bigint")


@REG.add(f"SELECT doc_id, CAST({_SCORE} AS BIGINT) AS score, CASE WHEN {_SCORE} >= 85 THEN 'strong' WHEN {_SCORE} >= 70 THEN 'good' WHEN {_SCORE} >= 50 THEN 'fair' ELSE 'weak' END AS band FROM documents")
def rubric_score(spark, d):
    """Bands of a rubric."""
    s = table(spark, d, "documents").select("doc_id", rubric(F.col("text")).alias("score"))
    return s.withColumn("band", R.band(F.col("score"), [(85, "strong"), (70, "good"), (50, "fair")], "weak"))


@REG.add(f"""
    SELECT count(*) FILTER (s >= 85) AS n_85, count(*) FILTER (s >= 70) AS n_70, count(*) FILTER (s >= 50) AS n_50, count(*) AS n FROM (SELECT {_SCORE} AS s FROM documents)
""")
def score_bands(spark, d):
    """A9."""
    s = table(spark, d, "documents").select(rubric(F.col("text")).alias("s"))
    return s.agg(*[F.count_if(F.col("s") >= k).cast("bigint").alias(f"n_{k}") for k in (85, 70, 50)], F.count("*").alias("n"))


@REG.add(f"""
    SELECT page_id, CASE WHEN {HOST_SQL} LIKE '%.com' THEN 'commercial' WHEN {HOST_SQL} LIKE '%.org' THEN 'open' ELSE 'other' END AS label,
           CASE WHEN NOT ({HOST_SQL} LIKE '%.com' OR {HOST_SQL} LIKE '%.org') THEN 'wrong_host'
                WHEN NOT regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[0-9]') THEN 'wrong_path' END AS reason
    FROM pages
""")
def url_contract(spark, d):
    """P32, F4."""
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", U.suffix_label(u, {"com": "commercial", "org": "open"}).alias("label"), U.url_contract(u, {"com": "[0-9]", "org": "[0-9]"}).alias("reason"))


@REG.add(r"""
    SELECT p_partkey, regexp_replace(lower(p_brand), '[^\p{L}\p{N}]+', '', 'g') AS company_key, upper(substr(p_name, 1, 1)) || '-' || CASE WHEN p_partkey < 100000 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE CAST(p_partkey AS VARCHAR) END AS archive_id FROM part
""")
def archive_ids(spark, d):
    """P8, P35."""
    return table(spark, d, "part").select(
        "p_partkey", T.company_key(F.col("p_brand")).alias("company_key"), F.concat(F.upper(F.substring("p_name", 1, 1)), T.archive_id(F.col("p_partkey"), "-")).alias("archive_id")
    )


QUERIES, ORACLES = REG.queries, REG.oracles
