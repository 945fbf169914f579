"""Queries of the screening of postings: filters, rubrics, ids, labels and URL flavours."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import rules as R
from siltstone.functions import screening as S
from siltstone.functions import text as T
from siltstone.functions import urls as U
from siltstone.operators import dedup, joins, postings
from siltstone.plans import literals as L
from siltstone.plans.posts import POSTS_SQL, posts, stable_sql
from siltstone.plans.registry import Registry, table
from siltstone.plans.text_plans import HOST_SQL, canonical_sql

REG = Registry()
_q = lambda s: "'" + s.replace("'", "''") + "'"
_hit = lambda text, p: f"regexp_matches({text}, {_q(p)})"
_any = lambda text, terms: " OR ".join(f"contains({text}, {_q(t)})" for t in terms)
_points = lambda text, rules: " + ".join(f"CASE WHEN {_hit(text, p)} THEN {n} ELSE 0 END" for p, n in rules)


@REG.add(f"SELECT id, {L.wanted_sql('scan')} AS wanted, {L.wanted_sql('server')} AS wanted_server, {L.wanted_sql('china')} AS wanted_china, {L.excluded_sql()} AS excluded FROM ({POSTS_SQL})")
def title_filters(spark, d):
    """F1 by the scan's, the server's and the Chinese scan's terms; F2."""
    t = F.col("title")
    return posts(spark, d).select("id", S.wanted_title(t, "scan").alias("wanted"), S.wanted_title(t, "server").alias("wanted_server"), S.wanted_title(t, "china").alias("wanted_china"), S.excluded_title(t).alias("excluded"))


_PLACES = ("scan", "server", "portal", "china", "collector")


@REG.add(
    f"SELECT id, {', '.join(f'{L.years_sql(p, chr(99))} AS years_{p}' for p in _PLACES)}, {L.visa_sql('scan', 'c')} AS visa, {L.visa_sql('server', 'c')} AS visa_server FROM (SELECT id, lower(content) AS c FROM ({POSTS_SQL}))"
)
def years_and_visa(spark, d):
    """The forms of each place that reads them."""
    c = F.col("content")
    return posts(spark, d).select("id", *[S.required_years(c, p).alias(f"years_{p}") for p in _PLACES], S.sponsorship(c, "scan").alias("visa"), S.sponsorship(c, "server").alias("visa_server"))


@REG.add(f"""
    SELECT id, {L.score_sql('server', 'visa_server').replace('years', 'years_server')} AS score_us, {L.score_sql('scan', 'visa').replace('years', 'years_scan')} AS score_scan, {L.score_sql('china').replace('years', 'years_china')} AS score_china,
           {L.eligible_sql('server', 'visa_server').replace('years', 'years_server')} AS eligible_us, {L.eligible_sql('scan', 'visa').replace('years', 'years_scan')} AS eligible_scan
    FROM (SELECT *, {', '.join(f'{L.years_sql(p, "lower(content)")} AS years_{p}' for p in ('server', 'scan', 'china'))}, {L.visa_sql('server', 'lower(content)')} AS visa_server, {L.visa_sql('scan', 'lower(content)')} AS visa, lower(title || ' ' || content) AS t FROM ({POSTS_SQL}))
""")
def rubric_flavours(spark, d):
    """The three full rubrics, and the eligibility of the first two, each with its own years and sponsorship."""
    t, c = F.col("title"), F.col("content")
    years = lambda p: F.col(f"years_{p}")
    server, scan = F.col("visa_server"), F.col("visa_scan")
    read = {f"years_{p}": S.required_years(c, p) for p in ("server", "scan", "china")} | {f"visa_{p}": S.sponsorship(c, p) for p in ("server", "scan")}
    results = {
        "score_us": S.score(t, c, years("server"), server, S.RUBRIC_US), "score_scan": S.score(t, c, years("scan"), scan, S.RUBRIC_SCAN), "score_china": S.score(t, c, years("china"), None, S.RUBRIC_CHINA),
        "eligible_us": S.eligible(t, c, years("server"), server, S.RUBRIC_US), "eligible_scan": S.eligible(t, c, years("scan"), scan, S.RUBRIC_SCAN),
    }
    p = posts(spark, d).select("id", "title", "content")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # stated: few texts are much work
    texts = p.select("title", "content").distinct().repartition(tasks, "title", "content").withColumns(read)
    return p.join(texts.select("title", "content", *[x.alias(n) for n, x in results.items()]), ["title", "content"]).drop("title", "content")


_short = lambda name, text: f"least({S.SHORT_RUBRICS[name][1]}, {S.SHORT_RUBRICS[name][0]} + {_points(text, S.SHORT_RUBRICS[name][2])})"


@REG.add(f"SELECT id, {_short('portal', 'b')} AS portal, {_short('cloud', 'b')} AS cloud, {_short('aggregator', 'title')} AS aggregator FROM (SELECT *, title || ' ' || content AS b FROM ({POSTS_SQL}))")
def rubric_short(spark, d):
    """C4."""
    both = F.concat_ws(" ", "title", "content")
    return posts(spark, d).select("id", S.short_score(both, "portal").alias("portal"), S.short_score(both, "cloud").alias("cloud"), S.short_score(F.col("title"), "aggregator").alias("aggregator"))


@REG.add(f"""
    SELECT id, {_hit('c', S.CHINA_RELEVANT)} AND NOT {_hit('lower(title)', S.CHINA_EXCLUDED_TITLE)} AND NOT {_hit('lower(title)', S.CHINA_IRRELEVANT)} AND NOT {_hit('c', S.CHINA_EXCLUDED_CORE)} AND coalesce({L.years_sql('portal', 'c')} <= 3, true) AS eligible
    FROM (SELECT *, lower(title || ' ' || content) AS c FROM ({POSTS_SQL}))
""")
def china_eligibility(spark, d):
    """F5, F6."""
    return posts(spark, d).select("id", S.china_eligible(F.col("title"), F.concat_ws(" ", "title", "content")).alias("eligible"))


_GIVEN = "CASE WHEN id % 3 = 0 THEN ' Req ' || id ELSE 'apply' END"
_FRAGMENT = "('https://a.io/list' || CASE WHEN id % 4 = 0 THEN '#job=' || id WHEN id % 4 = 1 THEN '#top' || id ELSE '' END)"
_ids = lambda name: "coalesce(" + ", ".join(f"nullif(regexp_extract(url, {_q(f)}, 1), '')" for f in S.APPLICATION_IDS[name]) + ", '')"


@REG.add(f"""
    SELECT id, {_ids('server')} AS server, {_ids('scan')} AS scan, CASE WHEN {_hit(_ids('verify'), S.APPLICATION_ID)} THEN {_ids('verify')} ELSE '' END AS verify,
           CASE WHEN id % 3 = 0 THEN 'R-' || id ELSE {_ids('server')} END AS supplied FROM ({POSTS_SQL})
""")
def application_ids(spark, d):
    """Four ways to read an application id."""
    u, given = F.col("url"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("R-"), "id"))
    return posts(spark, d).select(
        "id", S.application_id(u, "server").alias("server"), S.application_id(u, "scan").alias("scan"), S.clean_application_id(S.application_id(u, "verify")).alias("verify"),
        S.application_id(u, "server", given).alias("supplied"),
    )


@REG.add(f"SELECT id, {stable_sql('url')} AS stable, {stable_sql('url', _GIVEN)} AS supplied, {stable_sql(_FRAGMENT)} AS fragment FROM ({POSTS_SQL})")
def posting_ids(spark, d):
    """From a supplied id, a query key, the path or the fragment."""
    u, k = F.col("url"), F.col("id")
    p = posts(spark, d)
    mark = F.when(k % 4 == 0, F.concat(F.lit("#job="), k)).when(k % 4 == 1, F.concat(F.lit("#top"), k)).otherwise("")
    return p.select("id", U.stable_id(u).alias("stable"), U.stable_id(u, F.when(k % 3 == 0, F.concat(F.lit(" Req "), k)).otherwise("apply")).alias("supplied"), U.stable_id(F.concat(F.lit("https://a.io/list"), mark)).alias("fragment"))


_AGGREGATORS, _SYSTEMS = ("zhaopin.cn", "indeed.com"), ("greenhouse.io", "lever.co")
_under = lambda names: " OR ".join(f"h = '{n}' OR h LIKE '%.{n}'" for n in names)


@REG.add(f"""
    SELECT id, h <> '' AND NOT ({_under(_AGGREGATORS)}) AND ({_under(_SYSTEMS)} OR len(list_filter(string_split_regex(lower(company), '[^a-z0-9]+'), lambda w: length(w) >= 4 AND w NOT IN {S.WEAK_COMPANY_WORDS} AND contains(replace(h, '-', ''), w))) > 0) AS official
    FROM (SELECT *, {HOST_SQL} AS h FROM ({POSTS_SQL}))
""")
def official_sites(spark, d):
    """F14."""
    return posts(spark, d).select("id", S.official_site(F.col("url"), F.col("company"), _AGGREGATORS, _SYSTEMS).alias("official"))


_LABELS = ("Current employer", "职位名称", "Gender identity", "Are you willing to move?", "Expected salary", "Shoe size", "语言水平", "Technical skills")
_LABEL_SQL = "[" + ", ".join(_q(x) for x in _LABELS) + "][CAST(o_orderkey % 8 AS INT) + 1]"
_KEY_CASE = " ".join(f"WHEN {_hit('lower(x)', p)} THEN '{k}'" for k, p in S.FIELD_LABELS)


@REG.add(f"SELECT o_orderkey AS id, CASE WHEN {_hit('lower(x)', S.SENSITIVE)} THEN NULL {_KEY_CASE} END AS field FROM (SELECT o_orderkey, {_LABEL_SQL} AS x FROM orders)")
def field_keys(spark, d):
    """P41."""
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), S.field_key(label).alias("field"))


@REG.add("""
    SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN '开放' WHEN 'O' THEN '待官网核验' ELSE 'P' END AS shown,
           ['Direct', 'Direct', 'Direct', 'Transferable', 'Adjacent', 'Adjacent', 'Unsupported'][CAST(o_orderkey % 7 AS INT) + 1] AS four FROM orders
""")
def status_labels(spark, d):
    """P22, P36."""
    incoming = F.when(F.col("o_orderstatus") == "F", "已捕获完整JD").when(F.col("o_orderstatus") == "O", "待核验").otherwise(F.col("o_orderstatus"))
    six = F.element_at(F.array(*[F.lit(x) for x in ("Direct", "Credential Direct", "Coursework Match", "Strong Transferable", "Adjacent", "Credential Status Gap", "None")]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), S.shown_status(incoming).alias("shown"), postings.initial_class(six).alias("four"))


@REG.add("""
    SELECT o_orderkey AS id, ['北方医药公司', '统计师 南方研究院', '待核验公司', '东方集团'][CAST(o_orderkey % 4 AS INT) + 1] AS found,
           ['Acme', 'Blue River', 'Blue Hill', 'Delta'][CAST(o_orderkey % 4 AS INT) + 1] AS bookmark FROM orders
""")
def company_inferred(spark, d):
    """From a search result, and from a bookmarked page."""
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    title = pick(("统计师 - 北方医药公司", "统计师", "Biostatistician", "招聘企业：东方集团，统计"))
    text = pick(("x", "南方研究院正在招聘统计师", "no company here", "x"))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), S.company_of_result(title, text).alias("found"),
        S.company_of_bookmark(pick((" Acme ", "careers", "Join", "")), pick(("https://x.com/1", "https://www.blueriver.com/1", "https://blue-hill.cn/2", "https://jobs.delta.com/3")), {"blueriver.com": "Blue River", "delta.com": "Delta"}).alias("bookmark"),
    )


@REG.add(f"""
    SELECT id, {canonical_sql(U.CHINA)} AS china, CASE WHEN id % 5 = 0 THEN '' ELSE {canonical_sql(U.CHINA)} END AS snapshot,
           {canonical_sql(U.IDENTITY)} AS base_page FROM ({POSTS_SQL})
""")
def url_flavours(spark, d):
    """P2c, P2d, P2g: an empty URL stays empty, and the engine's own fragment goes."""
    u = F.col("url")
    return posts(spark, d).select(
        "id", U.canonical_url(u, U.CHINA).alias("china"), U.snapshot_url(F.when(F.col("id") % 5 == 0, " ").otherwise(u)).alias("snapshot"),
        U.base_page_url(postings.distinct_url(u, F.col("company"), F.col("title"))).alias("base_page"),
    )


_SQ = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_FLOOR = "coalesce(" + ", ".join(f"CASE WHEN {_hit('content', p)} THEN CAST(regexp_extract(content, {_q(p)}, 1) AS DOUBLE) * {m}::DOUBLE END" for p, m in R.SALARY_RULES) + ")"


@REG.add(f"SELECT id, round({_FLOOR}, 6) AS floor_k FROM ({POSTS_SQL})")
def salary_floors(spark, d):
    """P28."""
    return posts(spark, d).select("id", F.round(R.monthly_floor(F.col("content")), 6).alias("floor_k"))


_IDENT = lambda x: f"regexp_replace(replace(lower({x}), '&', 'and'), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')"
_PLACE = lambda x: f"replace(regexp_replace({_IDENT(x)}, 'unitedstatesofamerica|unitedstates|usa', '', 'g'), 'remote', '')"
_PLACEHOLDER = f"(lower(trim(title)) IN ({', '.join(_q(x) for x in T.PLACEHOLDER_TITLES)}) OR " + " OR ".join(_hit("lower(trim(title))", f) for f in T._PLACEHOLDER_FORMS) + ")"


@REG.add(f"SELECT id, {_PLACE('location')} AS place, {_PLACEHOLDER} AS placeholder, {_SQ('content')} AS squeezed, coalesce(nullif({_SQ('location')}, ''), {_SQ('company')}) AS first_text FROM ({POSTS_SQL})")
def text_keys(spark, d):
    """P1, P4, P5, P16."""
    return posts(spark, d).select(
        "id", T.location_key(F.col("location")).alias("place"), T.is_placeholder_title(F.col("title")).alias("placeholder"), T.squeeze(F.concat(F.lit(" \n"), F.replace("content", F.lit(" "), F.lit("\t ")))).alias("squeezed"),
        T.first_nonempty(F.col("location"), F.col("company")).alias("first_text"),
    )


@REG.add(f"""
    SELECT id, array_to_string(list_distinct(list_filter([company, location, company], lambda x: x <> '')), ', ') IS NOT NULL AS has_any,
           CASE WHEN location = '' OR location = company THEN company ELSE company || ', ' || location END AS joined,
           list_filter(list_transform(string_split_regex(replace(location, ' - ', ' | '), '[|,，;/]'), lambda x: trim(x)), lambda x: x <> '') AS tags
    FROM ({POSTS_SQL})
""")
def joined_and_split(spark, d):
    """P17, P34."""
    return posts(spark, d).select(
        "id", F.lit(True).alias("has_any"), T.join_distinct(F.col("company"), F.col("location"), F.col("company")).alias("joined"), T.split_tags(F.replace("location", F.lit(" - "), F.lit(" | "))).alias("tags")
    )


@REG.add(f"SELECT id, CASE WHEN {_hit('content', 'clinical trial design')} THEN regexp_extract(content, '(?is)experience(.*?)design', 1) ELSE substr(regexp_extract(repeat(content || ' ', 40), '(?is)experience(.*)$', 1), 1, 5000) END AS part FROM ({POSTS_SQL})")
def text_sections(spark, d):
    """Up to the stop word, else 5000 characters of a long text."""
    part = F.when(F.col("content").rlike("clinical trial design"), T.section(F.col("content"), "experience", "design")).otherwise(T.section(F.repeat(F.concat("content", F.lit(" ")), 40), "experience", "never-there"))
    return joins.read_once(posts(spark, d).select("id", "content"), ["content"], {"part": part}).drop("content")


_VENDORS = (("greenhouse", r"greenhouse\.io"), ("lever", r"lever\.co"), ("workday", "myworkdayjobs"), ("generic", "careers"))


@REG.add(f"SELECT id, CASE {' '.join(f'WHEN {_hit(chr(117) + chr(114) + chr(108), p)} THEN {_q(v)}' for v, p in _VENDORS)} ELSE 'unknown' END AS vendor, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS tenant FROM ({POSTS_SQL})")
def ats_vendors(spark, d):
    """Vendor by host rules in order, tenant from the path."""
    return posts(spark, d).select("id", R.first_match(F.col("url"), _VENDORS, "unknown").alias("vendor"), F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)/", 1).alias("tenant"))


@REG.add("SELECT o_orderkey AS id, 'Built ' || o_orderpriority || ' models for 10% of A & B - ok' AS plain FROM orders")
def latex_text(spark, d):
    """P37."""
    t = F.concat(F.lit(r"\textbf{Built} \emph{"), "o_orderpriority", F.lit("} models for 10\\% of A \\& B -- \\href{http://x.y}{ok} % note\n% whole line"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.latex_to_text(t).alias("plain"))


@REG.add("""
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + CASE WHEN o_orderkey % 4 = 1 THEN INTERVAL 3 HOUR WHEN o_orderkey % 4 = 2 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END END AS at,
           CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE strftime(o_orderdate, '%Y-%m') END AS month FROM orders
""")
def times_parsed(spark, d):
    """P39, P40."""
    day, n = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 4
    iso = F.when(n == 0, day).when(n == 1, F.concat(day, F.lit("T05:00:00+02:00"))).when(n == 2, F.concat(F.lit(" "), day, F.lit("T12:00:00Z "))).otherwise("soon")
    text = F.when(n == 0, F.concat(F.lit("since "), F.date_format("o_orderdate", "MMMM yyyy"))).when(n == 1, F.date_format("o_orderdate", "yyyy.M")).when(n == 2, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("年"), F.date_format("o_orderdate", "M"), F.lit("月"))).otherwise("now")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), postings.parse_time(iso).alias("at"), T.year_month(text).alias("month"))


_INSIDE, _OUTSIDE, _NAMED = "(?i)united states|massachusetts|remote - us", "(?i)china|berlin|北京|上海", "(?i)united states"


@REG.add(f"""
    SELECT id, CASE WHEN location = '' THEN true WHEN {_hit('location', _OUTSIDE)} AND NOT {_hit('location', _NAMED)} THEN false ELSE {_hit('location', _INSIDE)} END AS inside,
           contains(lower(title), 'software') OR {_hit('lower(content)', '(large language|deep learning).{0,30}(model|architecture)')} AS unsupported FROM ({POSTS_SQL})
""")
def region_and_core(spark, d):
    """F7, F8."""
    return posts(spark, d).select("id", postings.in_region(F.col("location"), _INSIDE, _OUTSIDE, _NAMED).alias("inside"), postings.unsupported_core(F.col("title"), F.col("content"), ("software",), "large language|deep learning", "model|architecture").alias("unsupported"))


_SAFE = ("https://a.com/x", "http://127.0.0.1/", "https://user@a.com/", "https://a.com:8080/", "file:///etc", "https://intern.local/", "https://a.com:443/y", "https://localhost/")


@REG.add("""
    SELECT o_orderkey AS id, o_orderkey % 8 IN (0, 6) AS safe, CASE WHEN o_orderkey % 8 < 4 THEN 2 / 3.0::DOUBLE ELSE 0.0::DOUBLE END AS share,
           ['verification_required', 'login_required', 'network_error', 'source_error'][CAST(o_orderkey % 4 AS INT) + 1] AS kind FROM orders
""")
def url_safety(spark, d):
    """F13, F15, F17."""
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("o_orderkey") % len(xs) + 1).cast("int"))
    title = F.when(F.col("o_orderkey") % 8 < 4, "A Data (Scientist) role").otherwise("Nurse")
    log = pick(("page: please solve the CAPTCHA", "redirected to Sign In", "request timed out", "weird"))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), U.is_safe_url(pick(_SAFE)).alias("safe"), U.token_overlap(title, F.lit("data scientist, senior")).alias("share"), postings.interruption(log).alias("kind")
    )


@REG.add(f"SELECT id, sha256('{{\"company\":' || to_json(company) || ',\"title\":' || to_json(title) || ',\"url\":' || to_json(url) || '}}') AS fingerprint FROM ({POSTS_SQL})")
def record_fingerprints(spark, d):
    """P12."""
    return posts(spark, d).select("id", T.record_fingerprint("url", "title", "company").alias("fingerprint"))


@REG.add(f"""
    WITH p AS ({POSTS_SQL}), known AS (SELECT DISTINCT company, title, url FROM p WHERE id % 2 = 0)
    SELECT id, EXISTS (SELECT 1 FROM known k WHERE k.company = p.company AND k.title = p.title) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.company = p.company AND k.title = p.title AND k.url = p.url) AS repost FROM p WHERE id % 2 = 1
""")
def repost_rows(spark, d):
    """D15."""
    p = posts(spark, d).withColumn("k", T.pair_fingerprint(F.col("company"), F.col("title")))
    return dedup.reposts(p.where("id % 2 = 1"), p.where("id % 2 = 0").select("k", "url"), "k", "url").select("id", "repost")


@REG.add(f"""
    SELECT id, CASE WHEN id % 3 = 0 THEN 100 ELSE 0 END + CASE WHEN id % 5 = 0 THEN 30 ELSE 0 END + CASE WHEN content <> '' THEN 10 ELSE 0 END + least(10, length(to_json([title]))) + least(10.0, (id % 120) / 10.0)::DOUBLE AS display FROM ({POSTS_SQL})
""")
def display_ranks(spark, d):
    """C6."""
    k = F.col("id")
    return posts(spark, d).select("id", R.display_rank(k % 3 == 0, k % 5 == 0, F.col("content") != "", F.to_json(F.array("title")), (k % 120).cast("double")).cast("double").alias("display"))


QUERIES, ORACLES = REG.queries, REG.oracles
