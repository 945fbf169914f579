"""Queries of the adapters and of staged files: what is written through a sink is read back through a source."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from siltstone.functions import screening as S
from siltstone.plans.posts import POSTS_SQL, posts
from siltstone.plans.registry import Registry, table
from siltstone.plans import literals as L
from siltstone.plans.screen_plans import _hit, _points, _q
from siltstone.plans.text_plans import canonical_sql
from siltstone.functions import urls as U
from siltstone.sources import adapters as A
from siltstone.sources import files, markup, sinks, staged
from siltstone.store import Table, new_folder, settings
from siltstone.streaming import ingest, lapse

REG = Registry()
_case = lambda text, rules, default: "CASE " + " ".join(f"WHEN {_hit(text, p)} THEN '{k}'" for k, p in rules) + f" ELSE '{default}' END"
_tags = lambda text, rules: "list_filter([" + ", ".join(f"CASE WHEN {_hit(text, p)} THEN '{k}' END" for k, p in rules) + "], lambda x: x IS NOT NULL)"
_KEY = lambda x: f"substr(sha256({x}), 1, 24)"
_SCAN_ID = "coalesce(" + ", ".join(f"nullif(regexp_extract(url, {_q(f)}, 1), '')" for f in S.APPLICATION_IDS["scan"]) + ", '')"
_SERVER_ID = "coalesce(" + ", ".join(f"nullif(regexp_extract(url, {_q(f)}, 1), '')" for f in S.APPLICATION_IDS["server"]) + ", '')"
_KEEP = ("source_id", "job_key", "title", "location", "region", "track", "score", "visa", "skills", "canonical_url", "application_id", "status")


def _raw(spark, d):
    return posts(spark, d).withColumn("source_id", F.col("id"))


@REG.add(f"""
    WITH p AS (SELECT *, lower(title || ' ' || content) AS t, {L.years_sql('scan', 'lower(content)')} AS years, {L.visa_sql('scan', 'lower(content)')} AS visa, {_SCAN_ID} AS ident FROM ({POSTS_SQL})),
    s AS (SELECT *, {L.score_sql('scan', 'visa')} AS score FROM p WHERE {L.wanted_sql('scan')} AND NOT {L.excluded_sql()} AND {L.eligible_sql('scan', 'visa')} AND {_hit('lower(content)', S.PHD)})
    SELECT id AS source_id, {_KEY("regexp_replace(lower(company), '[^a-z0-9_]+', '', 'g') || '::' || coalesce(nullif(ident, ''), trim(regexp_replace(lower(title), '[^a-z0-9_]+', ' ', 'g')))")} AS job_key, title,
           CASE WHEN location = '' THEN 'Boston, US' ELSE location END AS location, '美国' AS region, {_case('t', A.SCAN_TRACKS, 'Technology')} AS track, score, visa, {_tags('content', A.SKILLS)}[1:7] AS skills,
           {canonical_sql(U.MERGE)} AS canonical_url, ident AS application_id, '待官网核验' AS status FROM s WHERE score >= 55
""")
def adapt_scraper(spark, d):
    """Scraper frame rows."""
    raw = _raw(spark, d).select("source_id", "title", F.col("content").alias("description"), "company", F.lit("").alias("job_url_direct"), F.col("url").alias("job_url"), "location", F.lit("Boston").alias("city"), F.lit("").alias("state"), F.lit("US").alias("country"))
    return A.from_scraper(raw).select(*_KEEP)


@REG.add(f"""
    WITH p AS (SELECT *, ['Entry', 'senior', '', 'mid'][CAST(id % 4 AS INT) + 1] AS level, CASE WHEN {_hit('location', A.CHINA_PLACE)} THEN '中国' WHEN {_hit('location', A.US_PLACE)} THEN '美国' ELSE '' END AS region FROM ({POSTS_SQL}))
    SELECT id AS source_id, {_KEY('lower(url)')} AS job_key, title, location, region, {_case('title', A.AGGREGATOR_TRACKS, 'Technology')} AS track,
           CAST(least({S.SHORT_RUBRICS['aggregator'][1]}, {S.SHORT_RUBRICS['aggregator'][0]} + {_points('title', S.SHORT_RUBRICS['aggregator'][2])} + CASE WHEN level = 'Entry' THEN 8 ELSE 0 END) AS INT) AS score,
           CASE WHEN region = '中国' THEN '不适用' ELSE 'JD 未明确' END AS visa, CAST([] AS VARCHAR[]) AS skills, url AS canonical_url, '' AS application_id, '待官网核验' AS status
    FROM p WHERE {_hit('title', A.AGGREGATOR_TITLE)} AND NOT {_hit('title', A.AGGREGATOR_EXCLUDED)} AND region <> '' AND level <> 'senior'
""")
def adapt_aggregator(spark, d):
    """Rows of a job-board aggregator."""
    level = F.element_at(F.array(*[F.lit(x) for x in ("Entry", "senior", "", "mid")]), (F.col("id") % 4 + 1).cast("int"))
    return A.from_aggregator(_raw(spark, d).withColumn("skill_level", level)).select(*_KEEP)


@REG.add(f"""
    WITH p AS (SELECT *, title || ' ' || content AS b, CASE WHEN location = '' THEN 'Remote' ELSE location END AS place FROM ({POSTS_SQL}))
    SELECT id AS source_id, {_KEY("lower(company) || '::' || lower(title) || '::' || lower(place)")} AS job_key, title, place AS location, '美国' AS region, CASE WHEN {_hit('b', '(?i)biostat|clinical|pharma|health')} THEN 'Pharma' ELSE 'Technology' END AS track,
           CAST(least({S.SHORT_RUBRICS['cloud'][1]}, {S.SHORT_RUBRICS['cloud'][0]} + {_points('b', S.SHORT_RUBRICS['cloud'][2])}) AS INT) AS score, 'JD 未明确' AS visa, {_tags('b', A.CLOUD_SKILLS)}[1:7] AS skills, url AS canonical_url, CAST(id AS VARCHAR) AS application_id, '待官网核验' AS status
    FROM p WHERE {_hit('title', A.CLOUD_TITLE)} AND NOT {_hit('title', A.CLOUD_EXCLUDED)} AND {_hit('b', A.CLOUD_RELEVANT)}
""")
def adapt_cloud(spark, d):
    """Rows of a public API, whose field names differ between rows."""
    raw = _raw(spark, d).select("source_id", F.when(F.col("id") % 2 == 0, F.col("title")).alias("position"), F.when(F.col("id") % 2 == 1, F.col("title")).alias("jobTitle"), F.col("company").alias("companyName"), F.col("url").alias("apply_url"),
                                F.concat(F.lit("<p>"), "content", F.lit("</p>")).alias("description"), F.col("location").alias("jobGeo"), "id")
    return A.from_cloud(raw, "cloud").select(*_KEEP)


@REG.add(f"""
    WITH p AS (SELECT *, title || ' ' || content AS b, CASE WHEN location = '' THEN '中国' ELSE location END AS place, CASE WHEN id % 3 = 0 THEN '' ELSE url END AS link FROM ({POSTS_SQL})),
    s AS (SELECT *, {_tags('b', A.LOCAL_SKILLS)} AS skills, {_hit('b', '(?i)博士|ph\\.?d\\.?|doctorate|doctoral')} AS degree, CASE WHEN link = '' THEN '' ELSE {canonical_sql(U.CHINA, 'link')} END AS canon FROM p
          WHERE NOT {_hit('lower(title)', S.CHINA_EXCLUDED_TITLE)} AND NOT {_hit('lower(title)', S.CHINA_IRRELEVANT)})
    SELECT id AS source_id, {_KEY("coalesce(nullif(canon, ''), lower(company) || '::' || lower(title) || '::' || lower(place))")} AS job_key, title, place AS location, '中国' AS region, {_case('lower(b)', A.LOCAL_TRACKS, 'Technology')} AS track,
           CAST(least(100, 45 + CASE WHEN degree THEN 15 ELSE 0 END + 10 + least(20, len(skills) * 3)) AS INT) AS score, '不适用' AS visa, skills, canon AS canonical_url, '' AS application_id, CASE WHEN degree THEN '已捕获完整JD' ELSE '待核验' END AS status FROM s
""")
def adapt_snapshot(spark, d):
    """Rows of an exported snapshot."""
    raw = _raw(spark, d).select("source_id", F.col("title").alias("jobName"), F.col("company").alias("employer"), F.when(F.col("id") % 3 != 0, F.col("url")).alias("href"), F.col("content").alias("jd"), F.col("location").alias("city"))
    return A.from_snapshot(raw, "snapshot").select(*_KEEP)


@REG.add(f"""
    WITH p AS ({POSTS_SQL}), l AS (SELECT id // 3 AS k, max(id) AS id FROM p GROUP BY 1), x AS (SELECT k, p.* EXCLUDE (content), CASE WHEN p.id % 4 = 0 THEN '' ELSE content END AS jd, CASE WHEN p.id % 4 = 0 THEN '' ELSE company END AS firm FROM l JOIN p ON p.id = l.id),
    c AS (SELECT *, title || ' ' || jd || ' ' || CASE WHEN id % 4 = 0 THEN 'sql' ELSE 'sql SAS' END AS content, CASE WHEN firm <> '' THEN firm WHEN id % 8 = 0 THEN 'Boss Co' ELSE '' END AS company2 FROM x),
    s AS (SELECT *, {_tags('content', A.LOCAL_SKILLS)} AS found, {L.years_sql('collector', 'lower(content)')} AS years FROM c)
    SELECT 'K' || k AS source_id, {_KEY("'K' || k")} AS job_key, title, location, '中国' AS region, {_case('lower(content)', A.LOCAL_TRACKS, 'Technology')} AS track, CAST(least(92, 68 + least(18, len(found) * 3) + CASE WHEN jd <> '' THEN 5 ELSE 0 END) AS INT) AS score, '不适用' AS visa,
           url AS canonical_url, 'K' || k AS application_id, company2 AS company
    FROM s WHERE {_hit('title', A.LOCAL_TITLE)} AND NOT {_hit('lower(title)', S.CHINA_EXCLUDED_TITLE)} AND NOT {_hit('lower(title)', S.CHINA_IRRELEVANT)} AND company2 <> '' AND coalesce(years <= 3, true) AND NOT {_hit('lower(content)', S.CHINA_EXCLUDED_CORE)}
""")
def adapt_collector(spark, d):
    """P20: listing rows with their last detail row, one row per key."""
    p = posts(spark, d).withColumn("row_key", F.concat(F.lit("K"), F.floor(F.col("id") / 3)))
    listing = p.select("row_key", "title", F.lit("").alias("company"), F.when(F.col("id") % 8 == 0, "API v2").otherwise("dom").alias("salary_source"), F.lit("Boss Co").alias("boss_name"), F.lit("/c/1").alias("company_link"), F.col("url").alias("job_link"), "location", F.lit("sql").alias("skills"), F.col("id").alias("seen"))
    details = p.where("id % 4 <> 0").select("row_key", "company", F.col("content").alias("jd"), F.lit("SAS").alias("skill_tags"), F.col("id").alias("seen"))
    newest = p.groupBy("row_key").agg(F.max("id").alias("seen"))
    current = details.join(newest, ["row_key", "seen"], "left_semi")  # details of the listing's own version
    return A.from_collector(listing, current, "row_key", "seen").select("source_id", "job_key", "title", "location", "region", "track", "score", "visa", "canonical_url", "application_id", "company")


@REG.add(f"""
    WITH p AS (SELECT *, lower(title || ' ' || content) AS t, {L.years_sql('server', 'lower(content)')} AS years, CASE WHEN {_hit('location', A.CHINA_PLACE)} THEN '中国' ELSE '美国' END AS region, {L.visa_sql('server', 'lower(content)')} AS v FROM ({POSTS_SQL})),
    s AS (SELECT *, CASE WHEN region = '美国' THEN v END AS visa FROM p),
    k AS (SELECT *, {L.score_sql('server', 'visa')} AS score FROM s WHERE {L.wanted_sql('server')} AND NOT {L.excluded_sql()} AND {L.eligible_sql('server', 'visa')}
          AND regexp_matches(lower(content), '\\bph\\.?d\\.?\\b|doctoral|doctorate|博士|硕博|硕士(?:研究生)?(?:及|或)?以上') AND NOT (company = 'Blue River LLC' AND title = 'Epidemiologist'))
    SELECT id AS source_id, title, region, {L.server_track_sql()} AS track, score, v AS visa, {L.server_skills_sql()} AS skills, {canonical_sql(U.IDENTITY)} AS canonical_url, CASE WHEN id % 5 = 0 THEN 'S' || id ELSE {_SERVER_ID} END AS application_id, '开放' AS status FROM k WHERE score >= 55
""")
def storable_candidates(spark, d):
    """P21."""
    c = _raw(spark, d).select("source_id", "company", "title", "location", "content", F.col("url").alias("job_url"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("S"), "id")).otherwise("").alias("application_id"), F.lit("board").alias("source"))
    ignored = spark.createDataFrame([("blue river llc::epidemiologist",)], "fingerprint string")
    return A.storable(c, ignored).select("source_id", "title", "region", "track", "score", "visa", "skills", "canonical_url", "application_id", "status")


@REG.add(f"""
    WITH p AS (SELECT *, CASE WHEN id % 2 = 0 THEN '中国' ELSE '美国' END AS region, lower(title || ' ' || content || ' 20K') AS c, title || ' ' || content AS b, CASE WHEN id % 3 = 0 THEN 'https://acme.wd5.myworkdayjobs.com/Ext/job/' || id WHEN id % 3 = 1 THEN 'https://jobs.acme.io/job/' || id ELSE url END AS link FROM ({POSTS_SQL}))
    SELECT id AS source_id, {_KEY('link')} AS job_key, title, CASE WHEN location <> '' THEN location WHEN region = '中国' THEN '中国' ELSE 'Location not listed' END AS location, region, {_case('title', A.AGGREGATOR_TRACKS, 'Technology')} AS track,
           CAST(least({S.SHORT_RUBRICS['portal'][1]}, {S.SHORT_RUBRICS['portal'][0]} + {_points('b', S.SHORT_RUBRICS['portal'][2])}) AS INT) AS score, CASE WHEN region = '中国' THEN '不适用' ELSE 'JD 未明确' END AS visa, {_tags('content', A.SKILLS)}[1:7] AS skills,
           link AS canonical_url, CAST(id AS VARCHAR) AS application_id, '开放' AS status
    FROM p WHERE {_hit('title', A.PORTAL_TITLE)} AND CASE WHEN region = '中国' THEN {_hit('c', S.CHINA_RELEVANT)} AND NOT {_hit('lower(title)', S.CHINA_EXCLUDED_TITLE)} AND NOT {_hit('lower(title)', S.CHINA_IRRELEVANT)} AND NOT {_hit('c', S.CHINA_EXCLUDED_CORE)} AND coalesce({L.years_sql('portal', 'c')} <= 3, true)
              AND (location = '' OR {_hit('location', A.CHINA_PLACE)}) ELSE NOT {_hit('title', A.PORTAL_EXCLUDED)} AND (location = '' OR {_hit('location', A.US_PLACE)}) END
""")
def adapt_portal(spark, d):
    """Rows of a company portal's API, with relative URLs."""
    k = F.col("id")
    raw = _raw(spark, d).withColumns({
        "region": F.when(k % 2 == 0, "中国").otherwise("美国"), "system": F.when(k % 3 == 0, "workday").otherwise("generic"), "salary": F.lit("20K"), "description": F.col("content"),
        "portal": F.when(k % 3 == 0, "https://acme.wd5.myworkdayjobs.com/Ext?q=1").when(k % 3 == 1, "https://jobs.acme.io/list").otherwise(""), "url": F.when(k % 3 < 2, F.concat(F.lit("/job/"), k)).otherwise(F.col("url")),
    })
    return A.from_portal(raw).select(*_KEEP)


@REG.add("""
    SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'https://boards-api.greenhouse.io/v1/boards/acme/jobs?content=true' WHEN 1 THEN 'https://acme.recruitee.com/api/offers' WHEN 2 THEN 'https://jobs.acme.io/xml'
           WHEN 3 THEN 'https://acme.wd5.myworkdayjobs.com/wday/cxs/acme/Ext/jobs' END AS address FROM orders
""")
def board_addresses(spark, d):
    """Addresses by system and tenant; none for an unknown system."""
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    a = A.board_address(pick("greenhouse", "recruitee", "personio", "workday", "unheard-of"), pick("acme", "acme/x", "", "acme.wd5.myworkdayjobs.com/Ext", "acme"), F.lit("https://jobs.acme.io/list?x=1"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), a.alias("address"))


@REG.add("""
    SELECT o_custkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'workday' END AS system, 'Job ' || min(o_orderkey) AS title, 'https://x.io/' || (o_orderkey % 50) AS url, o_orderstatus AS location
    FROM orders WHERE o_custkey % 7 <> 6 GROUP BY 1, 2, 4, 5
""".replace("o_orderstatus AS location", "arg_min(o_orderstatus, o_orderkey) AS location").replace("GROUP BY 1, 2, 4, 5", "GROUP BY 1, 2, 4"))
def board_payloads(spark, d):
    """Rows of staged payloads of three systems, the first of each URL; broken payloads give nothing."""
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_custkey") % 3 == 0, "greenhouse").when(F.col("o_custkey") % 3 == 1, "lever").otherwise("workday")
    title, url, place = F.concat(F.lit("Job "), "o_orderkey"), F.concat(F.lit("https://x.io/"), F.col("o_orderkey") % 50), F.col("o_orderstatus")
    row = F.when(kind == "greenhouse", F.to_json(F.struct(title.alias("title"), url.alias("absolute_url"), F.struct(place.alias("name")).alias("location"))))
    row = row.when(kind == "lever", F.to_json(F.struct(title.alias("text"), url.alias("hostedUrl"), F.struct(place.alias("location")).alias("categories")))).otherwise(F.to_json(F.struct(title.alias("title"), url.alias("externalPath"), place.alias("locationsText"))))
    rows = o.select(F.col("o_custkey").alias("id"), kind.alias("system"), "o_orderkey", row.alias("row"))
    listed = rows.groupBy("id", "system").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "row"))), lambda x: x["row"]), ",").alias("list"))
    whole = F.when(F.col("id") % 7 == 6, "{broken").when(F.col("system") == "lever", F.concat(F.lit("["), "list", F.lit("]"))).when(F.col("system") == "greenhouse", F.concat(F.lit('{"jobs":['), "list", F.lit("]}"))).otherwise(F.concat(F.lit('{"jobPostings":['), "list", F.lit("]}")))
    return A.board_rows(listed.select("id", "system", whole.alias("payload"))).select("id", "system", "title", "url", "location")


_ORDER = StructType([StructField("o_orderkey", LongType()), StructField("o_orderstatus", StringType()), StructField("o_orderpriority", StringType())])


@REG.add("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def json_files(spark, d):
    """Rows as JSON Lines with a receipt, read back."""
    o, folder = table(spark, d, "orders").select(*_ORDER.names), new_folder(spark, "json")
    sinks.write_json(o, folder, o.agg(F.count("*").alias("n")))
    return files.read_json_lines(spark, folder, _ORDER)


@REG.add("SELECT c_custkey, c_mktsegment || ' | ' || c_nationkey AS tags, 'say \"' || c_name || '\", ok' AS note FROM customer")
def csv_files(spark, d):
    """CSV with a list column joined by its separator and quotes in texts, read back by name."""
    folder = new_folder(spark, "csv")
    c = table(spark, d, "customer").select("c_custkey", F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("tags"), F.concat(F.lit('say "'), "c_name", F.lit('", ok')).alias("note"))
    sinks.export(c, f"{folder}/rows.csv", "csv")
    return files.read_any(spark, [f"{folder}/rows.csv"], ["c_custkey", "tags", "note"]).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@REG.add("SELECT n_nationkey AS key, n_name AS name FROM nation")
def json_list_files(spark, d):
    """A file that holds one array; missing, malformed and listless files are empty, a missing document gives its defaults."""
    folder = new_folder(spark, "lists")
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    whole = n.agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("key", "name"))), ","), F.lit(', "no object"]')).alias("value"))
    whole.coalesce(1).write.text(f"{folder}/good")
    spark.range(1).select(F.lit("{broken").alias("value")).coalesce(1).write.text(f"{folder}/broken")
    schema = StructType([StructField("key", LongType()), StructField("name", StringType())])
    parts = [files.read_json_list(spark, f"{folder}/{x}", schema) for x in ("good", "broken", "missing")]
    default = files.read_json_document(spark, f"{folder}/missing", schema, {"key": -1, "name": "none"}).where("key >= 0")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(default)


@REG.add("SELECT o_orderstatus AS folder, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def directory_files(spark, d):
    """All files of a suffix below a folder, newer than a marker of long ago."""
    folder = new_folder(spark, "tree")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"))
    o.repartition("state").write.partitionBy("state").json(folder)
    found = files.read_directory(spark, folder, ".json", StructType([StructField("o_orderkey", LongType())]), newer_than="2000-01-01T00:00:00")
    return found.groupBy(F.regexp_extract("file", "state=([A-Z])", 1).alias("folder")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))


@REG.add("SELECT r_name AS name, 'data' AS chunk FROM region")
def manifest_files(spark, d):
    """Compressed chunks that a manifest lists, and the file modified last."""
    folder = new_folder(spark, "chunks")
    table(spark, d, "region").select(F.col("r_name").alias("name")).coalesce(1).write.option("compression", "gzip").json(f"{folder}/data")
    last = files.latest_file(spark, f"{folder}/data", "*.json.gz").rsplit("/", 1)[1]
    spark.range(1).select(F.to_json(F.struct(F.array(F.lit(f"data/{last}")).alias("chunks"))).alias("value")).coalesce(1).write.text(f"{folder}/manifest")
    rows = files.read_manifest(spark, folder, "manifest", StructType([StructField("name", StringType())]))
    return rows.select("name", F.when(F.col("chunk") == last, "data").alias("chunk"))


@REG.add("SELECT CAST(i AS BIGINT) AS batch, CASE WHEN i < (SELECT count(*) FROM nation) // 10 THEN 10 ELSE (SELECT count(*) FROM nation) % 10 END AS n FROM range(((SELECT count(*) FROM nation) + 9) // 10) t(i)")
def batch_files(spark, d):
    """K4 as files: at most ten rows to a batch, read back by folder."""
    folder = new_folder(spark, "batches")
    sinks.write_batches(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name"), "k", folder, most_rows=10).count()
    back = spark.read.text(folder)
    return back.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"))


@REG.add("""
    SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 0 END AS n, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS BIGINT) END AS fenced FROM customer
""")
def wrapped_payloads(spark, d):
    """Rows under jobs, data or results, a bare list, a map of rows; a fenced JSON block in Markdown."""
    k = F.col("c_custkey")
    forms = ('{"jobs": [1, 2]}', '{"data": [{"x": 1}]}', "[1, 2, 3]", '{"a": {"x": 1}, "b": {"x": 2}}', "no json")
    c = table(spark, d, "customer").select(k.alias("id"), F.element_at(F.array(*[F.lit(x) for x in forms]), (k % 5 + 1).cast("int")).alias("payload"),
                                           F.when(k % 2 == 0, F.concat(F.lit('text\n```json\n{"a": '), k, F.lit("}\n```\n"))).otherwise("no block").alias("md"))
    return c.select("id", F.coalesce(F.size(files.unwrap("payload")), F.lit(0)).alias("n"), files.fenced_json("md", "a bigint")["a"].alias("fenced")).withColumn("n", F.greatest("n", F.lit(0)))


@REG.add("SELECT s_suppkey AS id, 'Job ' || s_name AS title, 'https://x.io/' || s_suppkey AS url, 'Bonn, DE' AS location, CAST(s_suppkey AS VARCHAR) AS ident FROM supplier WHERE s_suppkey % 5 <> 0")
def nested_json(spark, d):
    """Posting rows at any depth of a JSON value, nested places joined, broken JSON and deep chains left out."""
    k = F.col("s_suppkey")
    row = F.to_json(F.struct(F.concat(F.lit("Job "), "s_name").alias("jobTitle"), F.concat(F.lit("https://x.io/"), k).alias("jobUrl"), k.alias("id"), F.struct(F.lit("Bonn").alias("city"), F.lit("DE").alias("country")).alias("location")))
    deep = F.concat(F.lit('{"a":' * 9), row, F.lit("}" * 9))
    p = F.when(k % 5 == 0, F.when(k % 10 == 0, "{broken").otherwise(deep)).otherwise(F.concat(F.lit('{"page": {"list": [{"name": "no link"}, '), row, F.lit("]}}")))
    return markup.harvest_json(table(spark, d, "supplier").select(k.alias("id0"), p.alias("p")), "id0", "p").select(F.col("id0").alias("id"), "title", "url", "location", "ident")


@REG.add("SELECT p_partkey AS id, ['A ' || p_name, 'b'] AS labels, 'https://x.io/' || p_partkey AS first_url, ['One', 'Two'] AS sections, ['x', p_name] AS items, p_name AS feed FROM part")
def marked_up_texts(spark, d):
    """Markdown links, XML feed items, LaTeX sections and items."""
    n, k = F.col("p_name"), F.col("p_partkey")
    t = table(spark, d, "part").select(
        k.alias("id"), F.concat(F.lit("see [A "), n, F.lit("](https://x.io/"), k, F.lit(") and [b](http://y/2) or [no](mailto:z)")).alias("m"), F.concat(F.lit("<item><title><![CDATA["), n, F.lit("]]></title></item><item><u>1</u></item>")).alias("x"),
        F.concat(F.lit("\\section{One} a \\section*{Two} \\begin{itemize}\\item x \\item "), n, F.lit(" \\end{itemize}")).alias("l"),
    )
    links, sections = markup.markdown_links("m"), markup.latex_sections("l")
    return t.select(
        "id", F.transform(links, lambda x: x["label"]).alias("labels"), links[0]["url"].alias("first_url"), F.transform(sections, lambda x: x["name"]).alias("sections"), markup.latex_items(sections[1]["body"]).alias("items"),
        markup.xml_items("x", "item", ("title",))[0]["title"].alias("feed"),
    )


@REG.add("SELECT s_suppkey AS id, 'https://a.com/' || s_suppkey AS target FROM supplier")
def search_redirects(spark, d):
    """Targets of the redirect links of two search layouts."""
    k = F.col("s_suppkey")
    u = F.when(k % 3 == 0, F.concat(F.lit("//d/l/?uddg=https%3A%2F%2Fa.com%2F"), k)).when(k % 3 == 1, F.concat(F.lit("https://r/RU=https%3a%2f%2fa.com%2f"), k, F.lit("/RK=2"))).otherwise(F.concat(F.lit("https://a.com/"), k))
    return table(spark, d, "supplier").select(k.alias("id"), markup.redirect_target(u).alias("target"))


@REG.add("SELECT DISTINCT event_type AS key, user_id % 5 AS fingerprint FROM events")
def arriving_files(spark, d):
    """An inbox read as a stream, each key and fingerprint once, each batch handed to a sink; a second run finds nothing new."""
    folder = new_folder(spark, "inbox")
    rows = table(spark, d, "events").select(F.col("event_type").alias("key"), (F.col("user_id") % 5).alias("fingerprint"))
    rows.repartition(3).write.json(f"{folder}/in")
    schema = StructType([StructField("key", StringType()), StructField("fingerprint", LongType())])
    for _ in range(2):
        stream = ingest.changed_only(ingest.arriving_json(spark, f"{folder}/in", schema, 1).drop("file"), "key", "fingerprint")
        query = ingest.run_batches(stream, lambda batch, n: batch.write.mode("append").parquet(f"{folder}/out"), f"{folder}/state")
        query.awaitTermination()
    return spark.read.schema("key string, fingerprint long").parquet(f"{folder}/out")


@REG.add("SELECT o_orderkey AS job_id, o_orderdate AS next_retry_at FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 6")
def retry_queue(spark, d):
    """The six next retries that are due."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("next_retry_at"))
    return ingest.due_retries(o, F.lit("1996-01-01").cast("timestamp"))


@REG.add("""
    WITH e AS (SELECT DISTINCT user_id || '/' || event_type || '/' || CAST(floor(value / 20) AS BIGINT) AS entity, least(5, (day(ts) - 1) // 5) AS scan FROM events),
    g AS (SELECT entity, scan AS s, lead(scan) OVER (PARTITION BY entity ORDER BY scan) AS n FROM e), c AS (SELECT k FROM range(0, 6) r(k) WHERE k % 4 <> 3),
    d AS (SELECT *, (SELECT list_sort(list(k))[2] FROM c WHERE k > s) AS due FROM g),
    x AS (SELECT *, coalesce(due <= s + 3 AND coalesce(n > due, true), false) AS expired, s + 3 <= 7 AND coalesce(n > s + 3, true) AS dropped FROM d)
    SELECT entity, CAST(due AS BIGINT) AS scan, 'expired' AS state FROM x WHERE expired UNION ALL SELECT entity, CAST(s + 3 AS BIGINT), 'dropped' FROM x WHERE dropped
    UNION ALL SELECT entity, CAST(n AS BIGINT), 'returned' FROM x WHERE expired AND n <= s + 3
""")
def lapse_stream(spark, d):
    """T1, T3 as a stateful stream: sightings staged scan by scan on top of stored rows, with a restart half-way; each lapse once the scans have come that far."""
    folder = new_folder(spark, "sightings")
    entity = F.concat_ws("/", "user_id", "event_type", F.floor(F.col("value") / 20))
    seen = table(spark, d, "events").select(entity.alias("entity"), F.least(F.lit(5), F.floor((F.dayofmonth("ts") - 1) / 5)).alias("scan")).distinct()
    made = Table(seen, "seen")
    seen = made.df
    buckets = 8 + seen.select("entity").distinct().count() // 5000
    stored = seen.where("scan = 0").groupBy("entity").agg(F.max("scan").alias("last"))
    calendar = [k for k in range(6) if k % 4 != 3]
    schema = StructType([StructField("entity", StringType()), StructField("scan", LongType())])
    with settings(spark, {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}):
        for scans in (range(1, 4), range(4, 8)):
            for k in scans:  # a scan that shows nothing of ours still moves the clock
                rows = seen.where(F.col("scan") == k).unionByName(spark.range(1).select(F.lit("~scan").alias("entity"), F.lit(k).cast("bigint").alias("scan")))
                rows.repartition(1).write.mode("append").json(f"{folder}/in")
            states = lapse.lapses(ingest.arriving_json(spark, f"{folder}/in", schema, 1).drop("file"), stored, calendar, keep=3, buckets=buckets)
            query = ingest.run_batches(states, lambda batch, n: batch.write.mode("append").parquet(f"{folder}/out"), f"{folder}/state")
            query.awaitTermination()
    made.drop()
    return spark.read.schema(lapse.OUTPUT).parquet(f"{folder}/out").where("entity <> '~scan'")


@REG.add("""
    WITH r AS (SELECT 'b' || (o_custkey % 5) AS board, o_orderkey % 2 AS term, '/job/' || (o_orderkey // 5) AS path, 'Job ' || o_orderkey AS title, o_orderstatus AS location,
               row_number() OVER (PARTITION BY o_custkey % 5, o_orderkey % 2 ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey % 5, o_orderkey % 2) AS n FROM orders),
    k AS (SELECT *, row_number() OVER (PARTITION BY board, path ORDER BY term DESC, pos DESC) AS place FROM r WHERE pos < 1000 AND pos < CASE board WHEN 'b1' THEN 200 ELSE n END)
    SELECT mode, board, path, title, location FROM k, (SELECT unnest(['batch', 'stream']) AS mode) WHERE place = 1
""")
def staged_boards(spark, d):
    """Pages of a hundred staged in files of 500 at most, read as a batch and, in two runs, as a stream; one posting per path across pages; pages behind a board's total are not read."""
    folder = new_folder(spark, "pages")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    group = W.partitionBy("board", "term")
    o = table(spark, d, "orders").select(F.concat(F.lit("b"), c % 5).alias("board"), (k % 2).alias("term"), k.alias("k"), F.struct(F.concat(F.lit("Job "), k).alias("title"), F.concat(F.lit("/job/"), F.floor(k / 5)).alias("externalPath"), F.col("o_orderstatus").alias("locationsText")).alias("posting"))
    sizes = o.groupBy("board", "term").agg(F.count("*").alias("n"))
    at = o.withColumn("at", F.row_number().over(group.orderBy("k")) - 1)
    pages = at.groupBy("board", "term", (F.floor(F.col("at") / 100) * 100).alias("offset")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "posting"))), lambda x: x["posting"]).alias("jobPostings")).join(sizes, ["board", "term"])
    total = F.when(F.col("board") == "b1", 120).otherwise(F.col("n"))
    texts = Table(pages.select("offset", F.to_json(F.struct("board", "term", "offset", total.alias("total"), "jobPostings")).alias("value")), "texts")
    out = f"{folder}/out"
    for half in (F.col("offset") % 200 == 0, F.col("offset") % 200 != 0):
        texts.df.where(half).select("value").write.mode("append").option("maxRecordsPerFile", 500).text(f"{folder}/in")
        query = ingest.run_batches(staged.stream_pages(spark, f"{folder}/in"), lambda batch, n: batch.write.mode("append").parquet(out), f"{folder}/state")
        query.awaitTermination()
    texts.drop()
    batch, stream = staged.board_postings(staged.read_pages(spark, f"{folder}/in")), staged.board_postings(spark.read.schema(staged.SCHEMA).parquet(out))
    return batch.select(F.lit("batch").alias("mode"), "*").unionByName(stream.select(F.lit("stream").alias("mode"), "*"))


QUERIES, ORACLES = REG.queries, REG.oracles
