"""Postings made from `orders`, the same in DataFrame and in SQL: titles and texts by remainders of the keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import urls as U
from siltstone.plans.registry import table

TITLES = (
    "Biostatistician", "Senior Data Scientist", "Research Scientist III", "Clinical Data Scientist", "Software Engineer", "Quantitative Researcher",
    "Sr. Statistical Scientist", "Epidemiologist", "生物统计师", "物流统计文员", "高级数据科学家", "Decision Scientist, Intern", "Jobs",
    "Machine Learning Scientist", "数据科学家", "Healthcare Consultant", "Bioinformatics Analyst",
)
PHRASES = (
    "PhD in biostatistics or statistics required.", "At least 2 years of experience with clinical trial design.", "5+ years of relevant experience in healthcare.",
    "Python and R for statistical programming.", "Experience with large language model fine-tuning and NLP.", "US citizenship and security clearance needed.",
    "Causal inference, longitudinal data and survival analysis.", "Real-world evidence, HEOR and epidemiology.", "Visa sponsorship available for this role.",
    "We will not provide sponsorship.", "要求博士学历，至少3年经验，月薪 15-25K。", "负责临床试验的统计分析与预测模型。", "大模型与自然语言处理方向。",
    "Deep learning architecture for medical imaging.", "Entry level role; machine learning and study design.", "The cafeteria is on the second floor.",
    "薪资 20000-30000 元。", "Data analysis in SQL or SAS, must know GPU clusters.",
    "要求公民身份。", "The firm will not, under its present policy for this team, sponsor anyone.", "A visa is helped with, and in some cases of this kind we sponsor.",
    "至少 4 years in statistics.", "6年及以上相关工作经验。", "经验3-5年。", "Minimum 2 yrs in healthcare, PhD preferred.", "Experiment design and 需具备2年.",
)
PLACES = ("Boston, Massachusetts", "Remote - US", "北京", "Shanghai, China", "Berlin", "", "New York, United States", "上海市")
COMPANIES = ("Acme Health Inc.", "North-Star Pharma", "Delta & Sons", "某某医药公司", "Blue River LLC")
URLS = (
    "https://boards.greenhouse.io/acme/jobs/{k}", "https://www.northstar.com/careers/job/{k}?utm_source=x&b=2", "https://jobs.lever.co/delta/0a1b2c3d-1111-2222-3333-{k}",
    "http://zhaopin.cn/detail?jobId={k}&from=list", "https://careers.blueriver.com/view?gh_jid={k}", "ftp://files.blueriver.com/{k}",
)

_list = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_at = lambda xs, i: f"{_list(xs)}[CAST({i} % {len(xs)} AS INT) + 1]"
POSTS_SQL = f"""
    SELECT o_orderkey AS id, {_at(COMPANIES, 'o_custkey')} AS company, {_at(TITLES, 'o_orderkey')} AS title, {_at(PLACES, 'o_custkey')} AS location,
           {_at(PHRASES, 'o_orderkey')} || ' ' || {_at(PHRASES, '(o_orderkey // 7)')} || ' ' || {_at(PHRASES, '(o_custkey * 3 + 1)')} AS content,
           replace({_at(URLS, '(o_orderkey + o_custkey)')}, '{{k}}', lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS url, o_orderstatus AS state FROM orders
"""


def _pick(xs: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(i, F.lit(len(xs))) + 1).cast("int"))


def posts(spark: SparkSession, d: str) -> DataFrame:
    """id, company, title, location, content, url, state: one posting per order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    content = F.concat_ws(" ", _pick(PHRASES, k), _pick(PHRASES, F.floor(k / 7)), _pick(PHRASES, c * 3 + 1))
    url = F.replace(_pick(URLS, k + c), F.lit("{k}"), F.lpad(k.cast("string"), 12, "0"))
    return table(spark, d, "orders").select(
        k.alias("id"), _pick(COMPANIES, c).alias("company"), _pick(TITLES, k).alias("title"), _pick(PLACES, c).alias("location"), content.alias("content"), url.alias("url"), F.col("o_orderstatus").alias("state")
    )


_PARTS = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$'"
_IDENT = lambda x: f"regexp_replace(lower(trim({x})), '[^a-z0-9_-]+', '', 'g')"
_STABLE = lambda x: f"(length({x}) BETWEEN 3 AND 160 AND NOT regexp_matches({x}, '{U.PLAIN_WORD}') AND (regexp_matches({x}, '[0-9]') OR regexp_matches({x}, '{U.UUID}')))"


def stable_sql(url: str, supplied: str = "''") -> str:
    """P6 in SQL."""
    part = lambda n: f"regexp_extract({url}, {_PARTS}, {n})"
    host = f"regexp_replace(lower({part(2)}), '^www\\.', '')"
    key = lambda p: f"regexp_replace(lower(split_part({p}, '=', 1)), '[^a-z0-9_]', '', 'g')"
    value = lambda p: _IDENT(f"url_decode(split_part({p}, '=', -1))")
    keys = ", ".join(f"'{k}'" for k in U.ID_KEYS)
    hits = f"list_filter(string_split(substr({part(4)}, 2), '&'), lambda p: contains(p, '=') AND {key('p')} IN ({keys}) AND {_STABLE(value('p'))})"
    found = [f"CASE WHEN {_STABLE(_IDENT(supplied))} THEN 'explicit:' || {_IDENT(supplied)} END", f"CASE WHEN web AND len({hits}) > 0 THEN {host} || ':query:' || {key(hits + '[1]')} || ':' || {value(hits + '[1]')} END"]
    for form in U.ID_PATHS:
        v = _IDENT(f"regexp_extract(url_decode({part(3)}), '{form}', 1)")
        found.append(f"CASE WHEN web AND {_STABLE(v)} THEN {host} || ':path:' || {v} END")
    fragment = f"regexp_replace({part(5)}, '^#', '')"
    v = _IDENT(f"string_split_regex({fragment}, '[=/:]')[-1]")
    found.append(f"CASE WHEN web AND regexp_matches({fragment}, '{U.JOB_FRAGMENT}') AND {_STABLE(v)} THEN {host} || ':hash:' || {v} END")
    return "coalesce(" + ", ".join(found).replace("web AND", f"regexp_matches({url}, '(?i)^https?://') AND") + ", '')"


def logical_sql() -> str:
    """D5 of rows a and b (co, ti, place, st, url, named)."""
    titles = "a.named AND b.named AND a.ti = b.ti"
    near = "(a.place = '' OR b.place = '' OR contains(a.place, b.place) OR contains(b.place, a.place))"
    role, url = f"({titles} AND a.co <> '' AND a.co = b.co)", f"({titles} AND a.url <> '' AND a.url = b.url)"
    return f"((a.co = '' OR b.co = '' OR a.co = b.co) AND CASE WHEN a.st <> '' AND b.st <> '' THEN a.st = b.st WHEN a.st <> '' OR b.st <> '' THEN {url} ELSE {url} OR ({role} AND {near}) END)"


def same_posting_sql(rows: str, displayed: bool) -> str:
    """D5, D6 over rows (id, co, ti, place, st, url, named): all pairs that share a stable id, a URL and title, or a company and title, then the whole predicate."""
    logical = logical_sql()
    role = "(a.named AND b.named AND a.ti = b.ti AND a.co <> '' AND a.co = b.co)"
    more = f" OR (NOT (a.st <> '' AND b.st <> '') AND {role} AND a.place = b.place)" if displayed else ""
    meet = ("a.st = b.st AND a.st <> ''", "a.url = b.url AND a.ti = b.ti AND a.url <> ''", "a.co = b.co AND a.ti = b.ti AND a.co <> ''")
    found = " UNION ".join(f"SELECT a.id AS x, b.id AS y FROM r a JOIN r b ON {on} AND a.id < b.id" for on in meet)
    return f"WITH r AS MATERIALIZED ({rows}), c AS ({found}) SELECT a.id AS a, b.id AS b FROM c JOIN r a ON a.id = x JOIN r b ON b.id = y WHERE ({logical}{more})"


def greedy_groups_sql(pairs: str, rows: str) -> str:
    """D7 as a recursive query over rows (id, seen, rank, grp) and displayed pairs (a, b), all within a group: every group takes its steps at once."""
    at = "coalesce(list_position(list_transform(kept, lambda k: list_contains(near, k.id)), true), 0)"
    return f"""
        WITH RECURSIVE p AS ({pairs}), n AS (SELECT x, list(y) AS near FROM (SELECT a AS x, b AS y FROM p UNION ALL SELECT b, a FROM p) GROUP BY 1),
        o AS MATERIALIZED (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY seen, id) AS i, count(*) OVER (PARTITION BY grp) AS last, id, rank AS r, coalesce(near, []) AS near FROM ({rows}) LEFT JOIN n ON x = id),
        s AS (SELECT DISTINCT grp, 0::BIGINT AS i, last, CAST([] AS STRUCT(id BIGINT, r BIGINT)[]) AS kept FROM o UNION ALL
              SELECT o.grp, o.i, o.last, CASE WHEN {at} = 0 THEN list_append(kept, {{'id': o.id, 'r': o.r}}) WHEN o.r > kept[{at}].r THEN list_concat(list_append(kept[1:{at} - 1], {{'id': o.id, 'r': o.r}}), kept[{at} + 1:]) ELSE kept END FROM s JOIN o ON o.grp = s.grp AND o.i = s.i + 1)
        SELECT unnest(kept).id AS id FROM s WHERE i = last
    """


def greedy_sql(pairs: str, rows: str) -> str:
    """D7 as a recursive query over rows (id, seen, rank) and displayed pairs (a, b)."""
    at = "coalesce(list_position(list_transform(kept, lambda k: list_contains(near, k.id)), true), 0)"
    return f"""
        WITH RECURSIVE p AS ({pairs}), n AS (SELECT x, list(y) AS near FROM (SELECT a AS x, b AS y FROM p UNION ALL SELECT b, a FROM p) GROUP BY 1),
        o AS (SELECT row_number() OVER (ORDER BY seen, id) AS i, id, rank AS r, coalesce(near, []) AS near FROM ({rows}) LEFT JOIN n ON x = id),
        s AS (SELECT 0::BIGINT AS i, CAST([] AS STRUCT(id BIGINT, r BIGINT)[]) AS kept UNION ALL
              SELECT o.i, CASE WHEN {at} = 0 THEN list_append(kept, {{'id': o.id, 'r': o.r}}) WHEN o.r > kept[{at}].r THEN list_concat(list_append(kept[1:{at} - 1], {{'id': o.id, 'r': o.r}}), kept[{at} + 1:]) ELSE kept END FROM s JOIN o ON o.i = s.i + 1)
        SELECT unnest(kept).id AS id FROM s WHERE i = (SELECT max(i) FROM o)
    """
