"""Queries of requirements, candidates, merges of postings and the summaries around them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions import urls as U
from siltstone.operators import dedup, joins, merge, postings, reports, upsert, verification
from siltstone.operators import requirements as Q
from siltstone.operators import retrieval as R
from siltstone.plans.posts import POSTS_SQL, greedy_groups_sql, logical_sql, posts, same_posting_sql, stable_sql
from siltstone.plans.registry import Registry, table
from siltstone.plans.retrieval_plans import _STEM, _STOPS
from siltstone.plans.text_plans import canonical_sql
from siltstone.sources import sinks

REG = Registry()
_q = lambda s: "'" + s.replace("'", "''") + "'"
_NORM = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '[–—_/]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _holds(text: str, term: str) -> str:
    """Whether a normalized SQL text holds a term: CJK as substring, else between word ends."""
    if any("㐀" <= c <= "鿿" for c in term):
        return f"contains({text}, {_q(term.lower())})"
    return f"regexp_matches({text}, {_q('(^|[^a-z0-9])' + term.lower() + '($|[^a-z0-9])')})"


_TEXT = "replace(replace(content, '. ', E'.\\n- '), ' and ', ', and ')"
_UNITS = lambda x: (
    f"list_filter(list_transform(flatten(list_transform(flatten(list_transform(string_split_regex({x}, '\\n+'), lambda l: CASE WHEN regexp_matches(l, '[^.!?。！？；;]') THEN regexp_extract_all(l, {_q(Q.SENTENCE)}) ELSE [l] END)),"
    f" lambda s: string_split_regex(s, {_q(Q.CLAUSE)}))), lambda u: trim(regexp_replace(regexp_replace(u, {_q(Q.BULLET)}, ''), '\\s+', ' ', 'g'))), lambda u: u <> '')"
)


def _texts(spark, d):
    return posts(spark, d).select("id", F.replace(F.replace("content", F.lit(". "), F.lit(".\n- ")), F.lit(" and "), F.lit(", and ")).alias("text"))


@REG.add(f"SELECT id, {_UNITS(_TEXT)} AS units, list_filter(list_transform(flatten(list_transform({_UNITS(_TEXT)}, lambda u: string_split_regex(u, {_q(Q.ATOM)}))), lambda a: trim(a)), lambda a: a <> '') AS atoms FROM ({POSTS_SQL})")
def text_units(spark, d):
    """Units and atoms of whole texts."""
    u = _texts(spark, d).select("id", Q.units(F.col("text")).alias("units"))
    return u.withColumn("atoms", Q.atoms(F.col("units")))


RULES = (
    ("Degree", "Education", ("phd", "博士")),
    ("Statistics", "Methods", ("statistics", "biostatistics", "统计分析")),
    ("Trials", "Domain", ("clinical trial", "临床试验")),
    ("Programming", "Programming and Data", ("python", "r", "sql", "sas")),
    ("Language Models", "Methods", ("large language model", "大模型")),
)
VOCABULARY = (("causal inference", "Methods"), ("python", "Methods"), ("survival analysis", "Methods"), ("statistics", "Analytical Concept"), ("study design", "Analytical Concept"))


def _extract_sql() -> str:
    rows, n = [], 0
    norm = _NORM("text")
    for label, category, aliases in RULES:
        hits = f"list_filter({[a for a in aliases]!r}, lambda a: CASE a {' '.join(f'WHEN {_q(a)} THEN {_holds(norm, a)}' for a in aliases)} END)"
        rows.append(f"SELECT id, text, {n} AS o, '{label}' AS label, '{category}' AS category, {hits} AS terms FROM p")
        n += 1
    covered = lambda v: " OR ".join(_holds(norm, a) for _, _, aliases in RULES for a in aliases if a == v) or "false"
    for term, category in VOCABULARY:
        rows.append(f"SELECT id, text, {n}, {_q(term.title())}, '{category}', CASE WHEN {_holds(norm, term)} AND NOT ({covered(term)}) THEN ['{term}'] ELSE [] END FROM p")
        n += 1
    every = sorted({a for _, _, x in RULES for a in x} | {v for v, _ in VOCABULARY})
    holds = lambda u: f"len(list_filter(terms, lambda t: CASE t {' '.join(f'WHEN {_q(a)} THEN {_holds(_NORM(u), a)}' for a in every)} END)) > 0"
    short = lambda units: f"list_sort(list_transform(list_filter({units}, lambda u: {holds('u')}), lambda u: length(u)))[1]"
    first = lambda units: f"list_filter({units}, lambda u: {holds('u')} AND length(u) = {short(units)})[1]"
    atoms = f"list_filter(list_transform(flatten(list_transform(units, lambda u: string_split_regex(u, {_q(Q.ATOM)}))), lambda a: trim(a)), lambda a: a <> '')"
    return f"""
        WITH p AS (SELECT id, {_TEXT} AS text FROM ({POSTS_SQL})),
        r AS (SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE len(terms) > 0),
        f AS (SELECT *, row_number() OVER (PARTITION BY id, lower(label) ORDER BY o) AS k, {_UNITS('text')} AS units FROM r),
        s AS (SELECT *, coalesce({first('atoms')}, {first('units')}, text) AS source_text FROM (SELECT *, {atoms} AS atoms FROM f WHERE k = 1))
        SELECT id, 'JD-R' || lpad(CAST(row_number() OVER (PARTITION BY id ORDER BY o) AS VARCHAR), 3, '0') AS requirement_id, label, category, terms AS literal_terms, source_text,
               regexp_matches(source_text, {_q(Q.HARD)}) AS hard FROM s
    """


@REG.add(_extract_sql())
def requirement_rows(spark, d):
    """Rules, then vocabulary; the shortest evidence unit; numbered."""
    return Q.extract_requirements(_texts(spark, d), "id", "text", RULES, VOCABULARY)


_SIGNALS = """
    SELECT l_suppkey AS requirement_id, l_orderkey * 10 + l_linenumber AS fact_id, CASE WHEN l_partkey % 17 = 0 THEN (l_partkey % 5) / 5 ELSE 0 END::DOUBLE AS exact, CASE WHEN l_partkey % 23 = 0 THEN 0.3 ELSE 0 END::DOUBLE AS direct,
           (l_extendedprice % 100)::DOUBLE AS bm25, (l_extendedprice % 7 / 10)::DOUBLE AS cosine, CASE WHEN l_partkey % 29 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS industry, l_partkey % 31 = 0 AS has_path, (l_quantity + l_discount * 10)::DOUBLE AS score FROM lineitem
"""


@REG.add(f"""
    WITH s AS ({_SIGNALS}), k AS (SELECT *, row_number() OVER (PARTITION BY requirement_id ORDER BY bm25 DESC) AS rb, row_number() OVER (PARTITION BY requirement_id ORDER BY cosine DESC) AS rc FROM s),
    c AS (SELECT requirement_id AS q, coalesce(max(bm25) FILTER (rb = 20), 0) AS cb, coalesce(max(cosine) FILTER (rc = 20), 0) AS cc FROM k GROUP BY 1),
    r AS (SELECT s.* FROM s JOIN c ON requirement_id = q WHERE exact > 0 OR direct > 0 OR has_path OR industry > 0 OR bm25 >= cb OR cosine >= cc)
    SELECT requirement_id, fact_id, list_filter([CASE WHEN greatest(exact, direct) >= 0.45 THEN 'exact' END, CASE WHEN bm25 > 0 THEN 'bm25' END, CASE WHEN cosine > 0.08 THEN 'embedding' END, CASE WHEN has_path THEN 'concept_graph' END,
           CASE WHEN industry > 0 THEN 'industry_translation' END], lambda x: x IS NOT NULL) AS channels, score, row_number() OVER (PARTITION BY requirement_id ORDER BY score DESC, fact_id) AS place FROM r QUALIFY place <= 8
""")
def recall_union(spark, d):
    """Five channels, twenty best of BM25 and cosine, the eight best by score."""
    p, e = F.col("l_partkey"), F.col("l_extendedprice")
    s = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("requirement_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), F.when(p % 17 == 0, (p % 5) / 5).otherwise(0.0).alias("exact"),
        F.when(p % 23 == 0, 0.3).otherwise(0.0).alias("direct"), (e % 100).alias("bm25"), (e % 7 / 10).alias("cosine"), F.when(p % 29 == 0, 0.5).otherwise(0.0).alias("industry"), (p % 31 == 0).alias("has_path"),
        (F.col("l_quantity") + F.col("l_discount") * 10).alias("score"),
    )
    return Q.recall_union(s).withColumn("place", F.col("place").cast("bigint"))


_W = lambda x: f"list_distinct(list_filter(string_split_regex(lower({x}), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+'), lambda w: length(w) >= 2))"
_LAYER = lambda c, w: f"list_sum(list_transform({c}, lambda v: least(2, len(list_intersect({_W('v')}, q)))::DOUBLE * {w}))"


@REG.add(f"""
    WITH f AS (SELECT p_partkey AS fact_id, [p_name] AS methods, [p_type, p_brand] AS domains, [p_name || ' ' || p_type] AS facts, CASE p_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'Low' END AS strength FROM part),
    j AS (SELECT n_nationkey AS query_id, {_W("CASE n_nationkey % 4 WHEN 0 THEN 'small cold things' WHEN 1 THEN 'an ECONOMY widget' WHEN 2 THEN 'Brand#13 small gadget' ELSE 'nothing here' END")} AS q FROM nation),
    s AS (SELECT query_id, fact_id, round(({_LAYER('methods', 5)} + {_LAYER('domains', 2)} + {_LAYER('facts', 1)}) * CASE lower(strength) WHEN 'high' THEN 1.12 WHEN 'low' THEN 0.75 ELSE 1.0 END::DOUBLE, 2) AS score FROM f, j)
    SELECT query_id, fact_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS place FROM s WHERE score > 0 QUALIFY place <= 15
""")
def layered_facts(spark, d):
    """Weighted layers, two overlaps a value, strength, the fifteen best."""
    k = F.col("p_partkey") % 3
    f = table(spark, d, "part").select(
        F.col("p_partkey").alias("fact_id"), F.array("p_name").alias("methods"), F.array("p_type", "p_brand").alias("domains"), F.array(F.concat_ws(" ", "p_name", "p_type")).alias("facts"), F.when(k == 0, "high").when(k == 1, "medium").otherwise("Low").alias("strength")
    )
    n = F.col("n_nationkey") % 4
    q = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.when(n == 0, "small cold things").when(n == 1, "an ECONOMY widget").when(n == 2, "Brand#13 small gadget").otherwise("nothing here").alias("t"))
    out = Q.layered_facts(f, q, "query_id", "t", "fact_id", {"exact_method": "methods", "domain": "domains", "verified_fact": "facts"}, "strength")
    return out.withColumn("place", F.col("place").cast("bigint"))


@REG.add(f"SELECT id, {_holds(_NORM('content'), 'r')} AS r, {_holds(_NORM('content'), '统计')} AS cjk, {_holds(_NORM('content'), 'clinical trial')} AS trial FROM ({POSTS_SQL})")
def phrase_hits(spark, d):
    """R2."""
    hit = lambda t: R.contains_phrase(F.col("content"), F.lit(t))
    return posts(spark, d).select("id", hit("R").alias("r"), hit("统计").alias("cjk"), hit("Clinical  Trial").alias("trial"))


_GROUPS = (("clinical trial", "study design"), ("python", "sql"), ("phd", "博士"))


@REG.add(f"""
    SELECT id, {' OR '.join('((' + ' OR '.join(_holds(_NORM('content'), t) for t in g) + ') AND (' + ' OR '.join(_holds(_NORM('title'), t) + ' OR ' + _holds("'python and study design only'", t) for t in g) + '))' for g in _GROUPS)} AS flagged,
           list_filter([{', '.join('CASE WHEN ' + ' OR '.join(_holds(_NORM('content'), t) for t in g) + f" THEN 's{i}' END" for i, g in enumerate(_GROUPS))}], lambda x: x IS NOT NULL) AS scopes FROM ({POSTS_SQL})
""")
def scope_flags(spark, d):
    """The scopes of a requirement, and whether a guardrail names the same group."""
    c = F.col("content")
    scopes = F.filter(F.array(*[F.when(postings.flagged_groups(c, c, [g]), F.lit(f"s{i}")) for i, g in enumerate(_GROUPS)]), lambda x: x.isNotNull())
    guard = F.concat_ws(" | ", "title", F.lit("Python and study design only"))
    return posts(spark, d).select("id", postings.flagged_groups(c, guard, _GROUPS).alias("flagged"), scopes.alias("scopes"))


_TOKENS = f"list_distinct(list_concat(list_transform(list_filter(regexp_extract_all({_NORM('content')}, '[a-z0-9][a-z0-9+#.-]*'), lambda w: w NOT IN ({_STOPS})), lambda w: {_STEM}), flatten(list_transform(regexp_extract_all(content, '[\\x{{3400}}-\\x{{9fff}}]+'), lambda b: CASE WHEN length(b) = 1 THEN [b] ELSE list_transform(range(1, length(b)), lambda i: substr(b, i, 2)) END))))"


@REG.add(f"""
    SELECT id, round(CASE WHEN {_holds(_NORM('content'), 'machine learning')} OR {_holds(_NORM('content'), 'statistical programming')} THEN 1.0::DOUBLE ELSE len(list_intersect(t, ['machine', 'learn', 'statistical', 'programm'])) / sqrt(4.0::DOUBLE * len(t)) END, 6) AS overlap
    FROM (SELECT *, {_TOKENS} AS t FROM ({POSTS_SQL}))
""")
def direct_overlap(spark, d):
    """A term that the other text holds counts 1, else the similarity of the tokens."""
    o = postings.term_overlap(F.array(F.lit("machine learning"), F.lit("statistical programming")), F.col("content"))
    return joins.read_once(posts(spark, d).select("id", "content"), ["content"], {"overlap": F.round(o, 6)}).drop("content")


@REG.add("""
    WITH m AS (SELECT l_orderkey AS requirement_id, l_partkey % 9 AS snippet_id, 'c' || (l_suppkey % 4) AS concept, max({'c': l_discount * 10, 'f': l_quantity > 25}) AS m FROM lineitem GROUP BY 1, 2, 3),
    t AS (SELECT *, row_number() OVER (PARTITION BY requirement_id ORDER BY m.c DESC, m.f DESC, snippet_id, concept) AS place FROM m)
    SELECT requirement_id, bool_or(m.c >= 0.78) AS covered, count(*) AS n FROM t WHERE place <= 4 GROUP BY 1
""")
def template_cover(spark, d):
    """R21."""
    m = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("requirement_id"), (F.col("l_partkey") % 9).alias("snippet_id"), F.concat(F.lit("c"), F.col("l_suppkey") % 4).alias("concept"), (F.col("l_discount") * 10).alias("confidence"),
        F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("n_facts"),
    )
    return postings.template_cover(m)


@REG.add("""
    SELECT 'R' || l_orderkey || '-' || l_partkey AS draft_id, s AS status, CASE WHEN s = 'adjacent_gap' THEN 'no_direct_edit' WHEN l_returnflag = 'R' THEN 'revise_existing' ELSE 'add_to_section' END AS action,
           s <> 'adjacent_gap' AS can_generate, CASE WHEN s = 'adjacent_gap' THEN '' ELSE 'fact ' || l_partkey END AS proposed
    FROM (SELECT *, CASE WHEN l_discount >= 0.08 THEN 'covered' WHEN l_suppkey % 3 = 0 THEN 'supported_gap' WHEN l_suppkey % 3 = 1 THEN 'adjacent_gap' ELSE 'unsupported_gap' END AS s FROM lineitem)
    WHERE s IN ('supported_gap', 'adjacent_gap') AND l_partkey % 5 <> 0
""")
def gap_drafts(spark, d):
    """R23, R24."""
    k = F.col("l_suppkey") % 3
    m = table(spark, d, "lineitem").select(
        F.concat(F.lit("R"), "l_orderkey").alias("requirement_id"), postings.gap_status(F.col("l_discount") >= 0.08, k == 0, k == 1).alias("status"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey")).alias("fact_id"),
        F.when(F.col("l_returnflag") == "R", "project_fact").otherwise("other").alias("evidence_type"), F.concat(F.lit("fact "), "l_partkey").alias("fact"),
    )
    return Q.drafts(m)


@REG.add(f"""
    WITH p AS ({POSTS_SQL}), a AS (SELECT * FROM p WHERE id % 3 <> 0), b AS (SELECT id, CASE WHEN id % 4 = 0 THEN '待补充公司' ELSE company || ' new' END AS company, CASE WHEN id % 5 = 0 THEN 'Jobs' ELSE title || ' II' END AS title, CASE WHEN id % 7 = 0 THEN '' ELSE 'Paris' END AS location,
        CASE WHEN id % 2 = 0 THEN '中国' ELSE '美国' END AS region, CASE id % 4 WHEN 0 THEN content || ' More.' WHEN 1 THEN title WHEN 2 THEN '' ELSE content END AS description, CASE WHEN id % 6 = 0 THEN 'X' || id ELSE '' END AS application_id FROM p WHERE id % 3 <> 1)
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL OR (a.id IS NOT NULL AND b.company = '待补充公司') THEN a.company ELSE b.company END AS company, CASE WHEN b.id IS NULL OR (a.id IS NOT NULL AND b.title = 'Jobs') THEN a.title ELSE b.title END AS title,
           CASE WHEN b.id IS NULL OR (a.id IS NOT NULL AND b.location = '') THEN a.location ELSE b.location END AS location, CASE WHEN b.id IS NULL OR (a.id IS NOT NULL AND length(b.description) < length(a.content)) THEN a.content ELSE b.description END AS description,
           CASE WHEN b.id IS NULL OR a.id IS NOT NULL THEN ['old'] ELSE [] END AS skills, CASE WHEN b.id IS NULL OR (a.id IS NOT NULL AND b.application_id = '') THEN 'old' || a.id ELSE b.application_id END AS application_id,
           coalesce(b.region, '美国') AS region, CASE WHEN b.id IS NULL THEN 'v' WHEN b.region = '中国' THEN '不适用' WHEN a.id IS NULL THEN 'JD 未明确' ELSE 'v' END AS visa,
           CASE WHEN b.id IS NULL THEN a.id % 200 WHEN a.id IS NULL THEN 100 ELSE greatest(a.id % 200, 100) END AS score, CASE WHEN a.id IS NULL THEN 'inserted' WHEN b.id IS NULL THEN 'kept' ELSE 'updated' END AS change
    FROM a FULL JOIN b ON a.id = b.id
""")
def capture_upsert(spark, d):
    """K7."""
    p, k, none = posts(spark, d), F.col("id"), F.array().cast("array<string>")
    old = p.where("id % 3 <> 0").select("id", "company", "title", "location", F.lit("美国").alias("region"), F.lit("v").alias("visa"), (k % 200).alias("score"), F.col("content").alias("description"), F.array(F.lit("old")).alias("skills"), F.concat(F.lit("old"), "id").alias("application_id"))
    new = p.where("id % 3 <> 1").select(
        "id", F.when(k % 4 == 0, merge.UNKNOWN_COMPANY).otherwise(F.concat("company", F.lit(" new"))).alias("company"), F.when(k % 5 == 0, "Jobs").otherwise(F.concat("title", F.lit(" II"))).alias("title"), F.when(k % 7 == 0, "").otherwise("Paris").alias("location"),
        F.when(k % 2 == 0, "中国").otherwise("美国").alias("region"), F.lit("").alias("visa"), F.lit(0).cast("bigint").alias("score"), F.when(k % 4 == 0, F.concat("content", F.lit(" More."))).when(k % 4 == 1, F.col("title")).when(k % 4 == 2, "").otherwise(F.col("content")).alias("description"), none.alias("skills"), F.when(k % 6 == 0, F.concat(F.lit("X"), "id")).otherwise("").alias("application_id"),
    )
    return merge.capture_upsert(old, new, "id")


@REG.add("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 1 THEN 'running' ELSE o_orderstatus END AS o_orderstatus, o_orderstatus = 'O' AND o_orderkey % 4 = 1 AS changed FROM orders
""")
def compare_and_set(spark, d):
    """K9: a queued command is claimed once; others stay as they are."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    asked = o.where("o_orderkey % 4 = 1").select("o_orderkey")
    return merge.compare_and_set(o, asked.unionByName(asked), "o_orderkey", "o_orderstatus", "O", "running")


_FOLD_ROWS = """
    SELECT o_custkey % 40 AS k, o_orderkey AS o, 'c' || (o_orderkey % 3) AS company, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 't' || (o_orderkey % 5) END AS title, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE o_orderpriority END AS description,
           CASE WHEN o_orderstatus = 'F' THEN 'open' ELSE 'x' END AS status, CAST(o_orderkey * 31 % 100 AS INT) AS score, 's' || (o_orderkey % 4) AS source, ['k' || (o_orderkey % 16), ' k' || (o_orderkey % 3)] AS skills FROM orders
"""


@REG.add(f"""
    WITH r AS ({_FOLD_ROWS}), g AS (SELECT k, list({{'c': company, 't': title, 'd': description, 's': status, 'q': {{'v': (status = 'open')::INT, 'n': length(description), 'p': score}}, 'm': score, 'src': [source], 'sk': skills, 'cnt': 1}} ORDER BY o) AS l FROM r GROUP BY k),
    f AS (SELECT k, list_reduce(l, lambda a, b: {{
        'c': CASE WHEN b.q > a.q THEN coalesce(nullif(b.c, ''), a.c) ELSE coalesce(nullif(a.c, ''), b.c) END, 't': CASE WHEN b.q > a.q THEN coalesce(nullif(b.t, ''), a.t) ELSE coalesce(nullif(a.t, ''), b.t) END,
        'd': CASE WHEN b.q > a.q THEN coalesce(nullif(b.d, ''), a.d) ELSE coalesce(nullif(a.d, ''), b.d) END, 's': CASE WHEN b.q > a.q THEN coalesce(nullif(b.s, ''), a.s) ELSE coalesce(nullif(a.s, ''), b.s) END,
        'q': {{'v': greatest(a.q.v, b.q.v), 'n': length(CASE WHEN b.q > a.q THEN coalesce(nullif(b.d, ''), a.d) ELSE coalesce(nullif(a.d, ''), b.d) END), 'p': greatest(a.q.p, b.q.p)}}, 'm': greatest(a.m, b.m), 'src': list_concat(a.src, b.src), 'sk': list_concat(a.sk, b.sk), 'cnt': a.cnt + b.cnt}}) AS x FROM g)
    SELECT 'u' || k AS identity, x.c AS company, x.t AS title, x.d AS description, x.s AS status, x.m AS score, list_sort(list_distinct(x.src)) AS sources,
           list_transform(list_filter(list_zip(list_transform(x.sk, lambda s: trim(s)), range(len(x.sk))), lambda z: list_position(list_transform(x.sk, lambda s: trim(s)), z[1]) = z[2] + 1), lambda z: z[1])[1:12] AS skills, x.cnt AS n_merged FROM f
""")
def china_merge(spark, d):
    """Folded in order by quality; sources sorted, skills in first-seen order, twelve at most."""
    k, n = F.col("o_custkey") % 40, F.col("o_orderkey")
    df = table(spark, d, "orders").select(
        n.alias("o"), F.concat(F.lit(" U"), k).alias("canonical_url"), F.lit("").alias("job_url"), F.lit("").alias("job_key"), F.concat(F.lit("c"), n % 3).alias("company"), F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("t"), n % 5)).alias("title"), F.lit("").alias("location"),
        F.when(n % 6 == 0, "").otherwise(F.col("o_orderpriority")).alias("description"), F.when(F.col("o_orderstatus") == "F", "open").otherwise("x").alias("status"), (n * 31 % 100).cast("int").alias("score"), F.concat(F.lit("s"), n % 4).alias("source"),
        F.array(F.concat(F.lit("k"), n % 16), F.concat(F.lit(" k"), n % 3)).alias("skills"),
    )
    return merge.china_merge(df, "o").drop("location")


@REG.add(f"""
    WITH p AS ({POSTS_SQL}), s AS (SELECT id % 300 AS g, min(id) AS adopted FROM p WHERE id % 2 = 0 GROUP BY 1)
    SELECT p.id, 'A' || p.id AS application_id, s.adopted FROM p JOIN s ON s.g = p.id % 300 WHERE p.id % 2 = 1 AND p.id % 6 = 1
""".replace("s.g = p.id % 300", "s.g = (p.id + 1) % 300"))
def legacy_adoption(spark, d):
    """Rows that name no posting take over the stored row without an id of the same company, title and page."""
    p, k = posts(spark, d), F.col("id")
    page = lambda g: F.concat(F.lit("https://a.com/list/"), g.cast("string"))
    stored = p.where(k % 2 == 0).select("id", F.lit("Acme & Co").alias("company"), F.lit("Jobs").alias("title"), page(k % 300).alias("job_url"), F.lit("").alias("application_id"))
    title = F.when(k % 6 == 1, "JOBS").otherwise("Biostatistician")
    new = p.where(k % 2 == 1).select("id", F.lit("ACME and Co").alias("company"), title.alias("title"), F.concat(page((k + 1) % 300), F.lit("/?utm_source=x")).alias("job_url"), F.concat(F.lit("A"), "id").alias("application_id"))
    return merge.adopt_legacy(stored, new, "id")


@REG.add(f"""
    SELECT id, company, title, list_filter([CASE WHEN NOT regexp_matches(c, 'ph\\.?d|doctorate|doctoral|master''?s|bachelor''?s|博士|硕士|本科') THEN 'degree' END, CASE WHEN NOT (regexp_matches(c, {_q(merge.EXPERIENCE)})) THEN 'experience' END], lambda x: x IS NOT NULL) AS evidence_missing,
           list_filter([CASE WHEN NOT starts_with(url, 'https://') THEN 'non_https_or_missing_url' END, CASE WHEN state <> 'F' THEN 'open_status_not_confirmed' END], lambda x: x IS NOT NULL) AS legitimacy_flags,
           CASE WHEN id % 2 = 0 THEN list_filter([CASE WHEN contains(c, 'python') THEN 'Python' END, CASE WHEN contains(c, 'statistic') THEN 'Statistics' END], lambda x: x IS NOT NULL) ELSE [] END AS required_skills,
           CASE WHEN id % 2 = 0 THEN ['SAS'] ELSE [] END AS preferred_skills
    FROM (SELECT *, lower(content) AS c FROM ({POSTS_SQL}))
""")
def enriched(spark, d):
    """Evidence, flags, and the skills of the two sections."""
    k = F.col("id")
    text = F.when(k % 2 == 0, F.concat(F.lit("Minimum skills: "), "content", F.lit(" Preferred skills: SAS. Benefits: Statistics club."))).otherwise(F.col("content"))
    rules = (("Python", r"(?i)\bpython\b"), ("SAS", r"(?i)\bsas\b(?!, must)"), ("Statistics", r"(?i)statistic"))
    p = posts(spark, d).withColumn("content", F.regexp_replace("content", "or SAS", "or sos")).withColumns({"content": text, "score": F.lit(60)})
    out = merge.enrich(p, "content", "url", "state", "score", ("F",), F.lit(False), rules)
    return out.select("id", "company", "title", "evidence_missing", "legitimacy_flags", "required_skills", "preferred_skills")


@REG.add("""
    SELECT event_type AS source, scanned, valid, matched, limited, reconciled, (SELECT sum(matched) FROM x) >= 100 AS enough, (SELECT bool_and(limited) FROM x) AS all_limited, true AS usable
    FROM (SELECT event_type, count(*) AS scanned, count(value) AS valid, count(*) FILTER (value > 60) AS matched, event_type = 'error' AS limited, bool_and(event_id % 97 <> 1) AS reconciled FROM events GROUP BY 1) x
""".replace("(SELECT sum(matched) FROM x)", "(SELECT count(*) FROM events WHERE value > 60)").replace("(SELECT bool_and(limited) FROM x)", "(SELECT count(*) FROM events WHERE event_type <> 'error') = 0"))
def platform_validation(spark, d):
    """Group totals, limited sources, and the minimum over all; the counters of some scans do not reconcile."""
    e = table(spark, d, "events").select(
        F.col("event_type").alias("source"), F.lit(1).alias("scanned"), F.col("value").isNotNull().cast("int").alias("valid"), F.coalesce((F.col("value") > 60).cast("int"), F.lit(0)).alias("matched"),
        F.when(F.col("event_type") == "error", "rate_limited").otherwise("ok").alias("source_status"), (F.col("event_id") % 97 != 1).alias("accounted_for"),
    )
    return postings.platform_validation(e, 100)


@REG.add("SELECT 'i' || (l_partkey % 6) AS issue, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1")
def quality_board(spark, d):
    """Jobs per issue; an issue counts once a job."""
    checks = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("i"), F.col("l_partkey") % 6)).alias("issue_keys"))
    return postings.quality_board(checks)


@REG.add("""
    SELECT p_brand AS track, count(DISTINCT p_type) AS concepts, count(DISTINCT p_name) AS projects, count(*) AS facts FROM part GROUP BY 1
""")
def knowledge_counts(spark, d):
    """Distinct projects and concepts, and facts, per track."""
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("track")).agg(F.count_distinct("p_type").alias("concepts"), F.count_distinct("p_name").alias("projects"), F.count("*").alias("facts"))


@REG.add("""
    SELECT n_name AS company, 'pool' AS source FROM nation UNION ALL
    SELECT c, source FROM (SELECT 'seller ' || (s_suppkey % 7) AS c, min_by(s_name, s_suppkey) AS source FROM supplier GROUP BY 1)
""")
def all_companies(spark, d):
    """The pool, and companies seen in jobs alone by their first row."""
    pool = table(spark, d, "nation").select(F.col("n_name").alias("company"), F.lit("pool").alias("source"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("seller "), F.col("s_suppkey") % 7).alias("company"), F.col("s_name").alias("source"), "s_suppkey")
    known = table(spark, d, "nation").select(F.col("n_name").alias("company"), F.lit("job").alias("source"), F.col("n_nationkey").cast("bigint").alias("s_suppkey"))
    return postings.all_companies(pool, s.unionByName(known), "company", "s_suppkey").select("company", "source")


@REG.add("""
    SELECT c_mktsegment AS source, 'rows' AS kind, CAST(count(*) AS BIGINT) AS n, NULL::BIGINT AS over FROM customer GROUP BY 1 UNION ALL SELECT DISTINCT c_mktsegment, 'reconcile', 0, NULL FROM customer WHERE c_acctbal > 0
""".replace(", NULL::BIGINT AS over", "").replace(", 0, NULL FROM", ", 0 FROM"))
def sync_messages(spark, d):
    """Rows in chunks of at most fifty per source, and a reconciliation for each complete one."""
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("source"), "c_custkey", "c_acctbal")
    sent = sinks.sync_messages(c.select("source", "c_custkey"), c.where("c_acctbal > 0"))
    checked = sent.withColumn("n", F.when((F.size("payload") == F.col("n")) & (F.col("n") <= 50), F.col("n")))
    return checked.groupBy("source", "kind").agg(F.sum("n").alias("n"))


@REG.add(f"SELECT id, regexp_replace(url, '#.*$', '') || '#posting-' AS stem, {canonical_sql(U.IDENTITY)} AS page FROM ({POSTS_SQL})")
def surrogate_urls(spark, d):
    """K8: the posting's own URL with a mark of its identity, which P2g takes off again."""
    u = postings.distinct_url(F.concat("url", F.lit("#x")), F.col("company"), F.col("title"))
    return posts(spark, d).select("id", F.regexp_extract(u, "^(.*#posting-)[0-9a-z]+$", 1).alias("stem"), U.base_page_url(u).alias("page"))


_PAIR_ROWS = """
    SELECT o_orderkey AS id, o_custkey AS company, o_orderkey % 3 AS title, ['', 'Boston', 'Boston MA', 'Berlin'][CAST(o_orderkey // 3 % 4 AS INT) + 1] AS location, CASE WHEN o_orderkey % 5 < 2 THEN 'R-' || (1000 + o_custkey) ELSE '' END AS app,
           CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'https://a.com/p/' || (o_custkey // 3) || 'x' END AS url FROM orders
"""


_PAIR_COLUMNS = f"""
    SELECT id, 'firm' || company AS co, 'role' || title AS ti, regexp_replace(lower(location), '[^a-z0-9]', '', 'g') AS place, CASE WHEN app <> '' THEN 'explicit:' || lower(app) ELSE '' END AS st, url, true AS named FROM ({_PAIR_ROWS})
"""


def _pair_rows(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    place = F.element_at(F.array(*[F.lit(x) for x in ("", "Boston", "Boston MA", "Berlin")]), (F.floor(k / 3) % 4 + 1).cast("int"))
    return table(spark, d, "orders").select(
        k.alias("id"), F.concat(F.lit("Firm "), c).alias("company"), F.concat(F.lit("Role "), k % 3).alias("title"), place.alias("location"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("https://a.com/p/"), F.floor(c / 3), F.lit("x"))).alias("job_url"),
        F.lit("").alias("canonical_url"), F.when(k % 5 < 2, F.concat(F.lit("R-"), 1000 + c)).otherwise("").alias("application_id"),
    )


@REG.add(same_posting_sql(_PAIR_COLUMNS, False))
def same_postings(spark, d):
    """All pairs that the predicate accepts, of all orders."""
    return dedup.same_posting_pairs(_pair_rows(spark, d))


@REG.add(same_posting_sql(_PAIR_COLUMNS, True))
def same_displayed(spark, d):
    """D6."""
    return dedup.same_posting_pairs(_pair_rows(spark, d), displayed=True)


@REG.add(greedy_groups_sql(same_posting_sql(_PAIR_COLUMNS, True), f"SELECT id, id * 7919 % 1009 AS seen, id % 13 AS rank, company AS grp FROM ({_PAIR_ROWS})"))
def greedy_postings(spark, d):
    """The sequential rule on all orders, against a recursive query that folds each company by itself (no pair crosses companies)."""
    rows = _pair_rows(spark, d).withColumns({"seen": F.col("id") * 7919 % 1009, "rank": F.col("id") % 13})
    return dedup.greedy_display(rows, "seen", "rank").select("id")


@REG.add(f"""
    SELECT id, CASE WHEN app <> '' THEN 'id::explicit:' || lower(app) WHEN url <> '' THEN 'url::' || url || '::role' || title ELSE 'role::firm' || company || '::role' || title || '::' || regexp_replace(lower(location), '[^a-z0-9]', '', 'g') END AS key FROM ({_PAIR_ROWS})
""")
def display_keys(spark, d):
    """D8."""
    rows = dedup.with_identity(_pair_rows(spark, d))
    return rows.select("id", dedup.display_key(rows).alias("key"))


@REG.add(f"SELECT id, 'capture-1-' AS stem, count(*) OVER (PARTITION BY company, location, url, content) AS same FROM ({POSTS_SQL})")
def capture_ids(spark, d):
    """Equal content has one id, other content another."""
    c = postings.capture_id(F.col("company"), F.lit("Jobs"), F.col("location"), F.col("url"), F.col("content"))
    return posts(spark, d).withColumn("c", c).select("id", F.substring("c", 1, 10).alias("stem"), F.count("*").over(W.partitionBy("c")).alias("same"))


@REG.add(f"""SELECT id, '{{"title":' || to_json(title) || ',"company":' || to_json(company) || ',"url":' || to_json(url) || '}}' AS packet FROM ({POSTS_SQL})""")
def json_packets(spark, d):
    """P42."""
    return posts(spark, d).select("id", postings.packet(["title", "company", "url"]).alias("packet"))


_HOST_OF = lambda x: f"regexp_replace(lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"
_PAGE = "CASE id % 5 WHEN 0 THEN url WHEN 1 THEN url || '?utm_source=mail' WHEN 2 THEN replace(url, 'https://', 'https://www.') || '#top' WHEN 3 THEN 'https://jobs.lever.co/other/' || id ELSE 'https://none.example/' || id END"


@REG.add(f"""
    WITH p AS ({POSTS_SQL}), pg AS (SELECT id, {_PAGE} AS url FROM p),
    ap AS (SELECT id * 10 AS app, url, CASE WHEN id % 11 = 0 THEN 'Req-' || id ELSE '' END AS given, lpad(CAST(id * 7919 % 10007 AS VARCHAR), 5, '0') AS tm FROM p WHERE id % 3 = 0 UNION ALL SELECT id * 10 + 1, url, '', '00000' FROM p WHERE id % 21 = 0),
    k AS (SELECT id, url AS u, {stable_sql('url')} AS s, {canonical_sql(U.IDENTITY)} AS c, {_HOST_OF('url')} AS h FROM pg),
    a AS (SELECT app, tm, url AS u, {stable_sql('url', 'given')} AS s, {canonical_sql(U.IDENTITY)} AS c, {_HOST_OF('url')} AS h FROM ap),
    m AS (SELECT id, app, tm, 100 AS score FROM k JOIN a ON k.u = a.u UNION ALL SELECT id, app, tm, 95 FROM k JOIN a ON k.s = a.s AND k.s <> '' UNION ALL SELECT id, app, tm, 80 FROM k JOIN a ON k.c = a.c UNION ALL
          SELECT id, y.x.app, y.x.tm, 20 FROM k JOIN (SELECT h, max({{'tm': tm, 'app': app}}) AS x FROM a WHERE h <> '' GROUP BY 1) y ON k.h = y.h),
    hn AS (SELECT h, count(*) AS n FROM a GROUP BY 1), b AS (SELECT id, max(score) AS score FROM m GROUP BY 1),
    r AS (SELECT id, score, count(*) AS n, max({{'tm': tm, 'app': app}}).app AS recent FROM m JOIN b USING (id, score) GROUP BY 1, 2)
    SELECT k.id, coalesce(score, 0) AS score, CASE score WHEN 100 THEN 'exact-url' WHEN 95 THEN 'stable-job-id' WHEN 80 THEN 'canonical-url' WHEN 20 THEN 'same-host' ELSE '' END AS reason,
           CASE WHEN score = 20 THEN hn.n ELSE coalesce(r.n, 0) END AS n_tied, recent, CASE WHEN score >= 80 AND r.n = 1 THEN recent END AS matched, coalesce(score >= 80 AND r.n > 1, false) AS ambiguous
    FROM k LEFT JOIN r ON r.id = k.id LEFT JOIN hn ON hn.h = k.h
""")
def page_match(spark, d):
    """Pages against applications through URL, stable id, canonical URL and host."""
    p, k, u = posts(spark, d), F.col("id"), F.col("url")
    page = F.when(k % 5 == 0, u).when(k % 5 == 1, F.concat(u, F.lit("?utm_source=mail"))).when(k % 5 == 2, F.concat(F.replace(u, F.lit("https://"), F.lit("https://www.")), F.lit("#top")))
    page = page.when(k % 5 == 3, F.concat(F.lit("https://jobs.lever.co/other/"), k)).otherwise(F.concat(F.lit("https://none.example/"), k))
    first = p.where(k % 3 == 0).select((k * 10).alias("app"), "url", F.when(k % 11 == 0, F.concat(F.lit("Req-"), k)).otherwise("").alias("given"), F.lpad((k * 7919 % 10007).cast("string"), 5, "0").alias("at"))
    again = p.where(k % 21 == 0).select((k * 10 + 1).alias("app"), "url", F.lit("").alias("given"), F.lit("00000").alias("at"))
    return joins.page_matches(p.select("id", page.alias("url")), first.unionByName(again), "id", "url", "app", "url", "given", "at")


# Of every six orders three are stored and three come in; companies repeat, ids and URLs are shared by some.
_IMPORT = """
    SELECT o_orderkey AS id, o_orderkey // 3 % 2 = 0 AS stored, 'Firm ' || o_custkey AS company, 'Role ' || (o_orderkey % 5) AS title, ['', 'Boston', 'Berlin'][CAST(o_orderkey % 3 AS INT) + 1] AS location,
           CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'https://a.com/p/' || (o_custkey // 3) || 'x' END AS job_url, CASE WHEN o_orderkey % 4 = 0 THEN 'R-' || (1000 + o_custkey) ELSE '' END AS app, CAST(o_orderkey * 31 % 101 AS INT) AS score,
           CASE WHEN o_orderkey % 2 = 0 THEN 'JD 未明确' ELSE 'v' || (o_orderkey % 3) END AS visa, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS description, CASE WHEN o_orderkey % 5 < 3 THEN [] ELSE ['k' || (o_orderkey % 9)] END AS skills,
           's' || (o_orderkey % 4) AS source, ['待官网核验', '开放', 'x'][CAST(o_orderkey // 2 % 3 AS INT) + 1] AS status, 't' || (o_orderkey % 50) AS discovered_at FROM orders
"""


@REG.add(f"""
    WITH RECURSIVE p AS MATERIALIZED (SELECT *, regexp_replace(lower(company), '[^a-z0-9]', '', 'g') AS co, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS ti, lower(location) AS place, CASE WHEN app <> '' THEN 'explicit:' || lower(app) ELSE '' END AS st, job_url AS url, true AS named FROM ({_IMPORT})),
    m AS (SELECT a.id AS x, b.id AS y FROM p a JOIN p b ON a.job_url = b.job_url AND a.job_url <> '' WHERE {logical_sql()} UNION SELECT a.id, b.id FROM p a JOIN p b ON a.app = b.app AND a.app <> '' WHERE {logical_sql()}
          UNION SELECT a.id, b.id FROM p a JOIN p b ON a.company = b.company AND a.title = b.title WHERE {logical_sql()}),
    c AS (SELECT y AS id, min(x) AS target FROM m JOIN p a ON a.id = x JOIN p b ON b.id = y WHERE a.stored AND NOT b.stored GROUP BY 1),
    u AS (SELECT id FROM p WHERE NOT stored AND id NOT IN (SELECT id FROM c)),
    f AS (SELECT y AS id, min(x) AS head FROM m WHERE x < y AND x IN (SELECT id FROM u) AND y IN (SELECT id FROM u) GROUP BY 1),
    h AS (SELECT id, id AS head FROM u UNION SELECT h.id, f.head FROM h JOIN f ON f.id = h.head),
    g AS (SELECT id, id AS target, NULL::BIGINT AS head, -1::BIGINT AS seq FROM p WHERE stored UNION ALL SELECT id, target, NULL, id FROM c UNION ALL SELECT id, NULL, min(head), id FROM h GROUP BY id),
    l AS (SELECT target, g.head, list({{'c': company, 't': title, 'l': location, 'j': job_url, 'a': app, 's': score, 'v': visa, 'd': description, 'k': skills, 'o': source, 'z': status, 'w': discovered_at, 'n': CASE WHEN seq < 0 THEN 0 ELSE 1 END}} ORDER BY seq) AS r FROM g JOIN p ON p.id = g.id GROUP BY 1, 2),
    x AS (SELECT target, head, r[1].n = 0 AS had, list_reduce(r, lambda e, n: {{'c': CASE WHEN n.c = '待核验公司' THEN e.c ELSE n.c END, 't': n.t, 'l': coalesce(nullif(n.l, ''), e.l), 'j': e.j, 'a': coalesce(nullif(n.a, ''), e.a), 's': greatest(e.s, n.s),
        'v': CASE WHEN n.v = 'JD 未明确' THEN e.v ELSE n.v END, 'd': coalesce(nullif(n.d, ''), e.d), 'k': CASE WHEN len(n.k) = 0 THEN e.k ELSE n.k END, 'o': CASE WHEN n.d <> '' OR e.o = '' THEN n.o ELSE e.o END,
        'z': CASE WHEN n.z = '待官网核验' AND e.z = '开放' THEN e.z ELSE n.z END, 'w': e.w, 'n': e.n + n.n}}) AS m FROM l)
    SELECT target AS id, head, m.c AS company, m.t AS title, m.l AS location, m.j AS job_url, m.a AS application_id, m.s AS score, m.v AS visa, m.d AS description, m.k AS skills, m.o AS source, m.z AS status, m.w AS discovered_at,
           CAST(m.n AS BIGINT) AS n_merged, CASE WHEN NOT had THEN 'inserted' WHEN m.n > 0 THEN 'updated' ELSE 'kept' END AS change FROM x
""")
def identity_import(spark, d):
    """Half of the orders as stored postings, half as incoming ones that find them, or each other."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    o = table(spark, d, "orders").select(
        k.alias("id"), (F.floor(k / 3) % 2 == 0).alias("stored"), F.concat(F.lit("Firm "), c).alias("company"), F.concat(F.lit("Role "), k % 5).alias("title"), pick(("", "Boston", "Berlin"), k % 3).alias("location"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("https://a.com/p/"), F.floor(c / 3), F.lit("x"))).alias("job_url"), F.lit("").alias("canonical_url"), F.when(k % 4 == 0, F.concat(F.lit("R-"), 1000 + c)).otherwise("").alias("application_id"),
        (k * 31 % 101).cast("int").alias("score"), F.when(k % 2 == 0, upsert.UNCLEAR_VISA).otherwise(F.concat(F.lit("v"), k % 3)).alias("visa"), F.lit("").alias("evidence"), F.when(k % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("description"),
        F.when(k % 5 < 3, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("k"), k % 9))).alias("skills"), F.concat(F.lit("s"), k % 4).alias("source"), pick((upsert.TO_VERIFY, upsert.OPEN, "x"), F.floor(k / 2) % 3).alias("status"), F.concat(F.lit("t"), k % 50).alias("discovered_at"),
    )
    incoming = o.where("not stored").drop("stored").withColumnRenamed("id", "seq").withColumn("original_url", F.lit(""))
    return upsert.identity_upsert(o.where("stored").drop("stored"), incoming).drop("canonical_url", "evidence")


_CHECKED = f"""
    SELECT id, title, CASE WHEN id % 4 = 0 THEN 'REQ ' || id WHEN id % 4 = 1 THEN 'REQ-' || id ELSE '' END AS application_id, CASE WHEN id % 9 = 0 THEN '' ELSE url END AS official_url, url || CASE WHEN id % 6 = 0 THEN '&jobId=J' || id ELSE '' END AS final_url,
           CASE id % 11 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN NULL WHEN 3 THEN 410 ELSE 200 END AS code,
           CASE WHEN id % 17 = 0 THEN '' ELSE title || ' at ' || company || '. ' || content || CASE WHEN id % 5 = 0 THEN ' This job has EXPIRED.' ELSE '' END || CASE WHEN id % 7 = 0 THEN ' Requisition: AB' || id ELSE '' END END AS page,
           CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN title || ' II' ELSE 'Plumber' END AS ptitle, CASE WHEN id % 3 > 0 THEN repeat(content || ' ', CAST(1 + id % 4 AS INT)) END AS pdesc, CASE WHEN id % 8 = 1 THEN 'P-' || id END AS pid FROM ({POSTS_SQL})
"""
_SQUEEZED = lambda x: f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"
_TITLE_WORDS = lambda x: f"list_distinct(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ('the', 'and', 'or', 'of', 'for', 'a', 'an', 'i', 'ii', 'iii')))"
_BLOCKS = ("(?:will not|does not|do not|unable to|not eligible to).{0,80}(?:sponsor|sponsorship)", "(?:sponsorship|visa sponsorship).{0,80}(?:not available|not provided|unavailable)", r"must be (?:a )?u\.?s\.? citizen")
_SUPPORTS = ("(?:visa|h-?1b).{0,80}(?:sponsor|sponsorship)", "sponsorship (?:is )?available", "eligible for (?:employment|visa) sponsorship")
_PROOF = " ".join(f"WHEN regexp_matches(t, '(?i){p}') THEN {{'v': '{v}', 'p': {_SQUEEZED(f"regexp_extract(t, '(?i){p}')")}}}" for v, ps in (("明确不支持", _BLOCKS), ("可能支持", _SUPPORTS)) for p in ps)
_PAGE_IDS = (r"(?i)(?:[?&]|\b)(?:jobId|job_id|jobReq|gh_jid)=([A-Za-z0-9._-]{2,80})", r"(?i)/jobs?/([A-Za-z]{0,12}\d[A-Za-z0-9_-]{2,63})(?:/|\s|$)", r"(?i)\b(?:requisition|req(?:uisition)? id|job id)\s*[:#]?\s*([A-Z]{0,4}\d[A-Z0-9-]{2,63})")
_WELL = lambda x: f"CASE WHEN regexp_matches({x}, '^[A-Za-z0-9][A-Za-z0-9._-]{{1,79}}$') THEN {x} END"
_VERIFIED = f"""
    r AS ({_CHECKED}), s AS (SELECT *, {_SQUEEZED('page')} AS pg, coalesce(nullif(CASE WHEN ptitle IS NOT NULL OR pdesc IS NOT NULL THEN {_SQUEEZED('pdesc')} ELSE {_SQUEEZED('page')} END, ''), {_SQUEEZED('page')}) AS t,
          CASE WHEN ptitle IS NOT NULL OR pdesc IS NOT NULL THEN {_SQUEEZED('pdesc')} ELSE {_SQUEEZED('page')} END AS d, official_url <> '' AND coalesce(code NOT IN (404, 410), true) AND coalesce(code = 200, false) AND page <> '' AS judged FROM r),
    q AS (SELECT *, CASE {_PROOF} ELSE {{'v': 'JD 未明确', 'p': ''}} END AS w, coalesce({_WELL(_SQUEEZED('pid'))}, {', '.join(_WELL(f"regexp_extract(final_url || ' ' || pg, '{p}', 1)") for p in _PAGE_IDS)}, {_WELL(_SQUEEZED('application_id'))}, '') AS ident,
          len(list_intersect({_TITLE_WORDS('title')}, {_TITLE_WORDS("coalesce(nullif(ptitle, ''), substr(pg, 1, 1500))")})) >= 0.55 * len({_TITLE_WORDS('title')}) AND len({_TITLE_WORDS('title')}) > 0 AS titled FROM s),
    z AS (SELECT *, CASE WHEN official_url = '' THEN 'm0' WHEN coalesce(code IN (404, 410), false) THEN 'c1' WHEN NOT judged THEN 'm2' WHEN regexp_matches(lower(pg), 'job is no longer available|position is no longer available|this job has expired|job posting has expired|position has been filled|no longer accepting applications|job not found') THEN 'c3'
          WHEN (ptitle IS NOT NULL OR pdesc IS NOT NULL) AND titled AND length(d) >= 300 THEN 'o4' ELSE 'm5' END AS rung FROM q),
    y AS (SELECT id, official_url, CASE rung[1] WHEN 'm' THEN '待官网核验' WHEN 'c' THEN '已关闭' ELSE '开放' END AS status, CASE rung WHEN 'm0' THEN '未自动定位到可审计的公司官网或官方 ATS 页面。' WHEN 'c1' THEN '公司页面返回 HTTP ' || code || '。' WHEN 'm2' THEN '公司页面暂时无法自动读取（HTTP ' || coalesce(CAST(code AS VARCHAR), '连接失败') || '）。'
          WHEN 'c3' THEN '公司页面显示岗位已关闭或不再接受申请。' WHEN 'o4' THEN '已在公司官网或官方 ATS 找到完整且仍开放的具体 JD。' ELSE '已定位公司页面，但未取得足够证据确认具体 JD 仍开放。' END AS note, CASE WHEN judged THEN d ELSE '' END AS description, CASE WHEN judged THEN w.v END AS visa, CASE WHEN judged THEN w.p ELSE '' END AS proof,
          CASE WHEN judged THEN final_url END AS canonical_url, CASE WHEN judged THEN '官网核验 · ' || {_HOST_OF('final_url')} END AS source, CASE WHEN judged THEN ident ELSE application_id END AS application_id FROM z)
"""


def _verified(spark, d):
    p, k = posts(spark, d), F.col("id")
    page = F.concat(F.col("title"), F.lit(" at "), F.col("company"), F.lit(". "), F.col("content"), F.when(k % 5 == 0, " This job has EXPIRED.").otherwise(""), F.when(k % 7 == 0, F.concat(F.lit(" Requisition: AB"), k)).otherwise(""))
    rows = p.select(
        "id", "title", F.when(k % 4 == 0, F.concat(F.lit("REQ "), k)).when(k % 4 == 1, F.concat(F.lit("REQ-"), k)).otherwise("").alias("application_id"), F.when(k % 9 == 0, "").otherwise(F.col("url")).alias("official_url"),
        F.concat("url", F.when(k % 6 == 0, F.concat(F.lit("&jobId=J"), k)).otherwise("")).alias("final_url"), F.when(k % 11 == 0, 404).when(k % 11 == 1, 500).when(k % 11 == 2, F.lit(None)).when(k % 11 == 3, 410).otherwise(200).alias("status_code"),
        F.when(k % 17 == 0, "").otherwise(page).alias("page_text"), F.when(k % 3 == 1, F.concat("title", F.lit(" II"))).when(k % 3 == 2, "Plumber").alias("posting_title"), F.when(k % 3 > 0, F.expr("repeat(concat(content, ' '), cast(1 + id % 4 as int))")).alias("posting_description"),
        F.when(k % 8 == 1, F.concat(F.lit("P-"), k)).alias("posting_id"),
    )
    return verification.verify(rows)


@REG.add(f"""
    WITH {_VERIFIED} SELECT id, status, note, description, visa, proof, canonical_url, source, application_id, CASE WHEN canonical_url IS NOT NULL THEN note || '；官网：' || canonical_url || '；岗位编号：' || CASE WHEN application_id = '' THEN '未提取' ELSE application_id END || '；Sponsorship：' || visa || CASE WHEN proof <> '' THEN '；原文证据：' || proof ELSE '' END END AS evidence FROM y
""")
def verification_ladder(spark, d):
    """Every rung of the ladder, with notes, evidence and ids."""
    return _verified(spark, d).select("id", "status", "note", "description", "visa", "proof", "canonical_url", "source", "application_id", "evidence")


@REG.add(f"""
    WITH {_VERIFIED} SELECT count(*) AS received, count(*) FILTER (status = '开放') AS open_verified, count(*) FILTER (status = '已关闭') AS closed, count(*) FILTER (status = '待官网核验') AS needs_manual, count(*) FILTER (official_url <> '') AS urls_found,
           count(*) FILTER (application_id <> '') AS ids_found, count(*) FILTER (visa IN ('明确不支持', '可能支持')) AS sponsorship_explicit FROM y
""")
def verification_summary(spark, d):
    """The counts of the ladder."""
    return verification.summary(_verified(spark, d))


_APPROVED = (("include", "Biostatistics", 9), ("include", "sas", 4), ("include", "统计", 8), ("exclude", "Senior", 0), ("exclude", "实习", 0), ("exclude", "INTERN", 0))


@REG.add(f"""
    SELECT id, CAST(least(100, id % 101 + least(15, {' + '.join(f"CASE WHEN contains(lower(content), lower('{t}')) OR contains(lower(title), lower('{t}')) THEN {b} ELSE 0 END" for k, t, b in _APPROVED if k == 'include')})) AS INT) AS score,
           {' OR '.join(f"contains(lower(title), lower('{t}'))" for k, t, _ in _APPROVED if k == 'exclude')} AS blocked FROM ({POSTS_SQL})
""")
def approved_rules(spark, d):
    """approved rules add up to 15 points, and an excluding title blocks."""
    rules = spark.createDataFrame(list(_APPROVED), "kind string, term string, boost int")
    rows = posts(spark, d).withColumn("score", (F.col("id") % 101).cast("int"))
    return postings.apply_rules(rows, rules, "title", "content", "score").select("id", "score", "blocked")


QUERIES, ORACLES = REG.queries, REG.oracles
