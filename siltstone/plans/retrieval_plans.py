"""Queries of text retrieval, vectors, graphs and graded matching."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators import phrases
from siltstone.operators import retrieval as R
from siltstone.operators.nearest import nearest
from siltstone.operators.ranked import bm25_top
from siltstone.plans.registry import Registry, table

REG = Registry()
_NORM = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '[–—_/]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_STOPS = ", ".join(f"'{w}'" for w in R.STOP_WORDS)
_STEM = """CASE WHEN starts_with(w, 'collaborat') THEN 'collaborat' WHEN length(w) > 5 AND ends_with(w, 'ing') THEN w[:-4]
    WHEN length(w) > 4 AND ends_with(w, 'ed') THEN w[:-3] WHEN length(w) > 4 AND ends_with(w, 's') THEN w[:-2] ELSE w END"""
_STEM = _STEM.replace("w[:-4]", "substr(w, 1, length(w) - 3)").replace("w[:-3]", "substr(w, 1, length(w) - 2)").replace("w[:-2]", "substr(w, 1, length(w) - 1)")


def terms_sql(table_name: str, key: str, text: str = "text") -> str:
    """(key, term): one row per token; the tables hold no CJK text."""
    return f"SELECT {key}, {_STEM} AS term FROM (SELECT {key}, unnest(regexp_extract_all({_NORM(text)}, '[a-z0-9][a-z0-9+#.-]*')) AS w FROM {table_name}) WHERE w NOT IN ({_STOPS})"


@REG.add(f"SELECT item_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms, string_agg(DISTINCT term, ' ' ORDER BY term) AS terms FROM ({terms_sql('benchmark', 'item_id')}) GROUP BY 1")
def tokenize_terms(spark, d):
    """R1, R3."""
    t = table(spark, d, "benchmark").select("item_id", R.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    u = F.array_distinct("t")
    return t.select("item_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(u).cast("bigint").alias("n_terms"), F.array_join(F.array_sort(u), " ").alias("terms"))


_BM25 = f"""
    t AS ({terms_sql('documents', 'doc_id')}), q AS (SELECT item_id, term, count(*) AS qf FROM ({terms_sql('benchmark', 'item_id')}) GROUP BY 1, 2),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), dl AS (SELECT d.doc_id, count(term) AS dl FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY 1),
    st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    bm AS (SELECT item_id, tf.doc_id, sum(qf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(1.0::DOUBLE, a)))) AS bm25
           FROM q JOIN tf ON q.term = tf.term JOIN df ON df.term = q.term JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY 1, 2)
"""


def _bm25_sides(spark, d):
    docs = table(spark, d, "documents").select("doc_id", R.tokens(F.col("text")).alias("t"))
    items = table(spark, d, "benchmark").select("item_id", R.tokens(F.col("text")).alias("t"))
    return items, "item_id", "t", docs, "doc_id", "t"


@REG.add(f"""
    WITH {_BM25}, r AS (SELECT item_id, doc_id, round(bm25, 6) AS bm25 FROM bm)
    SELECT item_id, doc_id, bm25 FROM (SELECT *, rank() OVER (PARTITION BY item_id ORDER BY bm25 DESC) AS k FROM r) WHERE k <= 20
""")
def bm25_topk(spark, d):
    """The twentieth score and all its ties."""
    return bm25_top(*_bm25_sides(spark, d), 20, ties=True).select("item_id", "doc_id", "bm25")


_VEC = lambda t, k: f"""
    (WITH n AS (SELECT {k}, {_NORM('text')} AS s FROM {t}),
    f AS (SELECT {k}, term AS f FROM ({terms_sql(t, k)}) UNION ALL SELECT {k}, unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) FROM n WHERE length(s) >= 3),
    c AS (SELECT {k}, f, count(*) AS n FROM f GROUP BY 1, 2),
    u AS (SELECT f, list_reduce(list_transform(string_split(f, ''), lambda x: CAST(unicode(x) AS BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) AS h FROM (SELECT DISTINCT f FROM c)),
    w AS (SELECT {k}, h % 384 AS bucket, sum(CASE WHEN h % 2 = 0 THEN n ELSE -n END)::DOUBLE AS w FROM c JOIN u USING (f) GROUP BY 1, 2)
    SELECT {k}, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY {k})) AS w FROM w)
"""  # noqa: E731


@REG.add(f"""
    WITH a AS {_VEC('benchmark', 'item_id')}, b AS {_VEC('documents', 'doc_id')},
    s AS (SELECT item_id, doc_id, round(greatest(0, sum(a.w * b.w)), 6) AS cosine FROM a JOIN b ON a.bucket = b.bucket GROUP BY 1, 2)
    SELECT item_id, doc_id, cosine FROM (SELECT *, rank() OVER (PARTITION BY item_id ORDER BY cosine DESC) AS k FROM s) WHERE k <= 8
""")
def hashed_cosine(spark, d):
    """Whole texts as hashed vectors, the eight nearest documents of each item with their ties."""
    docs = R.hashed_vectors(table(spark, d, "documents"), "doc_id", "text")
    items = R.hashed_vectors(table(spark, d, "benchmark"), "item_id", "text")
    return nearest(items, docs, "item_id", "doc_id", "vector", "vector", 8, ties=True)


_DOT = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


@REG.add(f"""
    WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT q, vec_id, round(greatest(0, {_DOT('q.e', 'v.embedding')} / sqrt({_DOT('q.e', 'q.e')} * {_DOT('v.embedding', 'v.embedding')})), 6) AS cosine FROM q, embeddings v WHERE vec_id <> q)
    SELECT q, vec_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, vec_id) AS k FROM s) WHERE k <= 5
""")
def vector_topk(spark, d):
    """A stated query set (ids divisible by 20) against all vectors, five nearest each."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding")
    return nearest(q, v, "q", "vec_id", "embedding", "embedding", 5, others=True)


@REG.add(f"""
    WITH a AS (SELECT DISTINCT item_id, term FROM ({terms_sql('benchmark', 'item_id')})), b AS (SELECT DISTINCT doc_id, term FROM ({terms_sql('documents', 'doc_id')})),
    na AS (SELECT item_id, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT doc_id, count(*) AS n FROM b GROUP BY 1),
    s AS (SELECT item_id, doc_id, count(*) AS k FROM a JOIN b USING (term) GROUP BY 1, 2)
    SELECT item_id, doc_id, round(k / sqrt(na.n * nb.n), 6) AS similarity FROM s JOIN na USING (item_id) JOIN nb USING (doc_id) WHERE k / sqrt(na.n * nb.n) >= 0.35
""")
def set_similarity(spark, d):
    """A term join counts the overlaps; no pair without a common term or of sizes too far apart is counted."""
    a = table(spark, d, "benchmark").select("item_id", R.tokens(F.col("text")).alias("t"))
    b = table(spark, d, "documents").select("doc_id", R.tokens(F.col("text")).alias("t"))
    return R.similar_sets(a, b, "item_id", "doc_id", "t", 0.35).withColumn("similarity", F.round("similarity", 6))


_EDGES = "SELECT DISTINCT 'p' || (l_partkey % 40) AS src, 's' || (l_suppkey % 25) AS dst, CASE l_partkey % 3 WHEN 0 THEN 'adjacent_concept' WHEN 1 THEN 'functional_equivalent' ELSE 'method_of' END AS type, (l_suppkey % 5) / 10 AS weight, l_suppkey % 25 AS fact FROM lineitem"


@REG.add(f"""
    WITH e AS (SELECT src, dst, type, greatest(0.01, coalesce(nullif(max(weight), 0), 0.4))::DOUBLE AS weight, list(DISTINCT fact) AS facts FROM ({_EDGES}) GROUP BY 1, 2, 3),
    b AS (SELECT src, dst, type, weight, facts FROM e UNION ALL SELECT dst, src, type, weight, facts FROM e),
    q AS (SELECT DISTINCT n_nationkey AS query_id, 'p' || n_nationkey AS node FROM nation),
    h1 AS (SELECT query_id, dst, weight AS score, type = 'adjacent_concept' AS adj, facts FROM q JOIN b ON node = src),
    h2 AS (SELECT query_id, b.dst, score * b.weight AS score, adj OR type = 'adjacent_concept' AS adj, b.facts FROM h1 JOIN b ON h1.dst = b.src),
    p AS (SELECT query_id, unnest(facts) AS fact_id, score FROM (SELECT query_id, facts, score FROM h1 UNION ALL SELECT query_id, facts, score FROM h2))
    SELECT query_id, fact_id, round(max(score), 6) AS score FROM p GROUP BY 1, 2
""")
def graph_two_hop(spark, d):
    """Best path of at most two hops over part-supplier edges."""
    kind = F.when(F.col("l_partkey") % 3 == 0, "adjacent_concept").when(F.col("l_partkey") % 3 == 1, "functional_equivalent").otherwise("method_of")
    e = table(spark, d, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey") % 40).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey") % 25).alias("dst"), kind.alias("type"),
        ((F.col("l_suppkey") % 5) / 10).alias("weight"), (F.col("l_suppkey") % 25).alias("fact"),
    )
    edges = e.groupBy("src", "dst", "type").agg(F.max("weight").alias("weight"), F.collect_set("fact").alias("evidence"))
    starts = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("p"), "n_nationkey").alias("node"))
    return R.two_hops(starts, edges).select("query_id", "fact_id", F.round("score", 6).alias("score"))


@REG.add("""
    WITH c AS (
        SELECT l_discount * 10 AS ex, (l_quantity % 7) / 7 AS dir, l_tax * 12 AS concept, (l_quantity % 10) / 10 AS problem, (l_partkey % 7) / 7 AS industry, l_suppkey % 4 AS lv, l_partkey % 6 AS st, l_partkey % 5 AS att,
               l_quantity % 3 <> 0 AS eligible, l_partkey % 11 = 0 AS barred, l_partkey % 13 = 0 AS over, l_partkey % 5 = 0 AS tool, l_suppkey % 9 = 0 AS adj, l_suppkey % 6 = 5 AS moves, l_suppkey % 8 = 3 AS path,
               l_partkey % 19 < 3 AS emb, CASE WHEN l_partkey % 4 = 1 THEN 2.5 ELSE 0 END AS bm25, l_tax * 2 AS cosine FROM lineitem),
    s AS (SELECT *, least(100, 24 * least(1, ex) + 16 * least(1, concept) + 22 * least(1, problem) + 12 * least(1, industry) + 10 * [1.0, 0.9, 0.6, 0.3][CAST(lv AS INT) + 1]::DOUBLE
                    + 10 * [1.0, 0.9, 0.85, 0.7, 0.15][CAST(att AS INT) + 1]::DOUBLE + 6 * [1.0, 1.0, 1.0, 0.45, 0.25, 0.2][CAST(st AS INT) + 1]::DOUBLE) AS score, CASE WHEN tool THEN ex ELSE greatest(ex, dir) END AS overlap FROM c),
    b AS (SELECT *, CASE WHEN NOT eligible OR st = 5 THEN 'No Evidence' WHEN overlap >= 0.78 AND NOT barred AND NOT over THEN 'Direct' WHEN score >= 42 AND (problem >= 0.34 OR industry >= 0.42 OR moves) THEN 'Strong Transferable'
                         WHEN score >= 16 OR path OR bm25 > 0 OR cosine > 0.12 THEN 'Adjacent' ELSE 'No Evidence' END AS b0 FROM s),
    k AS (SELECT *, CASE WHEN tool AND ex < 0.78 THEN 'No Evidence' WHEN adj AND ex < 0.78 THEN 'Adjacent' WHEN emb AND b0 IN ('Direct', 'Strong Transferable') THEN 'Adjacent' ELSE b0 END AS label FROM b)
    SELECT label, CASE WHEN label = 'Direct' AND st IN (3, 4) THEN 'conditional' WHEN label = 'Direct' THEN 'yes' WHEN label = 'Strong Transferable' THEN 'conditional' ELSE 'no' END AS recommended, count(*) AS n, round(avg(score), 4) AS mean_score
    FROM k GROUP BY 1, 2
""")
def blend_and_classify(spark, d):
    """Blend, ladder, demotions and recommendation on signals made from lineitem."""
    levels, tiers = ["high", "high", "medium", "low"], ["primary", "secondary", "primary", "primary"]
    states = ["completed", "implemented", "reported_result", "in_progress", "planned", "project_context"]
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    part, supp, quantity = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")
    c = table(spark, d, "lineitem").select(
        (F.col("l_discount") * 10).alias("exact"), ((quantity % 7) / 7).alias("direct"), (F.col("l_tax") * 12).alias("concept"), ((quantity % 10) / 10).alias("problem"), ((part % 7) / 7).alias("industry"),
        R.strength(pick(levels, supp % 4), pick(tiers, supp % 4)).alias("strong"), pick(states, part % 6).alias("status"), pick(list(R.ATTRIBUTION), part % 5).alias("attribution"), (quantity % 3 != 0).alias("eligible"),
        (part % 11 == 0).alias("scope_conflict"), (part % 13 == 0).alias("overclaim"), (part % 5 == 0).alias("named_tool"), (supp % 9 == 0).alias("path_adjacent"), (supp % 6 == 5).alias("path_transferable"),
        (supp % 8 == 3).alias("has_path"), (part % 19 < 3).alias("embedding_only"), F.when(part % 4 == 1, 2.5).otherwise(0.0).alias("bm25"), (F.col("l_tax") * 2).alias("cosine"),
    )
    c = c.withColumn("score", R.preverification(*[F.col(x) for x in ("exact", "concept", "problem", "industry", "strong", "attribution", "status")]))
    out = c.withColumn("label", R.classify({x: F.col(x) for x in c.columns})).withColumn("recommended", R.recommended(F.col("label"), F.col("status")))
    return out.groupBy("label", "recommended").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


@REG.add(f"""
    WITH {_BM25}, s AS (SELECT item_id, doc_id, round(bm25, 6) AS bm25 FROM bm), l AS (SELECT doc_id, quality FROM labels)
    SELECT item_id, doc_id, bm25, coalesce(quality, 0) AS quality, row_number() OVER (PARTITION BY item_id ORDER BY bm25 * (1 + coalesce(quality, 0)) DESC, doc_id) AS place
    FROM s LEFT JOIN l USING (doc_id) QUALIFY place <= 8
""")
def cross_score_topk(spark, d):
    """Every item against every document with a common term, weighted by strength, top eight."""
    quality = table(spark, d, "labels").select("doc_id", (1 + F.coalesce("quality", F.lit(0))).alias("weight"))
    s = bm25_top(*_bm25_sides(spark, d), 8, weights=quality)
    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return s.select("item_id", "doc_id", "bm25", (F.col("score") / F.col("bm25") - 1).cast("int").alias("quality"), place.cast("bigint").alias("place"))


_WORDS = "[x for x in regexp_split_to_array(lower(text), '[^a-z0-9]+') if x <> '']"
_ALIASES = f"""
    w AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    al AS (SELECT DISTINCT substr(alias, 1, 2) AS concept, alias FROM (SELECT unnest([x for x in w if length(x) >= 8]) AS alias FROM w UNION ALL
           SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w) WHERE length(w[i]) >= 4 AND length(w[i + 1]) >= 4))
"""


@REG.add(f"""
    WITH {_ALIASES}, d AS (SELECT doc_id, {_NORM('text')} AS t FROM documents),
    o AS (SELECT string_agg(alias, '|' ORDER BY length(alias) DESC, alias) AS p FROM al WHERE concept = 'on'),
    x AS (SELECT doc_id, t, regexp_replace(t, p, ' ', 'g') AS rest FROM d, o),
    h AS (SELECT doc_id, concept, alias FROM x JOIN al ON contains(t, alias) WHERE regexp_matches(CASE WHEN concept = 'th' THEN rest ELSE t END, '(^|[^a-z0-9])' || alias || '($|[^a-z0-9])'))
    SELECT doc_id, concept, count(*) AS n_terms, min(alias) AS first_term FROM h GROUP BY 1, 2
""")
def concept_terms(spark, d):
    """The words and word pairs of `benchmark` as aliases, their first two letters as concepts, in whole documents; what a phrase of "on" takes up is no part of a term of "th"."""
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    w = table(spark, d, "benchmark").select(words.alias("w"))
    long = w.select(F.explode(F.filter("w", lambda x: F.length(x) >= 8)).alias("alias"))
    pairs = w.select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"))).alias("p")).where("length(p.a) >= 4 and length(p.b) >= 4").select(F.concat_ws(" ", "p.a", "p.b").alias("alias"))
    aliases = long.unionByName(pairs).select(F.substring("alias", 1, 2).alias("concept"), "alias").distinct()
    found = phrases.concepts_in(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", aliases, spark.createDataFrame([("on", "th")], "outer string, inner string"))
    return found.select("doc_id", "concept", F.size("terms").cast("long").alias("n_terms"), F.element_at("terms", 1).alias("first_term"))


QUERIES, ORACLES = REG.queries, REG.oracles
