"""Lexical, hashed-vector and graph retrieval with a graded verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import once
from siltstone.operators.joins import small
from siltstone.store import Table

# Words that carry no evidence.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "of", "on", "or", "that", "the", "to", "use", "using", "with",
    "ability", "candidate", "experience", "preferred", "required", "responsibilities", "responsibility", "skills", "work",
)
DIMENSIONS = 384
K1, B = 1.5, 0.75


def normalized(c: Column) -> Column:
    """R1 without compatibility forms: lower case, dashes, underscores and slashes as spaces, squeezed."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[–—_/]+", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """R2: substring for CJK phrases, else the phrase between ASCII word ends. Empty phrases are nowhere."""
    t, p = normalized(text), normalized(phrase)
    # Both sides as runs between word ends: a phrase is there if one occurrence has no letter or digit beside it.
    escaped = F.regexp_replace(p, r"([\\.*+?^${}()|\[\]])", r"\\$1")
    pattern = F.concat(F.lit("(^|[^a-z0-9])"), escaped, F.lit("($|[^a-z0-9])"))
    return (p != "") & F.when(p.rlike(r"[\x{3400}-\x{9fff}]"), t.contains(p)).otherwise(F.rlike(t, pattern))


def phrase_form(c: Column) -> Column:
    """A text as contains_phrase compares it: normalized; whether it has CJK; and with a mark at each end and on both sides of all but letters and digits."""
    mark = "\u0001"
    form = lambda t: F.struct(t.alias("text"), t.rlike(r"[\x{3400}-\x{9fff}]").alias("cjk"), F.concat(F.lit(mark), F.regexp_replace(t, "[^a-z0-9]", f"{mark}$0{mark}"), F.lit(mark)).alias("marked"))
    return once(normalized(c), form)


def form_contains(text: Column, phrase: Column) -> Column:
    """R2 on phrase_form: a phrase between word ends is there with its marks, so no pattern is made of it."""
    return (phrase["text"] != "") & F.when(phrase["cjk"], text["text"].contains(phrase["text"])).otherwise(text["marked"].contains(phrase["marked"]))


def _stem(x: Column) -> Column:
    cut = lambda n: F.substring(x, F.lit(1), F.length(x) - n)
    return (
        F.when(x.startswith("collaborat"), F.lit("collaborat"))
        .when((F.length(x) > 5) & x.endswith("ing"), cut(3))
        .when((F.length(x) > 4) & x.endswith("ed"), cut(2))
        .when((F.length(x) > 4) & x.endswith("s"), cut(1))
        .otherwise(x)
    )


def tokens(c: Column) -> Column:
    """Stemmed ASCII words without stop words, then single CJK characters or their bigrams."""
    t = normalized(c)
    words = F.filter(F.regexp_extract_all(t, F.lit(r"[a-z0-9][a-z0-9+#.-]*"), 0), lambda x: ~x.isin(*STOP_WORDS))
    blocks = F.regexp_extract_all(t, F.lit(r"[\x{3400}-\x{9fff}]+"), 0)
    pairs = lambda b: F.when(F.length(b) == 1, F.array(b)).otherwise(F.transform(F.sequence(F.lit(1), F.length(b) - 1), lambda i: F.substring(b, i, F.lit(2))))
    return F.concat(F.transform(words, _stem), F.flatten(F.transform(blocks, pairs)))


def ochiai(a: Column, b: Column) -> Column:
    """|A and B| / sqrt(|A||B|) of two arrays as sets; 0 if one is empty."""
    similar = lambda x, y: F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.sqrt(F.size(x) * F.size(y))).otherwise(0.0)
    return once(F.struct(F.array_distinct(a).alias("x"), F.array_distinct(b).alias("y")), lambda s: similar(s["x"], s["y"]))


def bm25_index(docs: DataFrame, doc_id: str, toks: str, vocabulary: DataFrame, term: str = "term") -> DataFrame:
    """doc_id, term, tf, dl, df, n_docs, avgdl for the terms of `vocabulary`. Statistics cover all documents.

    The vocabulary is joined before anything is shuffled, and all other words of a document become one count,
    so a document takes at most as many rows as it has known terms, and one. These counts are a table, which
    the lengths, the document frequencies and the result read.
    """
    known = small(vocabulary.select(F.col(term).alias("term")).distinct())
    words = docs.select(doc_id, F.explode_outer(toks).alias("__w"))
    counts = Table(words.join(known, F.col("__w") == F.col("term"), "left").groupBy(doc_id, "term").agg(F.count("__w").alias("tf")), "term-counts").df
    sized = counts.withColumn("dl", F.sum("tf").over(W.partitionBy(doc_id)))
    lengths = counts.groupBy(doc_id).agg(F.sum("tf").alias("dl"))
    stats = lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    tf = sized.where("term is not null")
    df = counts.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    return tf.join(df, "term").crossJoin(F.broadcast(stats))  # a single row


def bm25(queries: DataFrame, query_id: str, toks: str, docs: DataFrame, doc_id: str, doc_toks: str) -> DataFrame:
    """A term join, then one sum per (query, document). Repeated query terms count repeatedly."""
    q = queries.select(query_id, F.explode(toks).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("qf"))
    index = bm25_index(docs, doc_id, doc_toks, q)
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qf") * idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest(F.lit(1.0), F.col("avgdl"))))
    return small(q).join(index, "term").groupBy(query_id, doc_id).agg(F.sum(part).alias("bm25"))


def similar_sets(a: DataFrame, b: DataFrame, a_id: str, b_id: str, toks: str, at_least: float) -> DataFrame:
    """R4 as a join: a_id, b_id, similarity (Ochiai) of the pairs that reach `at_least`, which is above 0.

    Of two sets that reach it the smaller has at least the square of it times the larger's size, so sets far
    too large are left out before they are spread, and pairs too unequal before they are counted.
    """
    ratio = at_least * at_least
    # The explode of one array keeps the filters behind it, so that the words of a row are made once.
    one = lambda df, key: df.select(key, F.explode(F.array(F.array_distinct(toks))).alias("__t"))
    sized = lambda df, key, n: one(df, key).select(key, F.size("__t").alias(n), "__t").where(F.col(n) > 0)
    left, right = sized(a, a_id, "na"), sized(b, b_id, "nb")
    span = F.broadcast(left.agg(F.min("na").alias("__low"), F.max("na").alias("__high")))  # a single row
    right = right.join(span, (F.col("nb") >= F.col("__low") * ratio) & (F.col("nb") <= F.col("__high") / ratio)).drop("__low", "__high")
    x = small(left.select(a_id, "na", F.explode("__t").alias("__w")))
    y = right.select(b_id, "nb", F.explode("__t").alias("__w"))
    near = (F.col("na") >= F.col("nb") * ratio) & (F.col("nb") >= F.col("na") * ratio)
    k = y.join(x, "__w").where(near).groupBy(a_id, b_id, "na", "nb").agg(F.count("*").alias("k"))
    similarity = F.col("k") / F.sqrt(F.col("na") * F.col("nb"))
    return k.where(similarity >= at_least).select(a_id, b_id, similarity.alias("similarity"))


_FNV_START, _FNV_PRIME, _LOW32 = np.uint64(2166136261), np.uint64(16777619), np.uint64(0xFFFFFFFF)


def _fnv(points: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """FNV-1a of runs of code points, all runs one place at a time."""
    h = np.full(len(start), _FNV_START)
    for k in range(int(length.max(initial=0))):
        on = np.flatnonzero(length > k)
        h[on] = ((h[on] ^ points[start[on] + k]) * _FNV_PRIME) & _LOW32
    return h


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one behind the other, and the length of each."""
    joined = "".join(texts.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").astype(np.uint64), pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def _hash_features(dimensions: int, at_once: int = 1 << 20):
    def signed(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
        place = row * dimensions + (h % np.uint64(dimensions)).astype(np.int64)
        return np.bincount(place, weights=1.0 - 2.0 * (h & np.uint64(1)), minlength=rows * dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 32):
                batch = whole.slice(a, 32)
                n = batch.num_rows
                points, length = _points(batch.column(1))
                row = np.repeat(np.arange(n), length)
                out = np.zeros(n * dimensions)
                for i in range(0, len(points), at_once):
                    first = np.arange(i, min(i + at_once, len(points) - 2))
                    first = first[row[first] == row[first + 2]] if len(first) else first
                    out += signed(row[first], _fnv(points, first, np.full(len(first), 3)), n)
                toks = batch.column(2)
                word, size = _points(toks.flatten())
                owner = np.repeat(np.arange(n), toks.value_lengths().to_numpy(zero_copy_only=False))
                start = np.cumsum(size) - size
                for i in range(0, len(size), at_once):
                    out += signed(owner[i : i + at_once], _fnv(word, start[i : i + at_once], size[i : i + at_once]), n)
                vectors = pa.FixedSizeListArray.from_arrays(pa.array(out), dimensions).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=["id", "vector"])

    return run


def hashed_vectors(docs: DataFrame, doc_id: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id (an integer), vector. Tokens and character trigrams of a whole text, hashed into signed buckets; the hash's low bit is the sign.

    A document's features stay within its row: nothing is shuffled. Vectors are not yet of unit length.
    """
    lean = docs.select(F.col(doc_id).cast("long").alias("id"), normalized(F.col(text)).alias("__s"), tokens(F.col(text)).alias("__t"))
    return lean.mapInArrow(_hash_features(dimensions), "id long, vector array<double>").withColumnRenamed("id", doc_id)


def two_hops(starts: DataFrame, edges: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Best path of at most two undirected hops from each query's start nodes to each fact.

    starts: query_id, node. edges: src, dst, type, weight, evidence (array of fact ids). A path's score is the
    product of its weights (0.01 at least, 0.4 if missing or 0); a path is tainted by an adjacent_concept edge,
    and a tainted path takes no transferable_industry_interpretation edge. Ties keep the shorter path.
    """
    weight = F.greatest(F.lit(0.01), F.coalesce(F.nullif("weight", F.lit(0.0)), F.lit(0.4)))
    one = edges.select("src", "dst", "type", weight.alias("weight"), "evidence")
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight", "evidence"))
    adjacent = F.col("type") == "adjacent_concept"
    moves = F.col("type").isin("functional_equivalent", "transferable_industry_interpretation")
    first = starts.join(both, starts.node == both.src).select(query_id, F.array("src", "dst").alias("nodes"), "dst", F.col("weight").alias("score"), adjacent.alias("adjacent"), moves.alias("transferable"), "evidence")
    from_here = first.select(query_id, "nodes", F.col("dst").alias("at"), "score", "adjacent", "transferable")
    second = from_here.join(both, F.col("at") == F.col("src")).where(~(F.col("adjacent") & (F.col("type") == "transferable_industry_interpretation")))
    second = second.select(query_id, F.concat("nodes", F.array("dst")).alias("nodes"), "dst", (F.col("score") * F.col("weight")).alias("score"), (F.col("adjacent") | adjacent).alias("adjacent"), (F.col("transferable") | moves).alias("transferable"), "evidence")
    paths = first.unionByName(second).withColumn("fact_id", F.explode("evidence"))
    order = W.partitionBy(query_id, "fact_id").orderBy(F.desc("score"), F.size("nodes"), "nodes")
    return paths.withColumn("__r", F.row_number().over(order)).where("__r = 1").select(query_id, "fact_id", "nodes", "score", "adjacent", "transferable")


def _lookup(c: Column, table: dict[str, float], default: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(default))


# Weights of attribution and status.
ATTRIBUTION = {"explicit_primary_evidence": 1.0, "authorship_plus_project_evidence": 0.9, "user_confirmed_plus_project_evidence": 0.85, "user_confirmed": 0.7, "project_level_only": 0.15}
STATUS = {"completed": 1.0, "implemented": 1.0, "reported_result": 1.0, "in_progress": 0.45, "planned": 0.25, "project_context": 0.2}


def strength(level: Column, tier: Column) -> Column:
    """R15."""
    return F.when((level == "high") & (tier == "primary"), 1.0).when(level == "high", 0.9).when(level == "medium", 0.6).otherwise(0.3)


def preverification(exact: Column, concept: Column, problem: Column, industry: Column, strong: Column, attribution: Column, status: Column) -> Column:
    """The blend 24/16/22/12/10/10/6, at most 100. attribution and status are labels."""
    one = lambda c: F.least(F.lit(1.0), c)
    total = 24 * one(exact) + 16 * one(concept) + 22 * one(problem) + 12 * one(industry) + 10 * strong + 10 * _lookup(attribution, ATTRIBUTION, 0.2) + 6 * _lookup(status, STATUS, 0.3)
    return F.least(F.lit(100.0), total)


def classify(c: dict[str, Column]) -> Column:
    """A graded class, then demotions; a later rule overrides an earlier one.

    Keys: exact, direct, named_tool, eligible, scope_conflict, overclaim, score, problem, industry, bm25, cosine,
    has_path, path_adjacent, path_transferable, embedding_only, status.
    """
    overlap = F.when(c["named_tool"], c["exact"]).otherwise(F.greatest(c["exact"], c["direct"]))
    barred = c["scope_conflict"] | c["overclaim"]
    strong = (c["score"] >= 42) & ((c["problem"] >= 0.34) | (c["industry"] >= 0.42) | c["path_transferable"])
    near = (c["score"] >= 16) | c["has_path"] | (c["bm25"] > 0) | (c["cosine"] > 0.12)
    base = F.when(c["eligible"] & (overlap >= 0.78) & ~barred, "Direct").when(c["eligible"] & strong, "Strong Transferable").when(near, "Adjacent").otherwise("No Evidence")
    base = F.when(~c["eligible"] | (c["status"] == "project_context"), "No Evidence").otherwise(base)
    base = F.when(c["path_adjacent"] & (c["exact"] < 0.78), "Adjacent").otherwise(base)
    base = F.when(c["embedding_only"] & base.isin("Direct", "Strong Transferable"), "Adjacent").otherwise(base)
    return F.when(c["named_tool"] & (c["exact"] < 0.78), "No Evidence").otherwise(base)


def recommended(label: Column, status: Column) -> Column:
    open_ended = status.isin("planned", "in_progress")
    return F.when(label == "Direct", F.when(open_ended, "conditional").otherwise("yes")).when(label == "Strong Transferable", "conditional").otherwise("no")
