"""The best documents of each query by BM25 (R10, W5, J15), with upper bounds instead of all pairs.

A document becomes the counts of the queries' terms in it. Tasks hold the queries' weights and take documents in
blocks: the largest impact of each term in a block bounds every score there, so a query whose bound stays below
its k-th best document so far skips the whole block. A partition hands on its own best documents of each query only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.names import column
from siltstone.operators.nearest import best_rows
from siltstone.operators.retrieval import B, K1
from siltstone.store import Table

QUERY_BLOCK = 20_000  # queries that tasks hold at once; further ones take another pass
DOC_BLOCK, QUERIES_AT_ONCE = 256, 1024


def _count(shared):
    """(id, weight, tokens) to (id, weight, length, terms, counts): numbers of the known terms (32 bits) and how often they stand there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks = batch.column(2)
            size = toks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            code = pc.index_in(toks.flatten(), value_set=shared.value).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(size)), size)[code >= 0]
            key, count = np.unique(owner * max(1, len(shared.value)) + code[code >= 0], return_counts=True)
            row, term = np.divmod(key, max(1, len(shared.value)))
            ends = np.searchsorted(row, np.arange(len(size) + 1))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), lists(term), lists(count)], names=["id", "weight", "length", "terms", "counts"])

    return run


def _document_frequencies(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n, dtype=np.int64)
        for batch in batches:
            seen += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], names=["term", "n"])

    return run


class QueryWeights:
    """For each query its terms with idf times their count in it, as columns of term-by-query blocks."""

    def __init__(self, ids: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray, average: float):
        self.ids, self.average, self.n_terms = ids, average, len(idf)
        self.term = np.concatenate(terms) if terms else np.empty(0, np.int64)
        self.query = np.repeat(np.arange(len(ids)), [len(t) for t in terms])
        self.weight = (np.concatenate(counts) if counts else np.empty(0)) * idf[self.term]
        self.start = np.searchsorted(self.query, np.arange(0, len(ids) + QUERIES_AT_ONCE, QUERIES_AT_ONCE))

    def among(self, place: np.ndarray, a: int) -> np.ndarray:
        """The weights of the queries from `a` on as a dense matrix over the terms of a block; `place` maps terms to its rows, -1 elsewhere."""
        b = slice(self.start[a // QUERIES_AT_ONCE], self.start[a // QUERIES_AT_ONCE + 1])
        at, q, w = place[self.term[b]], self.query[b] - a, self.weight[b]
        out = np.zeros((int(place.max()) + 1, min(QUERIES_AT_ONCE, len(self.ids) - a)))
        out[at[at >= 0], q[at >= 0]] = w[at >= 0]
        return out


def _search(shared, k: int, ties: bool, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: QueryWeights = shared.value
        n = len(held.ids)
        query, row, score, plain = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)
        least = np.zeros(n)
        for whole in batches:
            for at in range(0, whole.num_rows, DOC_BLOCK):
                batch = whole.slice(at, DOC_BLOCK)
                ids, boost = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                length, lists = batch.column(2).to_numpy().astype(np.float64), batch.column(3)
                term, tf = lists.flatten().to_numpy(), batch.column(4).flatten().to_numpy().astype(np.float64)
                if not len(term):
                    continue
                doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
                known = np.unique(term)
                place = np.full(held.n_terms, -1)
                place[known] = np.arange(len(known))
                impact = np.zeros((len(ids), len(known)))
                impact[doc, place[term]] = boost[doc] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(1.0, held.average)))
                most = impact.max(axis=0)
                new = []
                for a in range(0, n, QUERIES_AT_ONCE):
                    weights = held.among(place, a)
                    bound = most @ weights
                    alive = np.flatnonzero((bound > 0) & (bound >= least[a : a + QUERIES_AT_ONCE] - 10.0**-digits))
                    if not len(alive):
                        continue
                    exact = impact @ weights[:, alive]
                    found = np.round(exact / boost[:, None], digits) * boost[:, None]
                    d, q = np.nonzero((exact > 0) & (found >= least[a + alive]))
                    new.append((alive[q] + a, ids[d], found[d, q], np.round(exact[d, q] / boost[d], digits)))
                if new:
                    query, row, score, plain = (np.concatenate([old, *more]) for old, more in zip((query, row, score, plain), zip(*new)))
                    keep = best_rows(query, row, score, k, ties)
                    query, row, score, plain = query[keep], row[keep], score[keep], plain[keep]
                    low = np.full(n, np.inf)
                    np.minimum.at(low, query, score)
                    full = np.bincount(query, minlength=n) >= k
                    least[full] = low[full]
        yield pa.RecordBatch.from_arrays([pa.array(held.ids[query]), pa.array(row), pa.array(plain), pa.array(score)], names=["query", "row", "bm25", "score"])

    return run


def bm25_top(
    queries: DataFrame, query_id: str, toks: str, docs: DataFrame, doc_id: str, doc_toks: str, k: int, ties: bool = False, digits: int = 6, weights: DataFrame | None = None
) -> DataFrame:
    """query_id, doc_id, bm25 (rounded), score (bm25 times the document's weight, 1 without one) of each query's k best documents, with all ties of the last if wanted.

    Ids are integers. Statistics cover all documents, those without a known term too. Repeated query terms count repeatedly; a
    pair without a common term is no result; of equal scores the smaller id goes first. weights: doc_id (unique), weight (positive), joined to the
    counted documents, not to their texts. Queries go through the tasks in blocks of QUERY_BLOCK, each with its own pass and its own table.
    """
    spark = docs.sparkSession
    n = queries.count()
    groups = max(1, -(-n // QUERY_BLOCK))
    best = None
    for g in range(groups):
        part = queries if groups == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(groups)) == g)
        rows = part.select(column(query_id).cast("long").alias("q"), column(toks).alias("t")).collect()  # a block of queries
        names = sorted({t for r in rows for t in r["t"] or ()})
        number = {t: i for i, t in enumerate(names)}
        vocabulary = spark.sparkContext.broadcast(pa.array(names, pa.string()))
        lean = docs.select(column(doc_id).cast("long").alias("id"), F.lit(1.0).alias("weight"), column(doc_toks).alias("tokens"))
        counted = Table(lean.mapInArrow(_count(vocabulary), "id long, weight double, length long, terms array<int>, counts array<int>"), "term-counts")
        stats = counted.df.agg(F.count("*").alias("n"), F.avg("length").alias("average")).first()
        df = np.zeros(len(names))
        for r in counted.df.select("terms").mapInArrow(_document_frequencies(len(names)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            df[r["term"]] = r["n"]  # a row per term of the block's queries
        idf = np.log(1 + (stats["n"] - df + 0.5) / (df + 0.5))
        pairs = [np.unique(np.array([number[t] for t in r["t"] or ()], dtype=np.int64), return_counts=True) for r in rows]
        held = QueryWeights(np.array([r["q"] for r in rows], dtype=np.int64), [t for t, _ in pairs], [c for _, c in pairs], idf, stats["average"] or 0.0)
        some = counted.df.where(F.size("terms") > 0)
        if weights is not None:
            some = some.drop("weight").join(weights.select(column(doc_id).cast("long").alias("of"), F.col("weight").cast("double").alias("weight")), F.col("id") == F.col("of"), "left")
            some = some.select("id", F.coalesce("weight", F.lit(1.0)).alias("weight"), "length", "terms", "counts")
        shared = spark.sparkContext.broadcast(held)
        found = Table(some.mapInArrow(_search(shared, k, ties, digits), "query long, row long, bm25 double, score double"), "best-documents")
        counted.drop()
        shared.unpersist()
        best = found.df if best is None else best.unionByName(found.df)
    order = W.partitionBy("query").orderBy(F.desc("score"), *([] if ties else ["row"]))
    place = (F.rank() if ties else F.row_number()).over(order)
    return best.withColumn("place", place).where(F.col("place") <= k).select(F.col("query").alias(query_id), F.col("row").alias(doc_id), "bm25", "score")
