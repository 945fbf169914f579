"""Nearest rows by cosine for a stated set of queries: blocks of the query matrix against Arrow batches of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERY_BLOCK = 16_384  # queries that tasks hold at once: a block of 384 doubles each is 50 MB
SCORES = 1 << 20  # scores that may be new candidates at once, all queries together


def unit_rows(column: pa.ListArray, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and unit vectors of the usable rows: those of the width, without null, non-finite or only zero components."""
    length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat, ends = column.flatten(), np.cumsum(length)
    holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    fits = (length > 0) & (holes[ends] == holes[ends - length]) & (length == (width if width is not None else length.max(initial=0)))
    at = np.flatnonzero(fits)
    if not len(at):
        return at, np.empty((0, width or 0))
    values = flat.cast(pa.float64()).fill_null(0.0).to_numpy()
    x = values[(ends[at] - length[at[0]])[:, None] + np.arange(length[at[0]])]
    norm = np.sqrt((x * x).sum(axis=1))
    ok = np.isfinite(norm) & (norm > 0)
    return at[ok], x[ok] / norm[ok, None]


def best_rows(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int, ties: bool) -> np.ndarray:
    """Indices of each query's k best rows (by score, then smaller id), with all ties of the last if wanted."""
    order = np.lexsort((row, -score, query))
    q = query[order]
    head = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, dtype=np.int64)
    begin = np.repeat(head, np.diff(np.append(head, len(q))))
    rank = np.arange(len(q)) - begin
    keep = rank < k
    if ties:
        size = np.repeat(np.diff(np.append(head, len(q))), np.diff(np.append(head, len(q))))
        keep |= score[order] == score[order][begin + np.minimum(k, size) - 1]
    return order[keep]


def _search(ids: np.ndarray, unit: np.ndarray, k: int, ties: bool, digits: int, others: bool):
    """The best rows of one partition for every query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, row, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        least = np.full(len(ids), -1.0)
        step = max(1, min(512, SCORES // max(1, len(ids))))
        for batch in batches:
            at, x = unit_rows(batch.column(1), unit.shape[1])
            names = batch.column(0).to_numpy()[at]
            for a in range(0, len(x), step):
                here = names[a : a + step]
                new = [(query, row, score)]
                for b in range(0, len(ids), 4096):
                    found = np.round(np.maximum(0.0, unit[b : b + 4096] @ x[a : a + step].T), digits)
                    if others:
                        found[ids[b : b + 4096, None] == here[None, :]] = -2.0
                    q, r = np.nonzero(found >= least[b : b + 4096, None])
                    new.append((q + b, here[r], found[q, r]))
                query, row, score = (np.concatenate(c) for c in zip(*new, strict=True))
                keep = best_rows(query, row, score, k, ties)
                query, row, score = query[keep], row[keep], score[keep]
                full = np.flatnonzero(np.bincount(query, minlength=len(ids)) >= k)
                low = np.full(len(ids), np.inf)
                np.minimum.at(low, query, score)
                least[full] = low[full]
        yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(row), pa.array(score)], names=["query", "row", "cosine"])

    return run


def nearest(
    queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, query_vector: str, row_vector: str, k: int, ties: bool = False, digits: int = 6, others: bool = False
) -> DataFrame:
    """query_id, row_id, cosine (clamped at 0, rounded) of each query's k nearest rows; ids are integers.

    The queries are held in blocks of QUERY_BLOCK, one after another; each partition keeps its own k best per
    query, so only these are shuffled. Vectors of another width than the queries', null or zero ones match
    nothing. `others` leaves out the row of the query's own id.
    """
    n = queries.count()
    out = None
    for b in range(max(1, -(-n // QUERY_BLOCK))):
        part = queries if n <= QUERY_BLOCK else queries.where(F.pmod(F.xxhash64(query_id), F.lit(-(-n // QUERY_BLOCK))) == b)
        held = part.select(F.col(query_id).cast("long").alias("q"), F.col(query_vector).alias("v")).toArrow().combine_chunks()
        at, unit = unit_rows(held.column(1).chunk(0)) if held.num_rows else (np.empty(0, np.int64), np.empty((0, 0)))
        ids = held.column(0).to_numpy()[at] if held.num_rows else np.empty(0, np.int64)
        found = rows.select(F.col(row_id).cast("long").alias("r"), row_vector).mapInArrow(_search(ids, unit, k, ties, digits, others), "query long, row long, cosine double")
        out = found if out is None else out.unionByName(found)
    order = W.partitionBy("query").orderBy(F.desc("cosine"), *([] if ties else ["row"]))
    place = (F.rank() if ties else F.row_number()).over(order)
    best = out.withColumn("__r", place).where(F.col("__r") <= k)
    return best.select(F.col("query").alias(query_id), F.col("row").alias(row_id), F.round("cosine", digits).alias("cosine"))
