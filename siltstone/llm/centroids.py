"""Centroid clustering in exact integers (Lloyd rounds), with distances from matrix products.

Vectors lie in blocks of raw components, one row per block. In a task, a block's distances to all
centroids come from |x|^2 - 2 x.c + |c|^2 as one float64 matrix product. Every product and every partial
sum is an integer, so the result is exact as long as it stays below 2^53: rows whose bound passes that
are computed in 64-bit integers, and beyond 2^63 in Python's. Sums per cluster are Python integers too,
combined by RDD.treeAggregate, so a round sends one small partial result per branch of the tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.store import Table

LARGEST = 2**63 - 1


@dataclass(frozen=True)
class CentroidParams:
    dim: int = 64
    clusters: int = 8
    rounds: int = 10
    scale: int = 1024
    salt: str = "3"  # seeds are the vectors with the smallest sha256 of "<salt>:<vec_id>"
    block: int = 4096  # vectors in a block
    depth: int = 2  # of the tree that combines the sums


def _blocks(p: CentroidParams):
    """Vectors without null and non-finite components as (ids, x): x holds the raw components, as the column has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, p.dim)  # nulls turn into NaN
            ok = np.isfinite(x).all(axis=1)
            if ok.any():
                ids = pa.ListArray.from_arrays(pa.array([0, int(ok.sum())], pa.int32()), batch.column(0).filter(pa.array(ok)))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x[ok].tobytes()], pa.binary())], names=["ids", "x"])

    return run


def scaled(raw: bytes, rows: int, p: CentroidParams) -> np.ndarray:
    """floor(scale * x) of a block: whole float64 numbers, or Python integers where a product leaves float64."""
    x = np.frombuffer(raw, dtype="<f4" if len(raw) == 4 * rows * p.dim else "<f8").astype(np.float64).reshape(rows, p.dim)
    with np.errstate(over="ignore"):
        y = np.floor(p.scale * x)
    if np.isfinite(y).all():
        return y
    huge = ~np.isfinite(y)
    out = np.array([[0 if h else int(v) for v, h in zip(a, b)] for a, b in zip(y, huge)], dtype=object)
    out[huge] = [int(v) * p.scale for v in x[huge]]  # so large a component is whole already
    return out


def _integers(a: np.ndarray) -> np.ndarray:
    return a if a.dtype == object else np.array([[int(v) for v in row] for row in a], dtype=object).reshape(a.shape)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each row (the smaller of equals) and the exact squared distance.

    centroids: Python integers. x: whole float64 numbers or Python integers. Distances that pass a 64-bit integer
    come back as Python integers, in an array of objects.
    """
    dim = x.shape[1]
    # No product and no partial sum of the expansion passes dim * (|x| + |c|)^2.
    most, top = np.abs(x).max(axis=1), max(abs(v) for v in centroids.ravel())
    if most.dtype == object or max(top, most.max()) > 2**400:
        bound = np.array([dim * (int(m) + top) ** 2 for m in most], dtype=object)
    else:
        bound = dim * (most + float(top)) ** 2
    exact, long = bound < 2**53, bound < 2**62
    cluster, distance = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    if exact.any():
        c = centroids.astype(np.float64)
        rows = x[exact].astype(np.float64)
        d = (rows * rows).sum(axis=1)[:, None] - 2.0 * (rows @ c.T) + (c * c).sum(axis=1)[None, :]
        cluster[exact] = d.argmin(axis=1)
        distance[exact] = d.min(axis=1).astype(np.int64)
    middle = long & ~exact
    if middle.any():
        c, rows = centroids.astype(np.int64), x[middle].astype(np.int64)
        d = np.stack([((rows - k) ** 2).sum(axis=1) for k in c], axis=1)
        cluster[middle], distance[middle] = d.argmin(axis=1), d.min(axis=1)
    if not long.all():
        far = np.flatnonzero(~long)
        distance = distance.astype(object)
        for i, row in zip(far.tolist(), _integers(x[far])):
            d = [sum((a - b) ** 2 for a, b in zip(row, k)) for k in centroids]
            cluster[i], distance[i] = d.index(min(d)), min(d)
    return cluster, distance


class Sums:
    """Of each cluster: the componentwise sum, the number of vectors and the sum of distances, as Python integers."""

    def __init__(self, k: int, dim: int):
        self.total, self.count, self.distance = np.zeros((k, dim), dtype=object), np.zeros(k, dtype=object), np.zeros(k, dtype=object)

    def plus(self, other: Sums) -> Sums:
        out = Sums(*self.total.shape)
        out.total, out.count, out.distance = self.total + other.total, self.count + other.count, self.distance + other.distance
        return out


def block_sums(x: np.ndarray, centroids: np.ndarray) -> Sums:
    cluster, distance = nearest(x, centroids)
    out = Sums(*centroids.shape)
    safe = x.dtype != object and len(x) * np.abs(x).max() < 2**53  # then float64 adds exactly
    for k in np.unique(cluster).tolist():
        mine = cluster == k
        rows = x[mine]
        out.total[k] = np.array([int(v) for v in rows.sum(axis=0)], dtype=object) if safe else _integers(rows).sum(axis=0)
        out.count[k] = int(mine.sum())
        out.distance[k] = sum(int(v) for v in distance[mine].tolist())
    return out


def _pass(blocks: DataFrame, centroids: np.ndarray, p: CentroidParams) -> Sums:
    """One pass over all blocks against given centroids."""
    add = lambda acc, row: acc.plus(block_sums(scaled(bytes(row[1]), row[0], p), centroids))
    return blocks.select(F.size("ids"), "x").rdd.treeAggregate(Sums(*centroids.shape), add, lambda a, b: a.plus(b), depth=p.depth)


def _seeds(vectors: DataFrame, p: CentroidParams) -> np.ndarray:
    """The first centroids: the vectors of the smallest hashes, in order of the hash (of equal ids, in order of the components)."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    h = F.sha2(F.concat(F.lit(f"{p.salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.where(finite & F.col("vec_id").isNotNull()).select(h.alias("h"), "v").orderBy("h", "v").limit(p.clusters).collect()
    first = [scaled(np.array(r["v"], dtype=np.float64).tobytes(), 1, p)[0] for r in rows]
    return np.array([[int(v) for v in row] for row in first], dtype=object).reshape(len(rows), p.dim)


def _label(centroids: np.ndarray, last: Sums, p: CentroidParams):
    long = lambda v: int(min(v, LARGEST))
    digest = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    inertia, everything = [long(v) for v in last.distance], long(sum(last.distance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw in zip(batch.column(0), batch.column(1).to_pylist()):
                n = len(ids)
                cluster, distance = nearest(scaled(raw, n, p), centroids)
                columns = [
                    ids.values,
                    pa.array(cluster.astype(np.int32)),
                    pa.array([long(v) for v in distance.tolist()], pa.int64()),
                    pa.array(np.array(inertia)[cluster], pa.int64()),
                    pa.array(np.full(n, everything), pa.int64()),
                    pa.array(np.array(digest, dtype=object)[cluster], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return run


def cluster_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", params: CentroidParams = CentroidParams()) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, after `rounds` rounds and a last assignment.

    Kept are vectors of exactly `dim` components, none null or non-finite; all others, null and empty ones included, give
    no row and take no part. Each row is a vector of its own: repeated rows and rows of one id all count, and the first
    centroids come from rows of the smallest hashes, of equal ids in order of their components. A null id gives a row but is never a
    first centroid. With fewer vectors than `clusters` there are as many clusters as vectors with an id; with none, or an empty
    table, there are no rows. Ties go to the smaller number; an empty cluster keeps its centroid. Sums and distances
    are exact at any magnitude; what passes a 64-bit integer is given as the largest one. Other columns are not read.
    """
    p = params
    kind = dict(df.dtypes)[embedding]
    v = F.col(f"`{embedding}`") if kind == "array<float>" else F.col(f"`{embedding}`").cast("array<double>")
    vectors = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v")).where(F.size("v") == p.dim)
    centroids = _seeds(vectors, p)
    if not len(centroids):
        return df.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    blocks = Table(vectors.mapInArrow(_blocks(p), "ids array<long>, x binary"), "vector-blocks", batch_rows=p.block).df
    for _ in range(p.rounds):
        sums = _pass(blocks, centroids, p)
        moved = [[t // int(n) for t in total] if n else list(c) for total, n, c in zip(sums.total, sums.count, centroids)]
        centroids = np.array(moved, dtype=object).reshape(centroids.shape)
    last = _pass(blocks, centroids, p)
    return blocks.mapInArrow(_label(centroids, last, p), "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
