"""Centroid clustering against plain Python integers."""

import hashlib
import math
import random
from pathlib import Path

import numpy as np
import pytest

from siltstone.llm.centroids import CentroidParams, block_sums, cluster_vectors, nearest, scaled
from siltstone.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, dim, k, rounds, salt="3"):
    def whole(x):
        return math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024

    kept = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in seeds]
    if not c:
        return []

    def judge(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(judge(v)[1], []).append(v)
        for j, vs in groups.items():
            c[j] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *judge(v)) for i, v in kept]
    by = [sum(d for _, d, j in found if j == n) for n in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    cap = 2**63 - 1
    return [(i, j, min(d, cap), min(by[j], cap), min(sum(by), cap), sha[j]) for i, d, j in found]


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_odd_rows(spark):
    rng = random.Random(5)
    dim = 4
    rows = [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(60)]
    rows += [(3, [0.5] * dim), (3, [0.5] * dim), (3, [0.25] * dim), (None, [0.1] * dim), (100, None), (101, []), (102, [1.0] * (dim + 1))]
    rows += [(103, [float("nan")] * dim), (104, [math.inf, 0.0, 0.0, 0.0]), (105, [None, 0.0, 0.0, 0.0]), (106, [0.0] * dim), (107, [1e-320, -1e-320, 0.0, -0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5)
    p = CentroidParams(dim=dim, clusters=3, block=7)
    assert order(cluster_vectors(df, params=p).collect()) == order(brute(rows, dim, 3, 10))


def test_magnitudes_beyond_float_and_long(spark):
    rng = random.Random(6)
    dim = 4
    rows = [(i, [rng.choice([1.0, 3e4, 2e8, 1e12, 1e200, 1.7e308]) * rng.uniform(-1, 1) for _ in range(dim)]) for i in range(40)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    p = CentroidParams(dim=dim, clusters=4, rounds=3, block=9)
    assert order(cluster_vectors(df, params=p).collect()) == order(brute(rows, dim, 4, 3))


@pytest.mark.parametrize("size", [1.0, 2.0**11, 2.0**13, 2.0**18, 2.0**40])
def test_each_arithmetic_gives_the_same(size):
    rng = np.random.default_rng(int(size))
    p = CentroidParams(dim=8)
    x = scaled((rng.normal(size=(50, 8)) * size).tobytes(), 50, p)
    c = np.array([[int(v) for v in row] for row in x[:3]], dtype=object)
    cluster, distance = nearest(x, c)
    for row, j, d in zip(x, cluster, distance):
        want = [sum((int(a) - b) ** 2 for a, b in zip(row, m)) for m in c]
        assert (want.index(min(want)), min(want)) == (j, int(d))
    sums = block_sums(x, c)
    assert [sum(int(x[i, 0]) for i in range(50) if cluster[i] == j) for j in range(3)] == list(sums.total[:, 0])


def test_ties_and_empty_clusters(spark):
    rows = [(i, [1.0, 1.0]) for i in range(20)] + [(50, [2.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    p = CentroidParams(dim=2, clusters=4)
    assert order(cluster_vectors(df, params=p).collect()) == order(brute(rows, 2, 4, 10))


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 9, 9, 9)], "vec_id long, embedding array<double>, cluster int, v int, ids int")
    got = cluster_vectors(df, params=CentroidParams(dim=2)).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in got] == [(1, 0, 0, 0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert cluster_vectors(empty).columns == cluster_vectors(df, params=CentroidParams(dim=2)).columns and cluster_vectors(empty).count() == 0
    assert cluster_vectors(df.selectExpr("cast(null as long) vec_id", "embedding"), params=CentroidParams(dim=2)).count() == 0


def test_whole_table(spark):
    at = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(str(Path(at) / "embeddings.parquet")).collect()]
    assert order(QUERIES["op13_centroid_clustering"](spark, at).collect()) == order(brute(rows, 64, 8, 10))
