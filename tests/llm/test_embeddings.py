import numpy as np
import pytest

from siltstone.llm.embeddings import PivotParams, near_vectors

SCHEMA = "vec_id long, embedding array<float>, rep long, sig string"


def brute(vectors, threshold=0.9):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= threshold
    np.fill_diagonal(link, False)
    root = np.arange(len(ids))
    while True:
        new = np.minimum(root, np.where(link, root[None, :], len(ids)).min(axis=1))
        if np.array_equal(new, root):
            break
        root = new
    return {i: (int(n), ids[r]) for i, n, r in zip(ids, link.sum(axis=1), root)}, link


def result(df, **kw):
    return {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df, **kw).collect()}


@pytest.mark.parametrize("params", [PivotParams(), PivotParams(block=32)])
def test_groups_and_copies_equal_brute_force(spark, params):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(700, 64))
    near = base[0] + rng.normal(size=(120, 64)) * 0.12
    few = base[1:41] + rng.normal(size=(40, 64)) * 0.2
    every = np.concatenate([base, near, few, np.repeat(base[5:6], 50, axis=0), base[6:7] * 3]).astype(np.float32)
    vectors = {i: v.tolist() for i, v in enumerate(every)}
    df = spark.createDataFrame([(i, v, 0, "") for i, v in vectors.items()], SCHEMA)
    want, _ = brute(vectors)
    assert result(df, params=params) == want


@pytest.mark.parametrize("params", [PivotParams(), PivotParams(pivots=(2048, 2048), block=64), PivotParams(pivots=(4096, 4096))])
def test_recall_at_the_threshold(spark, params):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(2400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    b = 0.905 * a + np.sqrt(1 - 0.905**2) * noise
    vectors = {i: v.tolist() for i, v in enumerate(np.concatenate([a, b]))}
    df = spark.createDataFrame([(i, v, 0, "") for i, v in vectors.items()], SCHEMA)
    got = sum(n for n, _ in result(df, params=params).values())
    want = sum(n for n, _ in brute(vectors)[0].values())
    assert want >= 4800 and got >= 0.95 * want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (10, [-1.0, -2.0])]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    alone = {i: (0, i) for i in (1, 2, 3, 4, 5, 6, 9, 10, None)}
    assert result(df) == {**alone, 7: (1, 7), 8: (1, 7)}
    assert {r.vec_id for r in near_vectors(df).where("not kept").collect()} == {8}
    assert near_vectors(df.limit(0)).count() == 0
