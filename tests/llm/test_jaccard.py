import random
import re

import pytest

from siltstone.graph import connected_components
from siltstone.llm.jaccard import JoinParams, keep_one, similar_documents


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(texts, threshold=0.8):
    """{id: (class, links)} by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    index, links = {}, {i: set() for i in sets}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in index[x]}:
            if i != j and len(s & sets[j]) >= threshold * len(s | sets[j]):
                links[i].add(j)
    root = {}
    for i in sorted(sets):
        if i not in root:
            stack = [i]
            while stack:
                k = stack.pop()
                if k not in root:
                    root[k] = i
                    stack += links[k]
    return {i: (root[i], len(links[i])) for i in sets}


def result(df, **kw):
    return {r.doc_id: (r.class_id, r.n_links) for r in similar_documents(df, **kw).collect()}


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute({r.doc_id: r.text for r in docs.collect()})
    got = result(docs)
    assert any(n for _, n in want.values()) and got == want


@pytest.mark.parametrize("params", [JoinParams(), JoinParams(leaf=8, block=16)])
def test_large_group_of_near_copies(spark, params):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[3][1]) for i in range(20)]
    rows += [(2000 + i, " ".join(base[:12] + [f"y{i}_{k}" for k in range(100)])) for i in range(90)]
    got = result(spark.createDataFrame(rows, "doc_id long, text string"), params=params)
    assert got == brute(dict(rows))


def test_odd_rows(spark):
    schema = "doc_id long, text string, rep long, sig string"
    rows = [(1, None, 0, ""), (2, "", 0, ""), (3, " \n", 0, ""), (4, "a b", 0, ""), (5, "a\tb", 0, ""), (5, "a\tb", 0, ""), (None, "a b", 0, ""), (7, "z " * 60_000, 0, ""), (8, "z " * 9, 0, "")]
    df = spark.createDataFrame(rows, schema)
    assert result(df) == {1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (4, 1), 5: (4, 1), None: (None, 0), 7: (7, 1), 8: (7, 1)}
    left = keep_one(df)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "4", "7", "None"]
    assert similar_documents(df.limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1001 + i) for i in range(300)]
    df = spark.createDataFrame([*chain, *hub, (5000, 5000)], "a long, b long").repartition(5)
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(301)}}


def test_recall_at_the_threshold(spark):
    rng = random.Random(5)
    rows, pairs = [], []
    for i in range(400):
        w = [f"p{i}_{k}" for k in range(200)]
        other = list(w)
        # Each word changed far from the others breaks five of 196 shingles.
        for k in rng.sample(range(5, 195, 8), rng.choice((3, 4))):
            other[k] = f"q{i}_{k}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            pairs.append(2 * i)
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(pairs) >= 100
    assert sum(got[i + 1] == (i, 1) for i in pairs) >= 0.95 * len(pairs)


def test_boilerplate_that_most_documents_share(spark):
    rng = random.Random(7)
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(base + [f"o{i}_{k}" for k in range(60 + i % 7)])) for i in range(500)]
    for i in range(0, 200, 5):
        w = rows[i][1].split()
        w[rng.randrange(101, 150)] = "z"
        rows.append((5000 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(dict(rows))
    assert sum(n for _, n in want.values()) == 80
    assert result(df) == want
    assert result(df, params=JoinParams(leaf=8, max_depth=2, block=128, broadcast_rows=0)) == want


def test_sketches_estimate_similarity():
    from siltstone.llm.jaccard import _sketches, estimates, sketch

    rng = __import__("numpy").random.default_rng(1)
    for n, share in ((1, 1.0), (3, 1.0), (40, 0.5), (400, 0.8), (20_000, 0.8)):
        common = int(round(2 * n * share / (1 + share)))
        values = rng.integers(0, 2**63, 2 * n).astype("uint64")
        a, b = values[:n], values[n - common : 2 * n - common]
        got = float(estimates(_sketches([sketch(a)]), _sketches([sketch(b)]))[0, 0])
        assert abs(got - len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))) < 0.13
