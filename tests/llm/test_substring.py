import hashlib
import re

import numpy as np
import pytest

from siltstone.llm.substring import SubstringParams, common_prefixes, deep_nodes, dedup_substrings, substring_digest
from siltstone.llm.words import hash_words


def brute(rows, w=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    low = {}
    for (i, _), x in zip(rows, words):
        if i is not None:
            for k in range(len(x) - w + 1):
                g = tuple(x[k : k + w])
                low[g] = min(low.get(g, i), i)
    out = []
    for (i, _), x in zip(rows, words):
        gone = [False] * len(x)
        if i is not None:
            for k in range(len(x) - w + 1):
                if low[tuple(x[k : k + w])] < i:
                    gone[k : k + w] = [True] * w
        kept = " ".join(a for a, g in zip(x, gone) if not g)
        out.append((-1 if i is None else i, len(x), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_digest(df).collect())


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(x[2] for x in want) > 1000
    assert got(docs) == want


def test_odd_rows(spark):
    line = "a b c d e f g h i j k l m n o p"
    rows = [
        (9, line), (3, "x " + line.replace(" ", "\t") + " y"), (4, line), (4, line), (4, "q " + line), (5, None), (6, ""), (7, " \n"),
        (None, line), (8, "a b c d e f g h i j k l"), (10, "a b c d e f g h i j k l"), (11, "w " * 40_000), (12, "w " * 30),
        (13, "é ü " * 14), (14, "é ü " * 13), (2, "z " + " ".join("0123456789") + " " + " ".join("abcdefg")),
    ]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, copy string, anchor int")
    assert got(df) == brute(rows)
    assert substring_digest(df.limit(0)).count() == 0
    assert dedup_substrings(df).columns == ["doc_id", "n_words", "n_removed", "kept", "repeats"]


@pytest.mark.parametrize("limit", [1, 3, 40])
def test_small_groups_split_by_longer_prefixes(spark, limit):
    common = " ".join(f"k{i}" for i in range(20))
    rows = [(i, f"s{i} t{i} {common} u{i} " + " ".join(f"{'abc'[i % 3]}{k}" for k in range(25))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = dedup_substrings(df, params=SubstringParams(group_suffixes=limit))
    assert sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out.collect()) == brute(rows)


def test_deep_nodes_and_word_hashes():
    rows = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 2], [1, 2, 2], [1, 2, 2]])
    assert common_prefixes(rows).tolist() == [3, 2, 1, 3]
    assert common_prefixes(rows, np.array([1, 2, 2, 2, 2])).tolist() == [0, 2, 1, 3]
    assert deep_nodes(rows, 3).tolist() == [0, 0, 1, 2, 2]
    assert deep_nodes(rows, 2).tolist() == [0, 0, 0, 1, 1]
    h, n = hash_words(["ab c", None, "", "c\x0bab ab", "\u00a0"])
    assert n.tolist() == [2, 0, 0, 3, 1] and h[0] == h[3] == h[4] and h[1] == h[2] and len(set(h.tolist())) == 3


def brute_repeats(rows, w=13):
    """Maximal runs of windows that start in a smaller document too."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    low = {}
    for i, x in words.items():
        for k in range(len(x) - w + 1):
            low[tuple(x[k : k + w])] = min(low.get(tuple(x[k : k + w]), i), i)
    out = {}
    for i, x in words.items():
        runs = []
        for k in range(len(x) - w + 1):
            if low[tuple(x[k : k + w])] < i:
                if runs and runs[-1][0] + runs[-1][1] == k + w - 1:
                    runs[-1][1] += 1
                else:
                    runs.append([k, w])
        out[i] = [tuple(r) for r in runs]
    return out


@pytest.mark.parametrize("limit", [2, 100_000])
def test_maximal_repeats_equal_brute_force(spark, limit):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = np.random.default_rng(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # Few words, so that repeats of all lengths overlap, follow each other and differ in what is around them.
    rows += [(10_000 + i, " ".join(rng.choice(["a", "b"], int(rng.integers(10, 60))))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.repeats] for r in dedup_substrings(df, params=SubstringParams(group_suffixes=limit)).collect()}
    want = brute_repeats(rows)
    assert got == want
    assert max(n for x in want.values() for _, n in x) > 40
