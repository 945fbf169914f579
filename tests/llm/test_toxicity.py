"""Toxicity scores: the index against brute-force cosines, odd rows, what may be learned, and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm.queries import QUERIES
from siltstone.llm.toxicity import BlockMaxIndex, ToxicityParams, calibrate, score_toxicity, terms

DOCS = "doc_id long, text string, lang string, source string, example long, terms int, score int"
LABELS = "doc_id long, quality int, toxic int"


def packed(numbers, counts):
    return np.array(numbers, dtype="<u2").tobytes(), np.array(counts, dtype="<u4").tobytes()


@pytest.mark.parametrize("seed", range(3))
def test_index_equals_brute_force(seed):
    rng = random.Random(seed)
    p = ToxicityParams(neighbours=5, block=8)
    size = 60

    def vector(base):
        numbers = sorted({min(size - 1, int(rng.expovariate(0.2)) + base) for _ in range(rng.randint(0, 9))})
        return packed(numbers, [rng.randint(1, 4) for _ in numbers])

    rows = [(i, rng.random() < 0.4, *vector(rng.choice([0, 20, 40]))) for i in range(300)]
    rows += [(1000 + i, True, *rows[i][2:]) for i in range(40)]
    idf = np.array([1 + rng.random() for _ in range(size)])
    index = BlockMaxIndex(rows, idf, {True: 2.0, False: 5.0}, p)

    def dense(t, c):
        v = np.zeros(size)
        n = np.frombuffer(t, dtype="<u2")
        v[n] = (1 + np.log(np.frombuffer(c, dtype="<u4"))) * idf[n]
        return v / np.sqrt(v @ v) if len(n) else v

    each = {i: dense(t, c) for (t, c), i in index.number.items()}
    read = []
    inner = index.similarities
    index.similarities = lambda n, w, blocks: (read.append(len(blocks)), inner(n, w, blocks))[1]
    for t, c in [vector(rng.choice([0, 20, 40])) for _ in range(60)] + [r[2:] for r in rows[:20]]:
        for without in (None, index.number.get((t, c))):
            q = dense(t, c)
            want = sorted((-round(float(q @ v), 9), i) for i, v in each.items() if q @ v > 0 and i != without)[:5]
            at, near = index.top(t, c, without)
            assert [i for _, i in want] == at.tolist() and np.allclose([-s for s, _ in want], near, atol=2e-9)
    assert sum(read) < 0.8 * 160 * index.blocks  # blocks were skipped


def test_terms_are_words_and_beginnings():
    p = ToxicityParams(beginnings=(4,))
    found = {}
    for text in ["Hello, HELLO hell", "hello", "hell", "aééé b", "", None]:
        h = [x for _, hashes, _ in terms([text], p) for x in hashes.tolist()]
        found[text] = sorted(h)
    assert len(found["Hello, HELLO hell"]) == 6 and len(set(found["Hello, HELLO hell"])) == 3
    assert set(found["hello"]) | set(found["hell"]) == set(found["Hello, HELLO hell"])
    assert len(found["aééé b"]) == 3 and found[""] == found[None] == []


def test_calibration_is_monotone():
    rng = np.random.default_rng(0)
    votes = rng.random(500)
    x, y = calibrate(votes, rng.random(500) < votes, np.ones(500), 0.1)
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and 0 <= y[0] and y[-1] <= 1


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def made(n=600, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        words = rng.choices(plain, k=rng.randint(5, 60))
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["zorgix", "zorgone", "Vilewort!"])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, 3) for i, t in docs], DOCS).repartition(4), spark.createDataFrame(labels, LABELS)


def scores(spark, docs, labels):
    return {r.doc_id: r for r in score_toxicity(*frames(spark, docs, labels)).collect()}


def test_finds_toxic_texts_and_leaves_clean_ones(spark):
    docs, labels = made()
    got = scores(spark, docs, labels)
    assert len(got) == len(docs) and all(got[i].held_out == held(i) for i, _ in docs)
    assert [i for i, _, y in labels if got[i].predicted != y] == []
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert any(":1:" in got[i].evidence for i, _, y in labels if y)


def test_held_out_labels_and_ids_change_nothing(spark):
    docs, labels = made()
    want = scores(spark, docs, labels)
    flipped = [(i, q, 1 - y if held(i) else y) for i, q, y in labels]
    got = scores(spark, docs, flipped)
    assert all(want[i].score == got[i].score for i, _ in docs)
    moved = [(i + 10_000_000, t) for i, t in docs]  # no label belongs to the new ids
    both = scores(spark, [*docs, *moved], labels)
    assert all(both[i].score == both[i + 10_000_000].score for i, _ in docs)


def test_odd_rows(spark):
    docs, labels = made()
    extra = [(-1, None), (-2, ""), (-3, "zorgix " * 100_000), (-4, " \t#"), (-5, "é" * 10), (None, "vilewort"), (7, docs[7][1]), (7, "zorgix"), (-6, "plain " * 200_000 + "zorgix")]
    odd = [(5, 0, 0), (5, 0, 0), (None, 1, 1), (9, None, None), (123456, 1, 1)]
    rows = score_toxicity(*frames(spark, [*docs, *extra], [*labels, *odd])).collect()
    assert len(rows) == len(docs) + len(extra)
    of = {r.doc_id: r for r in rows if r.doc_id is None or r.doc_id < 0}
    assert of[-1].score == of[-2].score == of[-4].score == of[-5].score < 0.3 and of[-1].evidence == ""
    assert of[-3].predicted == of[None].predicted == of[-6].predicted == 1 and of[None].held_out is False
    assert sorted(r.predicted for r in rows if r.doc_id == 7)[-1] == 1


def test_nothing_to_learn_from(spark):
    docs, labels = made(60)
    assert {r.score for r in scores(spark, docs, []).values()} == {0.0}
    assert {r.predicted for r in scores(spark, docs, [(i, 1, 0) for i, _ in docs]).values()} == {0}
    assert {r.score for r in scores(spark, docs, [(i, 1, 1) for i, _ in docs]).values()} == {1.0}
    assert score_toxicity(*frames(spark, [], labels)).count() == 0


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    got = QUERIES["op11_toxicity"](spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").where("held_out")
    r = got.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert r[0] > 0.85 and r[1] < 0.04  # one toxic label in twenty here is on a text without any such word
