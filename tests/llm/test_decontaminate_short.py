import random
from itertools import combinations

import pytest
from test_decontaminate import leaks
from test_decontaminate_brute import leaked

from siltstone.llm.decontaminate import MASKS, DecontaminationParams, find_leaks

WORDS = "ant bee cat dog elk fox gnu hen ibis jay kite lark".split()


def test_short_items_are_found_with_every_accepted_difference(spark):
    items = [(n, " ".join(f"{w}{n}" for w in WORDS[:n])) for n in range(1, 13)]
    docs, want = [], set()
    for n, item in items:
        words = item.split()
        for k in range(n * 3 // 13 + 2):
            for at in combinations(range(n), k):
                body = [f"x{i}" if i in at else w for i, w in enumerate(words)]
                docs.append((len(docs), " ".join(["some", "lead", *body, "and", "tail"])))
                if k <= n * 3 // 13:
                    want.add((docs[-1][0], n))
    assert set(leaks(spark, docs, items)) == want


def test_short_items_at_the_edges_of_a_document(spark):
    items = [(1, "ant bee cat"), (2, "dog elk fox gnu hen ibis jay kite lark owl")]
    docs = [(1, "ant bee cat"), (2, "x ant bee cat"), (3, "ant bee"), (4, f"{items[1][1]} x"), (5, f"x {items[1][1]}"), (6, "elk fox gnu hen ibis jay kite lark owl")]
    assert set(leaks(spark, docs, items)) == {(1, 1), (2, 1), (4, 2), (5, 2)}


def test_masks_hit_every_way_to_change_three_of_thirteen_tokens():
    places = [{x + at for x in mask} for mask in MASKS for at in range(13 - mask[-1])]
    assert all(any(not place & set(changed) for place in places) for changed in combinations(range(13), 3))


@pytest.mark.parametrize("params", [DecontaminationParams(), DecontaminationParams(broadcast_seeds=0)])
def test_items_of_all_lengths_equal_brute_force(spark, params):
    rng = random.Random(4)
    items = {n: " ".join(f"t{rng.randrange(400)}" for _ in range(n)) for n in range(3, 40)}
    docs = {}
    for i in range(600):
        words = items[rng.randrange(3, 40)].split()
        a = rng.randrange(max(1, len(words) - 12))
        words = words[a : a + rng.randrange(10, 30)]
        for k in rng.sample(range(len(words)), min(len(words), rng.randrange(5))):
            words[k] = "other"
        docs[i] = " ".join([f"u{rng.randrange(400)}" for _ in range(rng.randrange(20))] + words + ["end"])
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = leaked(docs, items)
    assert {(r.doc_id, r.item_id) for r in find_leaks(d, b, params=params).collect()} == want and len(want) > 200


@pytest.mark.parametrize("seeds", [500_000, 0])
def test_an_id_of_several_texts_has_the_overlaps_of_all(spark, seeds):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(1, "nothing here at all"), (1, f"x {item}"), (1, f"{item} y z"), (None, item), (None, "q"), (2, "clean")]
    d = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, version string, seed int")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r.n_overlaps for r in find_leaks(d, b, params=DecontaminationParams(broadcast_seeds=seeds)).collect()}
    assert got == {1: 2, None: 1}
