from test_decontaminate_brute import leaked

from siltstone.llm.decontaminate import drop_leaks, find_leaks

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
OTHER = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"


def leaks(spark, docs, items=((1, ITEM), (2, OTHER), (3, None), (4, "...!"))):
    d = spark.createDataFrame(list(docs), "doc_id long, text string")
    b = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in find_leaks(d, b).collect()}


def test_substitutions_and_clipping(spark):
    three = ITEM.replace("two", "X").replace("seven", "Y").replace("twelve", "Z")
    five = three.replace("four", "V").replace("nine", "W")
    docs = [
        (1, f"lead words, {ITEM.upper()}. tail"),
        (2, f"lead {three} tail"),
        (3, f"lead {five} tail"),
        (4, " ".join(ITEM.split()[:9])),
        (5, None),
        (6, ""),
        (7, OTHER),
        (8, f"{OTHER} | {ITEM} | {OTHER}"),
        (9, "word " * 30_000),
    ]
    got = leaks(spark, docs)
    assert set(got) == {(1, 1), (2, 1), (7, 2), (8, 1), (8, 2)}
    assert got[8, 2].n_overlaps == 2 and got[2, 1].best_matched == 11


def test_empty_tables_and_anti_join(spark):
    assert leaks(spark, [], [(1, ITEM)]) == {}
    assert leaks(spark, [(1, ITEM)], []) == {}
    d = spark.createDataFrame([(1, ITEM, 5), (1, ITEM, 5), (None, "x", 6), (2, "clean", 7)], "doc_id long, text string, item_id long")
    b = spark.createDataFrame([(1, ITEM), (1, ITEM)], "item_id long, text string")
    left = drop_leaks(d, b)
    assert left.columns == d.columns
    assert sorted(r.item_id for r in left.collect()) == [6, 7]


def test_table_equals_brute_force(spark):
    at = "/root/testdata/sf0.001/"
    docs = spark.read.parquet(at + "documents.parquet")
    items = spark.read.parquet(at + "benchmark.parquet")
    want = leaked({r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in items.collect()})
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()}
    assert want and got == want
