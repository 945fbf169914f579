import itertools
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import dedup, joins, merge, reports, retrieval


def python_fold(rows):
    """Sequential reference for fold_merge: (verified, description) quality, evidence overlay, skills union, score maximum."""
    out = {}
    for r in sorted(rows, key=lambda r: r["o"]):
        left = out.get(r["k"])
        if left is None:
            out[r["k"]] = {**r, "skills": list(dict.fromkeys(r["skills"]))}
            continue
        q = lambda x: (x["verified"], x["description"])
        a, b = (r, left) if q(r) > q(left) else (left, r)
        merged = dict(a)
        merged["evidence"] = a["evidence"] or b["evidence"]
        merged["skills"] = list(dict.fromkeys([*left["skills"], *r["skills"]]))
        merged["score"] = max(left["score"], r["score"])
        out[r["k"]] = merged
    return out


def test_fold_merge_equals_sequential_fold_in_any_partitioning(spark):
    rng = random.Random(3)
    rows = [
        {"k": f"k{rng.randrange(9)}", "o": i, "verified": rng.randrange(2), "description": rng.randrange(4), "evidence": rng.choice(["", "e1", "e2"]), "skills": rng.sample("RSP", 2), "score": rng.randrange(90)}
        for i in range(120)
    ]
    want = python_fold(rows)
    schema = "k string, o int, verified int, description int, evidence string, skills array<string>, score int"
    for parts in (1, 7):
        df = spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(parts)
        got = merge.fold_merge(df, ["k"], "o", ["verified", "description"], ["evidence"], ["skills"], ["score"]).collect()
        for r in got:
            w = want[r.k]
            if sum(x["k"] == r.k for x in rows) > 1:
                assert (r.verified, r.description, r.evidence, r.skills, r.score) == (w["verified"], w["description"], w["evidence"], w["skills"], w["score"])
        assert len(got) == len(want)


def test_two_postings_merge(spark):
    schema = "k string, o int, q int, skills array<string>, sources array<string>, score int"
    df = spark.createDataFrame([("u", 1, 1, ["R"], ["a"], 60), ("u", 2, 1, ["Python"], ["b"], 70)], schema)
    r = merge.fold_merge(df, ["k"], "o", ["q"], [], ["skills", "sources"], ["score"]).first()
    assert (r.score, set(r.skills), r.sources, r.n_merged) == (70, {"R", "Python"}, ["a", "b"], 2)


POSTS = [
    (1, "Acme", "Analyst", "Boston", "https://acme.com/jobs/111", "", "", 5, 1.0),
    (2, "Acme", "Analyst", "", "https://acme.com/jobs/111?utm_source=x", "", "", 4, 9.0),
    (3, "Acme", "Analyst", "Boston, USA", "https://acme.com/jobs/222", "", "", 3, 1.0),
    (4, "Acme", "Analyst", "Remote Boston", "https://acme.com/careers", "", "", 2, 1.0),
    (5, "Other", "Analyst", "Boston", "https://acme.com/jobs/111", "", "", 1, 1.0),
    (6, "Acme", "Careers", "Boston", "https://acme.com/careers", "", "", 0, 1.0),
    (7, "", "Analyst", "Boston", "https://acme.com/careers", "", "", 6, 1.0),
    (8, "Acme & Co", "Lead", "", "https://x.com/a", "", "", 7, 1.0),
    (9, "acme and co", "LEAD", "Paris", "https://y.com/b", "", "", 8, 3.0),
]
POST = "id int, company string, title string, location string, job_url string, canonical_url string, application_id string, seen int, rank double"


@pytest.mark.parametrize("displayed", [False, True])
def test_blocked_pairs_equal_nested_loop_and_are_symmetric(spark, displayed):
    df = spark.createDataFrame(POSTS, POST)
    got = {(r.a, r.b) for r in dedup.same_posting_pairs(df, displayed=displayed).collect()}
    k = dedup.with_identity(df).cache()
    a, b = k.alias("a"), k.alias("b")
    loop = a.join(b, F.col("a.id") != F.col("b.id")).where(dedup.same_posting("a", "b", displayed))
    pairs = {(r.x, r.y) for r in loop.select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).collect()}
    assert pairs == {(y, x) for x, y in pairs}
    assert got == {(x, y) for x, y in pairs if x < y}
    assert (1, 2) in got and (1, 3) not in got and (1, 5) not in got and (8, 9) in got if not displayed else True


def test_greedy_display_equals_sequential_loop(spark):
    df = spark.createDataFrame(POSTS, POST)
    pairs = {(r.a, r.b) for r in dedup.same_posting_pairs(df, displayed=True).collect()}
    same = lambda x, y: (min(x, y), max(x, y)) in pairs
    kept: list[tuple] = []
    for r in sorted(POSTS, key=lambda r: (r[7], r[0])):
        at = next((i for i, k in enumerate(kept) if same(k[0], r[0])), None)
        if at is None:
            kept.append(r)
        elif r[8] > kept[at][8]:
            kept[at] = r
    got = {r.id for r in dedup.greedy_display(df, "seen", "rank").collect()}
    assert got == {k[0] for k in kept}


def test_keep_one_and_incremental(spark):
    df = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 5, "y"), ("b", 3, None, "z")], "k string, o int, s int, v string")
    assert sorted(r.v for r in dedup.keep_last(df, ["k"], "o").collect()) == ["y", "z"]
    assert sorted(r.v for r in dedup.keep_best(df, ["k"], "s", "o").collect()) == ["x", "z"]
    state = spark.createDataFrame([("a", "x")], "k string, v string")
    assert sorted(r.v for r in dedup.skip_synced(df, state, "k", "v").collect()) == ["y", "z"]
    now = spark.createDataFrame([("t", "u2"), ("t", "u1"), ("n", "u3"), ("t", "")], "t string, u string")
    before = spark.createDataFrame([("t", "u1")], "t string, u string")
    assert {(r.t, r.u): r.repost for r in dedup.reposts(now, before, "t", "u").collect()} == {("t", "u2"): True, ("t", "u1"): False, ("n", "u3"): False, ("t", ""): False}


def test_joins(spark):
    left = spark.createDataFrame([(1, "u1", "a"), (2, "u2", "b"), (3, "", "c")], "id int, url string, name string")
    right = spark.createDataFrame([(10, "u1", "b"), (11, "u1", "a"), (12, "", "z")], "rid int, rurl string, rname string")
    keys = [(F.col("url"), F.col("rurl")), (F.col("name"), F.col("rname"))]
    got = sorted((r.id, r.rid or 0) for r in joins.or_equi_join(left, right, "id", "rid", keys).collect())
    assert got == [(1, 10), (1, 11), (2, 10), (3, 0)]
    assert [r.id for r in joins.or_equi_join(left, right, "id", "rid", keys, "left_anti").collect()] == [3]
    assert sorted(r.id for r in joins.or_equi_join(left, right, "id", "rid", keys, "left_semi").collect()) == [1, 2]
    a = spark.createDataFrame([("Acme Labs",), ("x",), ("",), ("bc",)], "a string")
    b = spark.createDataFrame([("acme",), ("xyz",), ("ABCD",), ("",), ("q",)], "b string")
    want = {(x.a, y.b) for x, y in itertools.product(a.collect(), b.collect()) if x.a and y.b and (x.a.lower() in y.b.lower() or y.b.lower() in x.a.lower())}
    rows = [(r.a, r.b) for r in joins.contains_join(a, b, "a", "b").collect()]
    assert set(rows) == want and len(rows) == len(want)
    scored = spark.createDataFrame([("p", 1, 95), ("p", 2, 80), ("q", 3, 80), ("q", 4, 80), ("r", 5, 20)], "k string, v int, s int")
    assert [r.v for r in joins.unique_best(scored, "k", "s", 80).collect()] == [1]


def test_batches_are_greedy_and_bounded(spark):
    rows = [(i, "x" * (i * 37 % 90)) for i in range(60)]
    df = spark.createDataFrame(rows, "o int, j string").repartition(5)
    got = {r.o: r.batch for r in merge.split_batches(df, "o", "j", 7, 200).collect()}
    batch, n, size, want = 0, 0, 2, {}
    for o, j in rows:
        extra = len(j) + (1 if n else 0)
        if n and (n >= 7 or size + extra > 200):
            batch, n, size, extra = batch + 1, 0, 2, len(j)
        n, size = n + 1, size + extra
        want[o] = batch
    assert got == want
    with pytest.raises(Exception, match="exceeds a batch"):
        merge.split_batches(df, "o", "j", 7, 50).collect()


def greedy(sizes, most_rows, most_bytes):
    batch, n, size, out = 0, 0, 2, []
    for b in sizes:
        extra = b + (1 if n else 0)
        if n and (n >= most_rows or size + extra > most_bytes):
            batch, n, size, extra = batch + 1, 0, 2, b
        n, size = n + 1, size + extra
        out.append(batch)
    return out


@pytest.mark.parametrize("block", [1, 30, 1000])
def test_batches_over_many_blocks(spark, block):
    rng = random.Random(block)
    rows = [(i, "x" * rng.randrange(60)) for i in range(400)]
    df = spark.createDataFrame(rows, "o int, j string").repartition(6)
    got = {r.o: r.batch for r in merge.split_batches(df, "o", "j", 7, 200, block=block).collect()}
    assert [got[i] for i, _ in rows] == greedy([len(j) for _, j in rows], 7, 200)


def test_batches_of_odd_rows(spark):
    rows = [(1, "a"), (1, "bb"), (None, "c"), (2, None), (1, "a"), (None, None), (3, "é")]
    df = spark.createDataFrame([(*r, 9, 9, 9, 9) for r in rows], "o int, j string, row int, sum int, batch int, part int")
    got = merge.split_batches(df, "o", "j", 3, 100)
    assert sorted(got.columns) == sorted(df.columns)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert sorted((r.batch, *(repr(x) for x in (r.o, r.j))) for r in got.collect()) == sorted((b, repr(o), repr(j)) for b, (o, j) in zip(greedy([len((j or "").encode()) for _, j in order], 3, 100), order))
    assert merge.split_batches(df.where("false"), "o", "j", 3, 100).count() == 0
    with pytest.raises(Exception, match="exceeds a batch"):
        merge.split_batches(df, "o", "j", 3, 3).collect()


def full_fold(rows):
    """Sequential D3 with all four quality fields: rows have v, text, note, score; tags are a union."""
    out = {}
    for r in rows:
        left = out.get(r["k"])
        if left is None:
            out[r["k"]] = {**r, "n": 1}
            continue
        q = lambda x: (x["v"], len(x["text"]), len(x["note"]), x["score"])
        a, b = (r, left) if q(r) > q(left) else (left, r)
        out[r["k"]] = {"k": r["k"], "v": a["v"] or b["v"], "text": a["text"] or b["text"], "note": a["note"] or b["note"], "title": a["title"] or b["title"], "score": max(a["score"], b["score"]), "tags": list(dict.fromkeys([*left["tags"], *r["tags"]])), "n": left["n"] + 1}
    return out


def folded(spark, rows, parts=5):
    data = [(r["k"], i, r["v"], r["text"], len(r["text"]), r["note"], len(r["note"]), r["title"], r["score"], r["tags"]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, o int, v int, text string, tl int, note string, nl int, title string, score int, tags array<string>").repartition(parts)
    return merge.fold_merge(df, ["k"], "o", ["v", "tl", "nl", "score"], ["text", "note", "title"], ["tags"], ["score"])


@pytest.mark.parametrize("seed", range(4))
def test_fold_with_all_quality_fields_filled_and_overtaken(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    rows = [
        {"k": f"k{rng.randrange(40)}", "v": int(rng.random() < 0.15), "text": word(rng.choice([0, 0, 1, 2, 3])), "note": word(rng.choice([0, 0, 1, 2])), "title": rng.choice(["", "t", "u"]), "score": rng.randrange(5), "tags": rng.sample("RSPQ", rng.randrange(3))}
        for _ in range(700)
    ]
    want = full_fold(rows)
    got = folded(spark, rows).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.k]
        assert (r.v, r.text, r.tl, r.note, r.nl, r.title, r.score, r.tags, r.n_merged) == (w["v"], w["text"], len(w["text"]), w["note"], len(w["note"]), w["title"], w["score"], w["tags"], w["n"])


def test_fold_of_one_key_of_a_million_rows(spark):
    df = spark.range(0, 1_000_000, 1, 8).selectExpr(
        "'hot' k", "id o", "int(id % 1000 = 999) v", "int(id * 7919 % 100003) tl", "concat('t', id) title", "int(id * 31 % 977) score", "array(concat('s', id % 50)) tags"
    )
    r = merge.fold_merge(df, ["k"], "o", ["v", "tl", "score"], ["title"], ["tags"], ["score"]).first()
    best = max((i * 7919 % 100003, -i) for i in range(999, 1_000_000, 1000))
    assert (r.tl, r.n_merged, r.score, len(r.tags), r.tags[0], r.v) == (best[0], 1_000_000, 976, 50, "s0", 1)
    assert r.title in {f"t{i}" for i in range(999, 1_000_000, 1000) if i * 7919 % 100003 == best[0]}


def test_fold_of_odd_rows(spark):
    schema = "k string, o int, q int, e string, tags array<string>, at int, base int, turn int"
    df = spark.createDataFrame([(None, None, None, None, None, 1, 1, 1), (None, 1, 0, "", [], 1, 1, 1), ("a", 1, 2, "x", ["R", "R"], 1, 1, 1), ("b", 5, 1, "p", ["R"], 1, 1, 1), ("b", 5, 1, "p", ["R"], 1, 1, 1)], schema)
    got = {r.k: r for r in merge.fold_merge(df, ["k"], "o", ["q"], ["e"], ["tags"]).collect()}
    assert (got["a"].tags, got["a"].n_merged, got["b"].n_merged, got["b"].e) == (["R", "R"], 1, 2, "p")
    assert (got[None].n_merged, got[None].tags, got[None].e) == (2, [], None)
    assert merge.fold_merge(df.where("false"), ["k"], "o", ["q"], ["e"], ["tags"]).count() == 0


def test_upserts_and_enrichment(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, __ord int")
    assert sorted((r.k, r.v) for r in merge.upsert_latest(old, new, ["k"]).collect()) == [("a", 1), ("b", 4), ("c", 5)]
    df = spark.createDataFrame([("PhD and 3+ years", "https://x.io/1", "open", 50), ("", "http://bit.ly/1", "gone", 3)], "d string, u string, s string, p int")
    r = merge.enrich(df, "d", "u", "s", "p", ["open"], F.lit(False)).orderBy(F.desc("p")).collect()
    assert (r[0].evidence_missing, r[0].score_after, r[0].legitimacy_score) == ([], 50, 100)
    assert r[1].evidence_missing == ["degree", "experience"] and r[1].score_after == 0 and r[1].legitimacy_score == 100 - 18 * 4


def test_reports(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "r string")
    assert reports.histogram(df, "r").first().reasons == {"x": 2, "y": 1}
    known = spark.createDataFrame([("x",), ("z",)], "r string")
    assert {r.r: r.n for r in reports.counts_with_zero(df, "r", known).collect()} == {"x": 2, "z": 0}
    maps = spark.createDataFrame([({"a": 1},), ({"a": 2, "b": 5},)], "m map<string,int>")
    assert {r.counter: r.total for r in reports.sum_maps(maps, "m").collect()} == {"a": 3, "b": 5}
    fit = spark.createDataFrame([("p", "k", "covered", "Direct", 90.0), ("p", "k2", "x", "No Evidence", 10.0)], "id string, keyword string, status string, classification string, confidence double")
    r = reports.fit_score(fit, "id").first()
    assert (r.evidence_coverage, r.direct_coverage, r.cv_coverage, r.gap_risk, r.confidence, r.score) == (50, 50, 50, 50, 50, 50)
    pages = spark.range(45)
    assert [r.id for r in reports.page(pages, [F.col("id")], 9, 20).collect()] == [40, 41, 42, 43, 44]


def test_retrieval_pieces(spark):
    df = spark.createDataFrame([("Using SQL and collaborating on models, 临床试验 R",)], "t string")
    assert df.select(retrieval.tokens(F.col("t")).alias("x")).first().x == ["sql", "collaborat", "models,"[:-2], "r", "临床", "床试", "试验"]
    c = spark.createDataFrame([("knows C++ (fast)", "c++"), ("basics", "sic"), ("做临床试验", "临床"), ("x", "")], "t string, p string")
    assert [r.x for r in c.select(retrieval.contains_phrase(F.col("t"), F.col("p")).alias("x")).collect()] == [True, False, True, False]
    yes, no, z = F.lit(True), F.lit(False), F.lit(0.0)
    base = {"exact": F.lit(1.0), "direct": z, "named_tool": no, "eligible": yes, "scope_conflict": no, "overclaim": no, "score": F.lit(50.0), "problem": z, "industry": z, "bm25": z, "cosine": z, "has_path": no, "path_adjacent": no, "path_transferable": no, "embedding_only": no, "status": F.lit("completed")}
    label = lambda **kw: spark.range(1).select(retrieval.classify({**base, **kw}).alias("x")).first().x
    assert label() == "Direct"
    assert label(eligible=no) == "No Evidence"
    assert label(exact=z, path_adjacent=yes) == "Adjacent"
    assert label(exact=z, path_transferable=yes) == "Strong Transferable"
    assert label(exact=z, path_transferable=yes, embedding_only=yes) == "Adjacent"
    assert label(exact=z, named_tool=yes) == "No Evidence"
    assert label(scope_conflict=yes) == "Adjacent"
    planned = spark.range(1).select(retrieval.recommended(F.lit("Direct"), F.lit("planned")).alias("x")).first().x
    assert planned == "conditional"
