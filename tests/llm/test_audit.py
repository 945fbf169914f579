"""The filter audit against its SQL on the tables, and against a walk through every order on odd rows."""

import re
from itertools import permutations

import duckdb

from siltstone.llm.audit import AUDIT_SQL, audit_filters
from siltstone.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, part string, n long, E boolean"


def walk(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic). The filters applied one after another."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        tests = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), copy]
        rows.append((lang or "", {f for f, x in zip("ABCDE", tests) if x}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                fails = sum(f in r[1] for r in mine)
                found.append([part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f])
        out += [tuple([*x[:-1], shapley[x[-1]]]) for x in found]
    return sorted(out)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(150))
    texts = [None, "", " \t\n", "a b c", "a b c", "A# B# C#", "A# B# C#", long, long, long + " #", "X " * 200, "é" * 99, "dup dup dup", "x" * 300_000, " ".join(["same"] * 120)]
    docs = [(i if i != 8 else 7, t, [None, "", "en", "de"][i % 4]) for i, t in enumerate(texts)]
    docs += [(3, "a b c", "en"), (None, "a b c", "en"), (None, "", None), (-5, "A# B# C#", "fr"), (7, long, "en")]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(12)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (5, None, None), (999, 1, 1)]
    df = spark.createDataFrame([(i, t, lang, "mine", 1, True) for i, t, lang in docs], DOCS).repartition(4)
    got = audit_filters(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == walk(docs, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(spark.createDataFrame([], DOCS), none).count() == 0
    one = spark.createDataFrame([(1, "a", None, "", 1, True)], DOCS)
    rows = audit_filters(one, none).collect()
    assert len(rows) == 600 and {r.shapley for r in rows if r.filter_order[r.step - 1] == "A"} == {120}


def test_whole_table(spark):
    at = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op12_filter_audit"](spark, at).collect())
    assert got == sorted(c.execute(AUDIT_SQL).fetchall())
    docs = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{at}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert got == walk(docs, labels)
