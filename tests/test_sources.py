import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from siltstone.sources import files, markup, sinks

ROW = StructType([StructField("title", StringType()), StructField("score", LongType())])


def test_json_lists(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"title": "x", "score": 1}, "no object", {"title": "y"}]))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text('{"title": "no list"}')
    read = lambda n: sorted((r.title, r.score) for r in files.read_json_list(spark, str(tmp_path / n), ROW).collect())
    assert read("a.json") == [("x", 1), ("y", None)]
    assert read("b.json") == read("c.json") == read("missing.json") == []
    doc = files.read_json_document(spark, str(tmp_path / "missing.json"), ROW, {"title": "d"})
    assert doc.first().title == "d"
    assert files.read_json_document(spark, str(tmp_path / "c.json"), ROW).first().title == "no list"


def test_mixed_formats_and_directories(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿title,url\n"x, y",u1\n', encoding="utf-8")
    (tmp_path / "b.tsv").write_text("url\ttitle\nu2\tz\n")
    (tmp_path / "c.jsonl").write_text('{"title": "j", "url": "u3"}\n\n{"title": "k"}\n')
    (tmp_path / "d.json").write_text('[{"url": "u4"}]')
    got = files.read_any(spark, [str(tmp_path / n) for n in ("a.csv", "b.tsv", "c.jsonl", "d.json")], ["title", "url"])
    assert sorted((r.title or "", r.url or "") for r in got.collect()) == [("", "u4"), ("j", "u3"), ("k", ""), ("x, y", "u1"), ("z", "u2")]
    with pytest.raises(ValueError):
        files.read_any(spark, ["x.doc"], ["title"])
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.jsonl").write_text('{"title": "deep"}\n')
    names = {r.file.rsplit("/", 1)[1] for r in files.read_directory(spark, str(tmp_path), ".jsonl").collect()}
    assert names == {"c.jsonl", "e.jsonl"}
    assert files.latest_file(spark, str(tmp_path / "sub"), "*.jsonl").endswith("e.jsonl")


def test_manifest_and_plan(spark, tmp_path):
    for n in "ab":
        with gzip.open(tmp_path / f"{n}.json.gz", "wt") as f:
            f.write(json.dumps({"title": n, "score": 1}) + "\n")
    (tmp_path / "m.json").write_text('{"chunks": ["a.json.gz", "b.json.gz"]}')
    assert {(r.title, r.chunk) for r in files.read_manifest(spark, str(tmp_path), "m.json", ROW).collect()} == {("a", "a.json.gz"), ("b", "b.json.gz")}
    k = spark.createDataFrame([(0, "x"), (1, "y")], "order int, keyword string")
    c = spark.createDataFrame([(0, "p"), (1, "q")], "order int, city string")
    rows, cursor = files.query_plan(k, c, 3, 2)
    assert ([(r.keyword, r.city) for r in rows.collect()], cursor) == ([("y", "q"), ("x", "p")], 1)


def test_unwrap_and_fenced(spark):
    df = spark.createDataFrame([('{"jobs": [1, 2]}',), ("[3]",), ('{"a": {"x": 1}, "b": {"x": 2}}',), ("no json",)], "p string")
    assert [None if r.n < 0 else r.n for r in df.select(F.coalesce(F.size(files.unwrap("p")), F.lit(-1)).alias("n")).collect()] == [2, 1, 2, None]
    md = spark.createDataFrame([('text\n```json\n{"a": 1}\n```\n',)], "t string")
    assert md.select(files.fenced_json("t", "a int").alias("x")).first().x.a == 1
    base = spark.createDataFrame([("Acme Inc", ""), ("Beta", "s")], "company string, source string")
    more = spark.createDataFrame([("acme", "official")], "company string, source string")
    assert sorted((r.company, r.source) for r in files.company_dimension(base, more).collect()) == [("Beta", "s"), ("acme", "official")]


PAGE = """<html><body><h1>Hi</h1> <a href="/jobs/1">One</a><a href="#x">no</a>
<script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "A", "url": "/jobs/9"}, {"@type": "Org", "name": "o", "url": "/o"}]}</script>
<script>window.x = {"props": {"jobs": [{"jobTitle": "B", "jobUrl": "/jobs/2", "location": {"city": "SF", "state": "CA"}}]}};</script>
<style>p {}</style></body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, "https://a.com/x", PAGE), (2, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in markup.scan_pages(df).collect()}
    assert got[2].text == "" and got[2].rows == []
    assert got[1].text == "Hi One no" and [(x.url, x.label) for x in got[1].links] == [("https://a.com/jobs/1", "One")]
    assert {(x.title, x.url, x.location) for x in got[1].rows} == {("A", "https://a.com/jobs/9", ""), ("B", "https://a.com/jobs/2", "SF, CA")}
    ld = df.where("page_id = 1").select(F.transform(markup.json_ld("html"), lambda v: F.try_variant_get(v, "$['@type']", "string")).alias("t")).first().t
    assert ld == ["JobPosting", "Org"]


def test_nested_json_rows(spark):
    nested = {"a": [{"b": {"jobName": "T", "id": 7, "locations": [{"name": "San Francisco"}, {"name": "USA"}, {"name": "USA"}]}}], "name": "no url"}
    df = spark.createDataFrame([(1, json.dumps(nested)), (2, "broken"), (3, None)], "id long, p string")
    assert [tuple(r) for r in markup.harvest_json(df.withColumnRenamed("id", "i"), "i", "p").collect()] == [(1, "T", "", "San Francisco, USA", "7")]


def test_markdown_xml_latex_redirects(spark):
    df = spark.createDataFrame([("see [A b](https://x.io/1) and [c](http://y/2)", "<i><t>A</t><u><![CDATA[b & c]]></u></i><i><t>D</t></i>", r"\section{One} a \section*{Two} \begin{itemize}\item x \item y \end{itemize}")], "m string, x string, l string")
    r = df.select(markup.markdown_links("m").alias("m"), markup.xml_items("x", "i", ("t", "u")).alias("x"), markup.latex_sections("l").alias("l")).first()
    assert [(a.label, a.url) for a in r.m] == [("A b", "https://x.io/1"), ("c", "http://y/2")]
    assert [(a.t, a.u) for a in r.x] == [("A", "b & c"), ("D", "")]
    assert [s.name for s in r.l] == ["One", "Two"]
    items = spark.createDataFrame([(r.l[1].body,)], "b string").select(markup.latex_items(F.col("b")).alias("x")).first().x
    assert items == ["x", "y"]
    u = spark.createDataFrame([("//d/?uddg=https%3A%2F%2Fa.com%2F1",), ("https://r/RU=https%3a%2f%2fb.com/RK=2",), ("https://c.com",)], "u string")
    assert [r.x for r in u.select(markup.redirect_target(F.col("u")).alias("x")).collect()] == ["https://a.com/1", "https://b.com", "https://c.com"]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], "x,\"y"), (2, [], None)], "id int, tags array<string>, t string")
    sinks.export(df, str(tmp_path / "c"), "csv")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert sorted((r.id, r.tags or "", r.t or "") for r in back.collect()) == [("1", "a | b", 'x,"y'), ("2", "", "")]
    sinks.write_json(df, str(tmp_path / "j"), spark.range(1))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and spark.read.json(str(tmp_path / "j.receipt")).count() == 1
    sizes = sinks.write_batches(spark.range(95).select("id"), "id", str(tmp_path / "b"))
    assert {r.batch: r.n for r in sizes.collect()} == {0: 40, 1: 40, 2: 15}
    assert spark.read.json(str(tmp_path / "b" / "batch=2")).count() == 15
    m = sinks.sync_messages(spark.createDataFrame([("s", i) for i in range(120)], "source string, v int"), spark.createDataFrame([("s",), ("t",)], "source string"))
    got = m.groupBy("source", "kind").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    assert {(r.source, r.kind): r.n for r in got} == {("s", "rows"): 120, ("s", "reconcile"): 0, ("t", "reconcile"): 0}
    assert max(r.most for r in got) <= 50


def test_character_references_without_a_semicolon():
    body = "<title>a &amp; b&amp</title>c &lt; &nope; &amp"
    assert markup.parse_page(body)["text"] == "a & b& c < &nope; &"
    assert markup.parse_page(body, ended=True)["text"] == "a & b&amp c < &nope; &amp"
    assert markup.parse_page("<a href='/x?a=1&copy=2'>x</a>", "https://e.com", ended=True)["links"] == [("https://e.com/x?a=1&copy=2", "x")]
