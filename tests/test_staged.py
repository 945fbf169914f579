"""Staged pages: odd pages, gaps in the offsets, pages that come late, a restart of the stream."""

import json

from siltstone.sources import staged
from siltstone.streaming import ingest


def put(folder, name, board, offset, n, total=1000, term=0, tag="t", first=0):
    page = {"board": board, "term": term, "offset": offset, "total": total, "jobPostings": [{"title": f"{tag}{i}", "externalPath": f"/p/{first + i}", "locationsText": None} for i in range(n)]}
    (folder / name).write_text(json.dumps(page))


def test_pages_as_a_client_reads_them(spark, tmp_path):
    put(tmp_path, "a0.json", "a", 0, 3)
    put(tmp_path, "a3.json", "a", 3, 3, tag="u", first=2)
    put(tmp_path, "a6.json", "a", 6, 2, first=10)
    put(tmp_path, "a9.json", "a", 9, 3, first=20)  # behind a short page
    put(tmp_path, "b3.json", "b", 3, 3)  # the first page is missing
    put(tmp_path, "c0.json", "c", 0, 3, total=3)
    put(tmp_path, "c3.json", "c", 3, 3, first=30)  # behind the total
    put(tmp_path, "d0.json", "d", 0, 0)
    put(tmp_path, "e0.json", "e", 0, 2, term=0)
    put(tmp_path, "e1.json", "e", 0, 1, term=1, tag="later")
    (tmp_path / "x.json").write_text("{broken")
    (tmp_path / "y.json").write_text("[]")
    (tmp_path / "_z.json").write_text("no page")
    pages = staged.read_pages(spark, f"file://{tmp_path}")
    assert pages.rdd.getNumPartitions() == 12 and pages.where("error is not null").count() == 2
    got = sorted((r.board, r.path, r.title) for r in staged.board_postings(pages, 3).collect())
    assert got == [("a", "/p/0", "t0"), ("a", "/p/1", "t1"), ("a", "/p/10", "t0"), ("a", "/p/11", "t1"), ("a", "/p/2", "u0"), ("a", "/p/3", "u1"), ("a", "/p/4", "u2"), ("c", "/p/0", "t0"), ("c", "/p/1", "t1"), ("c", "/p/2", "t2"), ("e", "/p/0", "later0"), ("e", "/p/1", "t1")]
    assert staged.read_pages(spark, f"file://{tmp_path}/none").count() == 0


def test_stream_takes_each_page_once(spark, tmp_path):
    made, out = tmp_path / "in", []
    made.mkdir()

    def run():
        q = ingest.run_batches(staged.stream_pages(spark, f"file://{made}"), lambda b, _: out.extend(r.file for r in b.collect()), str(tmp_path / "cp"))
        q.awaitTermination(120)

    put(made, "m.json", "a", 0, 1)
    run()
    put(made, "a.json", "a", 1, 2)  # sorts before what was taken
    run()
    run()
    assert out == ["m.json", "a.json", "a.json"]


def test_many_pages_in_a_file_and_many_files_in_a_task(spark, tmp_path, monkeypatch):
    page = lambda board, offset, n: {"board": board, "offset": offset, "total": 900, "jobPostings": [{"title": f"t{i}", "externalPath": f"/p/{offset + i}"} for i in range(n)]}
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(page("a", 2 * i, 2)) for i in range(250)) + "\n\nno page\n")
    (tmp_path / "whole.json").write_text(json.dumps(page("b", 0, 1), indent=2))
    (tmp_path / "late.json").write_text("broken\n" + json.dumps(page("c", 0, 2)))
    (tmp_path / "none.json").write_text("")
    for i in range(30):
        put(tmp_path, f"p{i:02}.json", "d", i, 1, first=i)
    monkeypatch.setattr(staged, "MOST_TASKS", 7)
    pages = staged.read_pages(spark, f"file://{tmp_path}")
    sizes = {r.board: (r.n, r.bad) for r in pages.selectExpr("coalesce(board, '') as board", "path", "error").groupBy("board").agg({"path": "count", "error": "count"}).toDF("board", "n", "bad").selectExpr("board", "n", "bad").collect()}
    assert {b: sum(x) for b, x in sizes.items()} == {"a": 500, "b": 1, "c": 2, "d": 30, "": 3}
    assert [len(p.files) for p in staged._dealt([str(i) for i in range(34)])] == [5] * 6 + [4]
    assert staged.board_postings(pages, 2).where("board = 'a'").count() == 500
