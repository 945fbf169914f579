import gzip
import hashlib

from siltstone.llm.files import read_range
from siltstone.llm.warc import WarcParams, parse, read_records, write_archive

BIG, SMALL = "<p>é</p>" * 200, "<p>x</p>"
ROWS = [
    (1, "http://a/1", BIG, "d"),
    (2, "http://a/2 b\r\né", BIG, "d"),
    (3, None, None, "d"),
    (4, "u", SMALL, "d"),
    (5, "u", SMALL, "d"),
    (6, "u", "", "d"),
    (7, "u", "\r\n\r\nWARC/1.0\r\n" * 200, "d"),
    (9, "v", BIG, "d"),
    (9, "v", BIG, "d"),
    (None, "n", BIG, "d"),
]
SCHEMA = "page_id long, url string, html string, digest string"


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    archive = write_archive(df, params=WarcParams(file_bytes=600, read_bytes=500))
    got = read_records(archive).collect()
    assert len(got) == len(ROWS)
    payloads = {(r.page_id, r.url): (r.html or "").encode() for r in df.na.fill("", ["url"]).collect()}
    for r in got:
        want = payloads[r.page_id, r.url]
        assert (r.payload_bytes, r.payload_digest) == (len(want), hashlib.sha1(want).hexdigest())
        revisit = want == BIG.encode() and r.page_id != 9
        assert (r.record_type, r.refers_to) == (("revisit", 9) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == want


def test_index_reads_selected_records_alone(spark):
    archive = write_archive(spark.createDataFrame(ROWS, SCHEMA).coalesce(1))
    picked = archive.index.where("page_id in (4, 6)")
    assert sorted(r.page_id for r in read_records(archive, picked).collect()) == [4, 6]
    one = archive.index.where("page_id = 7").first()
    head, block = parse(read_range(f"{archive.folder}/{one.file}", one.offset, one.length))
    assert head["WARC-Type"] == "response" and block.endswith(b"WARC/1.0\r\n")
    whole = gzip.decompress(read_range(f"{archive.folder}/{one.file}", 0, 1 << 30))
    assert whole.count(b"WARC-Record-ID") == len(ROWS) + 1


def test_empty_table(spark):
    assert read_records(write_archive(spark.createDataFrame([], SCHEMA))).count() == 0


def test_very_long_pages(spark):
    rows = [(1, "u", "é<p>" * 2_000_000, "d"), (2, "v", "é<p>" * 2_000_000, "d"), (3, "w", "x" * 3_000_000, "d"), (4, "x", "short", "d")]
    archive = write_archive(spark.createDataFrame(rows, SCHEMA), params=WarcParams(file_bytes=1000, read_bytes=1000))
    got = {r.page_id: r for r in read_records(archive).collect()}
    assert {i: (r.record_type, r.refers_to, r.payload_bytes) for i, r in got.items()} == {
        1: ("revisit", 2, 10_000_000), 2: ("response", None, 10_000_000), 3: ("response", None, 3_000_000), 4: ("response", None, 5),
    }
    assert bytes(got[2].payload) == rows[1][2].encode()


def test_many_repeated_payloads_are_joined_by_shuffle(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    of = lambda p: sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_digest) for r in read_records(write_archive(df, params=p)).collect())
    assert of(WarcParams()) == of(WarcParams(broadcast_rows=-1))
