import json

from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from siltstone.streaming import expiry, ingest


def test_absence_expires_after_two_complete_scans(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = StructType([StructField("entity", StringType()), StructField("scan", LongType()), StructField("complete", BooleanType()), StructField("present", BooleanType())])
    rows = [("a", 1, True, True), ("a", 2, True, False), ("a", 3, False, False), ("a", 4, True, False), ("a", 5, True, True), ("b", 1, True, True), ("b", 2, True, False), ("b", 3, True, True)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join(json.dumps(dict(zip(("entity", "scan", "complete", "present"), r))) for r in rows))
    out: list = []
    q = expiry.expire(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.entity, r.scan, r.state) for r in out) == [("a", 4, "expired"), ("a", 5, "returned")]


def test_batch_misses(spark):
    seen = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3)], "e string, i long")
    scans = spark.createDataFrame([(i,) for i in range(1, 6)], "i long")
    assert {r.e: (r.misses, r.expired) for r in expiry.batch_misses(seen, "e", "i", scans).collect()} == {"a": (0, False), "b": (2, True)}


def test_arriving_files_are_handled_once(spark, tmp_path):
    schema = StructType([StructField("key", StringType()), StructField("fp", StringType())])
    (tmp_path / "in").mkdir()
    seen: list = []
    fail = [True]

    def sink(df, epoch):
        rows = [(r.key, r.fp) for r in df.collect()]
        if fail[0]:
            fail[0] = False
            raise RuntimeError("sink is down")
        seen.extend(rows)

    def run():
        stream = ingest.changed_only(ingest.arriving_json(spark, str(tmp_path / "in"), schema), "key", "fp")
        q = ingest.run_batches(stream, sink, str(tmp_path / "cp"))
        try:
            q.awaitTermination(120)
        except Exception:
            pass

    write = lambda n, rows: (tmp_path / "in" / n).write_text("\n".join(json.dumps(dict(zip(("key", "fp"), r))) for r in rows))
    write("a.json", [("k", "1"), ("k", "1"), ("j", "1")])
    run()
    assert seen == []
    run()
    write("b.json", [("k", "1"), ("k", "2")])
    run()
    assert sorted(seen) == [("j", "1"), ("k", "1"), ("k", "2")]


def test_due_retries(spark):
    q = spark.createDataFrame([(i, i) for i in range(10)], "job_id long, next_retry_at long")
    assert [r.job_id for r in ingest.due_retries(q, 7).collect()] == [0, 1, 2, 3, 4, 5]
