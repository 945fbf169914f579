"""The stateful stream of lapses against a walk over the scans, with a restart in between."""

import random

from siltstone.store import settings
from siltstone.streaming import ingest, lapse

ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "2"}


def walk(sightings, stored, complete, keep):
    out = []
    for e in {e for e, _ in sightings} | set(stored):
        seen = sorted({s for x, s in sightings if x == e} | ({stored[e]} if e in stored else set()))
        for s, n in zip(seen, [*seen[1:], None]):
            later = [c for c in complete if c > s]
            at = later[1] if len(later) > 1 else None
            expired = at is not None and at <= s + keep and (n is None or n > at)
            dropped = n is None or n > s + keep
            out += [(e, at, "expired")] * expired + [(e, s + keep, "dropped")] * dropped + ([(e, n, "returned")] if expired and not dropped else [])
    return sorted(out)


def test_lapses_with_a_restart(spark, tmp_path):
    rng = random.Random(4)
    complete = [2, 3, 5, 7, 8]
    stored = {"e1": 1, "e30": 1, "old": 0}
    sightings = [(f"e{i}", s) for i in range(25) for s in range(2, 9) if rng.random() < 0.35]
    made = str(tmp_path / "in")
    out = str(tmp_path / "out")

    def put(scan, rows):
        spark.createDataFrame(rows, "entity string, scan long").coalesce(1).write.mode("append").json(made)

    def run():
        stream = ingest.arriving_json(spark, made, spark.createDataFrame([], "entity string, scan long").schema, 1).drop("file")
        states = lapse.lapses(stream, spark.createDataFrame(list(stored.items()), "entity string, last long"), complete, keep=4)
        q = states.writeStream.foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(200)

    with settings(spark, ROCKS):
        for s in range(2, 6):
            put(s, [x for x in sightings if x[1] == s] * 2)
        run()
        for s in range(6, 9):
            put(s, [x for x in sightings if x[1] == s])
        for end in (1000, 2000):
            put(end, [("~end", end)])
        run()
    got = sorted((r.entity, r.scan, r.state) for r in spark.read.parquet(out).collect() if r.entity != "~end")
    assert got == walk(sightings, stored, complete, 4)
    assert {"expired", "returned", "dropped"} <= {s for _, _, s in got}


def test_thousands_of_entities_in_two_buckets(spark, tmp_path):
    rng = random.Random(5)
    sightings = [(f"e{i}", s) for i in range(3000) for s in (1, 2, 3) if rng.random() < 0.4]
    stored = {f"e{i}": 0 for i in range(0, 4000, 7)}
    out = str(tmp_path / "out")
    for s in range(1, 9):
        rows = [x for x in sightings if x[1] == s] + [("~scan", s)]
        spark.createDataFrame(rows, "entity string, scan long").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    with settings(spark, ROCKS):
        stream = ingest.arriving_json(spark, str(tmp_path / "in"), spark.createDataFrame([], "entity string, scan long").schema, 1).drop("file")
        states = lapse.lapses(stream, spark.createDataFrame(list(stored.items()), "entity string, last long"), [1, 2, 3, 4, 5], keep=3, buckets=2)
        q = ingest.run_batches(states, lambda b, _: b.write.mode("append").parquet(out), str(tmp_path / "cp"))
        q.awaitTermination(200)
    got = sorted((r.entity, r.scan, r.state) for r in spark.read.parquet(out).collect() if r.entity != "~scan")
    assert got == walk(sightings, stored, [1, 2, 3, 4, 5], 3)
