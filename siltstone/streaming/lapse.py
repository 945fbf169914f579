"""Expiry and retention as a stateful stream of sightings (T1, T3): no row for what a scan does not show.

Entities are dealt to buckets by hash, and a bucket's state lists its entities, each with the scan that showed it last, so a scan costs a few
calls per bucket, not per entity. Event-time timers stand at the scans by which some entity of the bucket has lapsed (the second complete
scan after its last one) and at the ends of retentions, when the state goes. Stored entities enter as initial state.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTPUT = "entity string, scan long, state string"
DAY = 86_400_000


def _processor(complete: Sequence[int], misses: int, keep: int):
    """complete: the numbers of the complete scans, in order. A scan's event time is as many days as its number."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    def due(last: int) -> int | None:
        at = bisect_right(complete, last) + misses - 1
        return complete[at] if at < len(complete) else None

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["entity", "scan", "state"])

    def passed(entity: str, held: tuple[int, bool] | None, now: int) -> tuple[list[tuple], int | None, bool]:
        """What has happened to the entity before scan `now`: rows, its last scan if it is still held, whether it is expired."""
        if held is None:
            return [], None, False
        last, expired = held
        rows, at, end = [], due(last), last + keep
        if not expired and at is not None and at < now and at <= end:
            rows.append((entity, at, "expired"))
            expired = True
        if end < now:
            rows.append((entity, end, "dropped"))
            return rows, None, False
        return rows, last, expired

    class Lapse(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.seen = handle.getListState("seen", "entity string, last long, expired boolean")

        def load(self) -> dict[str, tuple[int, bool]]:
            return {entity: (last, expired) for entity, last, expired in self.seen.get()} if self.seen.exists() else {}

        def store(self, held: dict[str, tuple[int, bool]]) -> None:
            if held:
                self.seen.put([(entity, last, expired) for entity, (last, expired) in held.items()])
            else:
                self.seen.clear()

        def set_timers(self, lasts: Iterable[int]) -> None:
            """Timers for entities last shown by these scans; one that has become needless finds nothing to do."""
            times = set()
            for last in set(lasts):
                at = due(last)
                times |= {last + keep} if at is None or at > last + keep else {at, last + keep}
            for t in times:
                self.handle.registerTimer(t * DAY)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            scans: dict[str, set[int]] = {}
            for pdf in rows:
                for entity, scan in zip(pdf["entity"].tolist(), pdf["scan"].tolist()):
                    scans.setdefault(entity, set()).add(int(scan))
            held, out = self.load(), []
            for entity, shown in scans.items():
                for scan in sorted(shown):
                    before, last, expired = passed(entity, held.get(entity), scan)
                    out += before
                    if expired:
                        out.append((entity, scan, "returned"))
                    if last is None or scan >= last:
                        held[entity] = scan, False
            self.store(held)
            self.set_timers(held[entity][0] for entity in scans)
            yield frame(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = expiredTimerInfo.getExpiryTimeInMs() // DAY
            held, out = self.load(), []
            for entity in list(held):
                rows, last, expired = passed(entity, held[entity], now + 1)
                out += rows
                if last is None:
                    del held[entity]
                else:
                    held[entity] = last, expired
            if out:
                self.store(held)
            yield frame(out)

        def handleInitialState(self, key, initialState, timerValues) -> None:
            held = {e["entity"]: (int(e["last"]), False) for listed in initialState["entities"] for e in listed}
            self.store(held)
            self.set_timers(last for last, _ in held.values())

        def close(self) -> None:
            pass

    return Lapse()


def lapses(stream: DataFrame, stored: DataFrame, complete: Sequence[int], misses: int = 2, keep: int = 14, buckets: int = 64) -> DataFrame:
    """stream: entity, scan (sightings, scans in order); stored: entity, last. Returns entity, scan, state: expired, returned, dropped.

    An entity expires at the `misses`-th complete scan after the last one that showed it, is dropped `keep` scans after that one, and
    returns if a later scan shows it in between; after it was dropped it is new. Incomplete scans count for nothing.
    Several sightings in a scan are one. A lapse is reported once the scans have come that far. Needs the RocksDB state store.
    buckets: a task holds a bucket's entities at once, so some thousands of them make a good bucket; fixed once a checkpoint is begun.
    """
    bucket = F.pmod(F.xxhash64("entity"), F.lit(buckets)).alias("bucket")
    timed = stream.where("entity is not null and scan is not null").select(bucket, "entity", "scan", F.timestamp_millis(F.col("scan") * DAY).alias("ts")).withWatermark("ts", "0 seconds")
    last = stored.where("entity is not null").groupBy("entity").agg(F.max("last").cast("long").alias("last"))
    first = last.groupBy(bucket).agg(F.collect_list(F.struct("entity", "last")).alias("entities")).groupBy("bucket")
    return timed.groupBy("bucket").transformWithStateInPandas(_processor(list(complete), misses, keep), OUTPUT, "Append", "EventTime", initialState=first)
