"""Absence-based expiry: entities that complete scans no longer show."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSES = 2


def batch_misses(seen: DataFrame, entity: str, scan: str, scans: DataFrame, limit: int = MISSES) -> DataFrame:
    """entity, last_scan, misses (complete scans after it), expired. scans: the numbers of the complete scans."""
    last = seen.groupBy(entity).agg(F.max(scan).alias("last_scan"))
    # One row: the complete scans in order, so that those after the last one are counted by position.
    complete = scans.agg(F.sort_array(F.collect_set(scan)).alias("__scans"))
    out = last.crossJoin(F.broadcast(complete)).withColumn("misses", F.size(F.filter("__scans", lambda x: x > F.col("last_scan"))))
    return out.select(entity, "last_scan", F.col("misses").cast("bigint").alias("misses"), (F.col("misses") >= limit).alias("expired"))


OUTPUT = "entity string, scan long, misses long, state string"


def expiry_processor(limit: int = MISSES):
    """A stateful processor of rows (entity, scan, complete, present), grouped by entity.

    A complete scan that does not show the entity adds a miss, an incomplete one never does, and
    reappearance resets the counter. Emits `expired` when the limit is reached and `returned` afterwards.
    """
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class Expiry(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.misses = handle.getValueState("misses", "n long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            n = self.misses.get()[0] if self.misses.exists() else 0
            out = []
            for pdf in rows:
                for r in pdf.sort_values("scan").itertuples():
                    if r.present:
                        if n >= limit:
                            out.append((key[0], r.scan, 0, "returned"))
                        n = 0
                    elif r.complete:
                        n += 1
                        if n == limit:
                            out.append((key[0], r.scan, n, "expired"))
            self.misses.update((n,))
            yield pd.DataFrame(out, columns=["entity", "scan", "misses", "state"])

        def close(self) -> None:
            pass

    return Expiry()


def expire(stream: DataFrame, limit: int = MISSES) -> DataFrame:
    """stream: entity, scan, complete, present. Needs the RocksDB state store provider."""
    return stream.groupBy("entity").transformWithStateInPandas(expiry_processor(limit), OUTPUT, "Update", "None")
