"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Each queue (source) is cut into quanta. A queue of weight w earns credit at rate w and serves its next
quantum once its deficit reaches one, so quantum c of a queue of weight w is due at time c/w. The
place of a quantum in the output is the number of tokens of all quanta due before it, which needs only
the queues' totals and weights: no task waits for another, and what a window or a partition falls short
of a queue's share is carried on exactly. Every sequence but the last is full.

Up to MAX_QUEUES queues, tasks compute the places from the totals; beyond, the same places come from a
table of all quanta in the order in which they are due.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.tokens import TOKENIZER, token_table, with_base
from siltstone.store import Table

WEIGHT_SUM = 1_000_000
MAX_QUEUES = 4096  # queues whose totals go to every task
_EXPLODED = 1 << 16


@dataclass(frozen=True)
class PackingParams:
    length: int = 2048
    quantum: int = 256
    tokenizer: str = TOKENIZER


def integer_weights(totals: dict[str, int], mixture: dict[str, float] | None, temper: float = 1.0) -> dict[str, int]:
    """Weights in millionths, 1 at least; by default the queues' own shares, tempered. Queues a mixture leaves out come last, at weight 1."""
    shares = {q: (mixture.get(q, 0.0) if mixture else float(t) ** temper) for q, t in totals.items()}
    whole = sum(shares.values()) or 1
    return {q: max(1, round(WEIGHT_SUM * s / whole)) for q, s in shares.items()}


class Schedule:
    """Where each quantum of each queue goes. Queues are ordered by name."""

    def __init__(self, totals: dict[str, int], weights: dict[str, int], quantum: int):
        self.names = sorted(totals)
        self.index = {q: i for i, q in enumerate(self.names)}
        self.totals = np.array([totals[q] for q in self.names], dtype=np.int64)
        self.weights = np.array([weights[q] for q in self.names], dtype=np.int64)
        self.quanta = -(-self.totals // quantum)
        self.quantum = quantum

    def start(self, queue: np.ndarray, quantum: np.ndarray) -> np.ndarray:
        """Tokens of the output before the given quanta."""
        at = np.zeros(len(queue), dtype=np.int64)
        own = self.weights[queue]
        for s in range(len(self.names)):
            due = quantum * self.weights[s]
            before = np.where(s < queue, due // own + 1, -(-due // own))
            before = np.where(s == queue, quantum, before)
            at += np.minimum(np.minimum(before, self.quanta[s]) * self.quantum, self.totals[s])
        return at


def cut(start: np.ndarray, n: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut intervals [start, start + n) at the multiples of step: (row, start, length) of each part."""
    first, last = start // step, (start + n - 1) // step
    parts = last - first + 1
    row = np.repeat(np.arange(len(start)), parts)
    k = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts) + first[row]
    a = np.maximum(start[row], k * step)
    b = np.minimum(start[row] + n[row], (k + 1) * step)
    return row, a, b - a


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def weight_table(totals: DataFrame, mixture: dict[str, float] | None, temper: float = 1.0) -> DataFrame:
    """`integer_weights` of a table (queue, t), as its column w."""
    shares = totals.withColumn("s", F.pow(F.col("t").cast("double"), F.lit(temper)))
    if mixture:
        given = totals.sparkSession.createDataFrame([(q, float(s)) for q, s in mixture.items()], "queue string, s double")
        shares = totals.join(given, "queue", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    whole = shares.agg(F.sum("s")).first()[0] or 1.0
    return shares.select("queue", "t", F.greatest(F.lit(1), F.bround(F.lit(float(WEIGHT_SUM)) * F.col("s") / F.lit(whole))).cast("long").alias("w"))


def place_table(totals: DataFrame, mixture: dict[str, float] | None, quantum: int, temper: float = 1.0) -> DataFrame:
    """queue, c (quantum), place: `Schedule.start` of every quantum, by one distributed sort.

    Due times c/w are compared by whole part and remainder; fractions of weights up to WEIGHT_SUM are apart
    by more than a double's precision.
    """
    n = f"(t + {quantum - 1}) div {quantum}"
    blocks = weight_table(totals, mixture, temper).selectExpr("*", f"explode(sequence(0L, {n} - 1, {_EXPLODED}L)) first")
    quanta = blocks.selectExpr("queue", "t", "w", f"explode(sequence(first, least(first + {_EXPLODED}, {n}) - 1)) c")
    order = ["due", "part", "queue"]
    due = quanta.selectExpr("queue", "c", f"least({quantum}, t - c * {quantum}) size", "c div w due", "(c % w) / w part").orderBy(*order)
    due = Table(due.withColumn("slice", F.spark_partition_id()), "quanta").df
    ahead = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    slices = due.groupBy("slice").agg(F.sum("size").alias("k"))
    slices = slices.select("slice", F.coalesce(F.sum("k").over(ahead(W.orderBy("slice"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("size").over(ahead(W.partitionBy("slice").orderBy(*order))), F.lit(0))
    return due.withColumn("inside", inside).join(F.broadcast(slices), "slice").selectExpr("queue", "c", "base + inside place")


def with_places(rows: DataFrame, places: DataFrame, quantum: int) -> DataFrame:
    """Add the places of each row's quanta, in order. A row is known by its queue and start."""
    parts = rows.selectExpr("queue", "start", f"explode(sequence(start div {quantum}, (start + n - 1) div {quantum})) c").join(places, ["queue", "c"])
    lists = parts.groupBy("queue", "start").agg(F.sort_array(F.collect_list(F.struct("c", "place")))["place"].alias("places"))
    return rows.join(lists, ["queue", "start"]).select("doc_id", "places", "start", "n", "ids")


def _place(schedule: Schedule | None, quantum: int, length: int):
    """Pieces of rows: with a schedule the second column is the queue, without one it is the places of the row's quanta."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, known, start, n, ids = (batch.column(i) for i in range(5))
            start, n = start.to_numpy(), n.to_numpy()
            row, a, size = cut(start, n, quantum)
            if schedule is None:
                place = known.flatten().to_numpy() + a % quantum
            else:
                q = np.array([schedule.index[x] for x in known.to_pylist()], dtype=np.int64)
                place = schedule.start(q[row], a // quantum) + a % quantum
            inside = a - start[row]
            joined = np.zeros(len(row), dtype=bool)
            joined[1:] = (row[1:] == row[:-1]) & (place[1:] == place[:-1] + size[:-1])
            heads = np.flatnonzero(~joined)
            size = np.add.reduceat(size, heads) if len(heads) else size
            row, place, inside = row[heads], place[heads], inside[heads]
            piece, at, size = cut(place, size, length)
            inside = inside[piece] + at - place[piece]
            row = row[piece]
            data = [np.frombuffer(x, dtype="<u2").astype("<u4") for x in ids.to_pylist()]
            crc = [zlib.crc32(data[r][i : i + k]) for r, i, k in zip(row.tolist(), inside.tolist(), size.tolist())]
            columns = [doc_id.take(pa.array(row)), inside, size, crc, n[row], at // length, at % length]
            yield pa.RecordBatch.from_arrays(
                [columns[0], *[pa.array(c, pa.int64()) for c in columns[1:]]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    mixture: dict[str, float] | None = None,
    temper: float = 1.0,
    params: PackingParams = PackingParams(),
) -> DataFrame:
    """Pieces of documents in packed sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences are filled from offset 0 without gaps; only the last may be short. A null text is empty and
    gives the end id alone; a very long text is cut over many sequences; a null source is a queue of its own;
    repeated rows and equal ids are documents of their own; other columns are not read. An empty table gives
    no pieces. `mixture` gives sources their share of every window, for as long as they last; the sources it
    leaves out, and what is left of the others, follow. Without one, a source of t tokens has a share in
    proportion to t ** temper: its own by default, and below 1 more for small sources, for as long as they last.
    """
    tokens = token_table(docs, doc_id, text, source, params.tokenizer)
    based, totals = with_base(tokens.df, ["queue", "block"])
    rows = based.selectExpr("doc_id", "queue", "base + queue_pos start", "n", "ids")
    first = {r["queue"]: r["t"] for r in totals.limit(MAX_QUEUES + 1).collect()}
    if len(first) > MAX_QUEUES:
        schedule, rows = None, with_places(rows, place_table(totals, mixture, params.quantum, temper), params.quantum)
    else:
        schedule = Schedule(first, integer_weights(first, mixture, temper), params.quantum)
    return rows.mapInArrow(_place(schedule, params.quantum, params.length), _SCHEMA)
