"""Training-order materialisation: a keyed Feistel permutation gives each sequence its global slot.

The token stream (documents in block order) is cut into sequences of fixed length. Slot = permuted
sequence number, by cycle-walking a Feistel network on the next even number of bits. Shards hold equal
ranges of slots as raw little-endian ids with a fixed stride, so slot s starts at byte
(s mod per_shard) * stride of shard s div per_shard, and a reader can resume anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.files import read_range, write_file
from siltstone.llm.packing import cut
from siltstone.store import Table, new_folder
from siltstone.llm.tokens import TOKENIZER, token_table, with_base

ROUNDS = 6
READ_BYTES = 256 << 20


@dataclass(frozen=True)
class OrderParams:
    length: int = 2048
    per_shard: int = 2048
    checked: int = 512  # slots under one check sum, read at once
    tasks: int = 4096  # of a pass, at most: each writes a range of shards, one after another
    passes: int = 3  # ranges of slots that are shuffled one after another, to bound the disk in use
    key: int = 0x5EED
    pad: int = 0
    tokenizer: str = TOKENIZER


class FeistelPermutation:
    """A bijection of 0..n-1."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1) % 2**64) for r in range(ROUNDS)]

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        z = x + key
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ self._round(left, key), left
            else:
                left, right = right, left ^ self._round(right, key)
        return (left << np.uint64(self.half)) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        y = self._once(np.asarray(x).astype(np.uint64), back)
        out = np.flatnonzero(y >= self.n)
        while len(out):
            y[out] = self._once(y[out], back)
            out = out[y[out] >= self.n]
        return y.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, False)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def _shard_uri(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def _emit(perm: FeistelPermutation, p: OrderParams, lo: int, hi: int):
    """Parts of the sequences whose shard lies in [lo, hi); neighbouring documents of one sequence stay one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            start, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids = batch.column(2).to_pylist()
            row, a, size = cut(start, n, p.length)
            slot = perm.slot(a // p.length)
            pick = np.flatnonzero((slot // p.per_shard >= lo) & (slot // p.per_shard < hi))
            parts: list[list] = []
            for i in pick.tolist():
                r, at, k = row[i], int(a[i]), int(size[i])
                piece = ids[r][2 * (at - start[r]) : 2 * (at - start[r] + k)]
                if parts and parts[-1][0] == slot[i] and parts[-1][2] == at:
                    parts[-1][2] += k
                    parts[-1][3].append(piece)
                else:
                    parts.append([slot[i], at % p.length, at + k, [piece]])
            slots = np.array([x[0] for x in parts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(slots // p.per_shard, pa.int64()),
                    pa.array(slots, pa.int64()),
                    pa.array([x[1] for x in parts], pa.int64()),
                    pa.array([press.compress(b"".join(x[3])) for x in parts], pa.binary()),
                ],
                names=["shard", "slot", "offset", "part"],
            )

    return run


def _write(folder: str, p: OrderParams, n_slots: int):
    stride = 2 * p.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, data, many = None, bytearray(), 0
        press = zstandard.ZstdDecompressor()

        def flush():
            write_file(_shard_uri(folder, shard), bytes(data))
            row = [[shard], [shard * p.per_shard], [len(data) // stride]]
            sums = [zlib.crc32(data[a : a + p.checked * stride]) for a in range(0, len(data), p.checked * stride)]
            columns = [*(pa.array(x, pa.int64()) for x in row), pa.array([sums], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "first_slot", "n_slots", "crc32"])

        for batch in batches:
            for s, slot, offset, part in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard:
                    if shard is not None:
                        yield flush()
                    shard = s
                    many = min(p.per_shard, n_slots - s * p.per_shard)
                    data = bytearray(p.pad.to_bytes(2, "little") * (many * p.length))
                at = (slot - s * p.per_shard) * stride + 2 * offset
                raw = press.decompress(part)
                data[at : at + len(raw)] = raw
        if shard is not None:
            yield flush()

    return run


@dataclass(frozen=True)
class Materialised:
    folder: str
    shards: DataFrame  # shard, first_slot, n_slots, crc32 (of each `checked` slots)
    n_tokens: int
    params: OrderParams

    @property
    def n_slots(self) -> int:
        return -(-self.n_tokens // self.params.length)


def materialise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", params: OrderParams = OrderParams()) -> Materialised:
    """Write all sequences in training order. A null text gives the end id alone; an empty table gives no shard.

    Repeated rows and equal ids are documents of their own; a very long text runs over many sequences; other
    columns are not read. The last sequence is padded.
    """
    spark = docs.sparkSession
    tokens = token_table(docs, doc_id, text, source, params.tokenizer)
    based, totals = with_base(tokens.df, ["block"])
    n_tokens = int(totals.first()["t"] or 0)
    n_slots = -(-n_tokens // params.length)
    folder = new_folder(spark, "shards")
    perm, n_shards = FeistelPermutation(n_slots, params.key), -(-n_slots // params.per_shard)
    rows = based.selectExpr("base + block_pos start", "n", "ids")
    done, passes = [], max(1, min(params.passes, n_shards))
    schema = "shard long, first_slot long, n_slots long, crc32 array<bigint>"
    for i in range(passes):
        lo, hi = n_shards * i // passes, n_shards * (i + 1) // passes
        parts = rows.mapInArrow(_emit(perm, params, lo, hi), "shard long, slot long, offset long, part binary")
        many = max(1, min(params.tasks, hi - lo))
        dealt = parts.repartitionById(many, F.expr(f"cast((shard - {lo}) * {many} div {max(1, hi - lo)} as int)")).sortWithinPartitions("shard", "slot", "offset")
        done.append(Table(dealt.mapInArrow(_write(folder, params, n_slots), schema), "shard-index").df)
    tokens.drop()
    shards = done[0]
    for more in done[1:]:
        shards = shards.unionByName(more)
    return Materialised(folder, shards, n_tokens, params)


def read_slots(spark: SparkSession, made: Materialised, first: int = 0, last: int | None = None) -> DataFrame:
    """Slots first..last-1, read from the shards by position: slot, sequence_id, shard, byte_offset, n_tokens, ids.

    Reads are of whole checked ranges, and a range that does not match its check sum raises an error.
    """
    p, n_slots, n_tokens, folder = made.params, made.n_slots, made.n_tokens, made.folder
    last = n_slots if last is None else min(last, n_slots)
    perm, stride = FeistelPermutation(n_slots, p.key), 2 * p.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first_slot, many, sums in zip(*(c.to_pylist() for c in batch.columns)):
                lo, hi = max(first, first_slot), min(last, first_slot + many)
                for k in range((lo - first_slot) // p.checked, -(-(hi - first_slot) // p.checked)):
                    begin, end = first_slot + k * p.checked, first_slot + min((k + 1) * p.checked, many)
                    data = read_range(_shard_uri(folder, shard), (begin - first_slot) * stride, (end - begin) * stride)
                    if zlib.crc32(data) != sums[k]:
                        raise ValueError(f"shard {shard}: slots {begin} to {end - 1} do not match their check sum")
                    a, b = max(lo, begin), min(hi, end)
                    data = data[(a - begin) * stride : (b - begin) * stride]
                    slots = np.arange(a, b, dtype=np.int64)
                    seq = perm.sequence(slots)
                    n = np.minimum(p.length, n_tokens - seq * p.length)
                    ids = [data[i * stride : i * stride + 2 * k] for i, k in enumerate(n.tolist())]
                    at = (slots - first_slot) * stride
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(x, pa.int64()) for x in (slots, seq, np.full(b - a, shard), at, n)), pa.array(ids, pa.binary())],
                        names=["slot", "sequence_id", "shard", "byte_offset", "n_tokens", "ids"],
                    )

    index = made.shards.where((F.col("first_slot") < last) & (F.col("first_slot") + F.col("n_slots") > first))
    # A task for each shard while these are few; beyond that each reads about READ_BYTES.
    tasks = max(min(256, -(-n_slots // p.per_shard)), -(-n_slots * stride // READ_BYTES))
    index = index.select("shard", "first_slot", "n_slots", "crc32").repartition(max(1, tasks), "shard")
    return index.mapInArrow(run, "slot long, sequence_id long, shard long, byte_offset long, n_tokens long, ids binary")
