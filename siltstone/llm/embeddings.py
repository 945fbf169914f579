"""Near-duplicate vectors through a pivot-permutation index, verified in double precision.

Each distinct vector is described by its `nearest` reference points (pivots) in order of cosine and is
posted to the inverted list of each. A list of more than `block` vectors is split by second pivots: its
vectors are posted to a list for each pair of their pivots whose lists are both long, so that two vectors
that share two pivots always meet on a list. Two vectors on a list are candidates if they share at least
`shared` pivots, early enough in both orders (a shared pivot counts by the product of `nearest` less its
places, `order` in sum), and their 8-bit sketches agree; lists still long are compared in blocks. Candidates
form groups, and each group is compared exactly, again in blocks, so no pair below the threshold is linked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.graph import connected_components
from siltstone.llm.jaccard import _grouped, _roots
from siltstone.store import Table


@dataclass(frozen=True)
class PivotParams:
    threshold: float = 0.9
    nearest: int = 8  # pivots that describe a vector
    shared: int = 2  # pivots that candidates have in common, at least
    order: int = 16  # of 204 for equal orders
    per_pivot: int = 64  # distinct vectors for which there is one pivot
    pivots: tuple[int, int] = (128, 4096)  # fewest and most pivots of one dimension: the bounded sample of the fit
    slack: float = 0.05  # far above the error of 8-bit sketches
    block: int = 1024
    broadcast_rows: int = 200_000  # of long lists, 16 bytes each


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, sig and unit vector (float64 bytes); both null for a vector that can link with nothing."""
    for batch in batches:
        column = batch.column(1)
        sig: list[bytes | None] = [None] * len(column)
        unit: list[bytes | None] = [None] * len(column)
        length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat, ends = column.flatten(), np.cumsum(length)  # the items of null lists are left out
        holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        whole = (length > 0) & (holes[ends] == holes[ends - length])
        values = flat.cast(pa.float64()).fill_null(0.0).to_numpy()
        for dim in np.unique(length[whole]).tolist():
            at = np.flatnonzero(whole & (length == dim))
            x = values[(ends[at] - dim)[:, None] + np.arange(dim)]
            ok = np.isfinite(x).all(axis=1) & x.any(axis=1)
            at, x = at[ok], x[ok]
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            for i, v in zip(at.tolist(), x):
                unit[i] = v.tobytes()
                sig[i] = hashlib.blake2b(unit[i], digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig, pa.binary()), pa.array(unit, pa.binary())], names=["vec_id", "sig", "v"])


def _describe(pivots: dict[int, np.ndarray], p: PivotParams):
    """dim, rep, perm (pivots in order, nearest first), sketch (8-bit components)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(1).to_pylist()
            rep, length = batch.column(0).to_numpy(), np.array([len(x) // 8 for x in data])
            for dim in np.unique(length).tolist():
                at = np.flatnonzero(length == dim)
                v = np.frombuffer(b"".join(data[i] for i in at.tolist()), dtype=np.float64).reshape(len(at), dim)
                m = min(p.nearest, len(pivots[dim]))
                perm = np.argsort(-(v @ pivots[dim].T), axis=1, kind="stable")[:, :m].astype(np.int32)
                sketch = np.rint(v / np.abs(v).max(axis=1, keepdims=True) * 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), dim, dtype=np.int32)),
                        pa.array(rep[at]),
                        pa.FixedSizeListArray.from_arrays(pa.array(perm.ravel()), m).cast(pa.list_(pa.int32())),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                    ],
                    names=["dim", "rep", "perm", "sketch"],
                )

    return run


def _postings(described: DataFrame, p: PivotParams) -> DataFrame:
    """One row per vector and list it is on: dim, one, two (-1 on the list of one pivot), rep, perm, sketch."""
    alone = described.select("dim", F.explode("perm").alias("one")).groupBy("dim", "one").agg(F.count("*").alias("n"))
    # As many rows as there are pivots: at most pivots[1] of a dimension.
    long = alone.where(F.col("n") > p.block).groupBy("dim").agg(F.collect_set("one").alias("long"))
    known = described.join(F.broadcast(long), "dim", "left").withColumn("long", F.coalesce("long", F.array().cast("array<int>")))
    pair = lambda a, b: F.struct(a.cast("int").alias("one"), b.cast("int").alias("two"))
    short = F.transform(F.array_except("perm", "long"), lambda u: pair(u, F.lit(-1)))
    both = F.array_sort(F.array_intersect("perm", "long"))
    pairs = F.flatten(F.transform(both, lambda u, i: F.transform(F.slice(both, i + 2, F.size(both)), lambda v: pair(u, v))))
    return known.select("dim", F.explode(F.concat(short, pairs)).alias("list"), "rep", "perm", "sketch").select("dim", "list.*", "rep", "perm", "sketch")


def _candidates(p: PivotParams):
    """Candidate links of one block pair of one list, as a star around each group's first member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, i, j), (side, rep, perm, sketch) in _grouped(batches, 5):
            perms = np.array(perm, dtype=np.int32)
            many = perms.shape[1]
            values, inverse = np.unique(perms, return_inverse=True)
            has = np.zeros((len(rep), len(values)), dtype=np.float32)
            has[np.arange(len(rep))[:, None], inverse.reshape(perms.shape)] = many - np.arange(many)
            s = np.frombuffer(b"".join(sketch), dtype=np.int8).reshape(len(rep), -1).astype(np.float32)
            s /= np.sqrt((s * s).sum(axis=1, keepdims=True))
            link = (has @ has.T >= min(p.order, many)) & (s @ s.T >= p.threshold - p.slack)
            has = (has > 0).astype(np.float32)
            link &= has @ has.T >= min(p.shared, many)
            if i != j:
                side = np.array(side)
                link &= side[:, None] != side[None, :]
            root = _roots(link)
            far = np.flatnonzero(root != np.arange(len(rep)))
            ids = np.array(rep)
            yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], names=["a", "b"])

    return run


def _verify(p: PivotParams):
    """Exact links inside one block pair of a group: rep, links (weighted by class size), root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), (side, rep, size, data) in _grouped(batches, 3):
            link = np.zeros((len(rep), len(rep)), dtype=bool)
            length = np.array([len(x) for x in data])
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                v = np.frombuffer(b"".join(data[k] for k in at.tolist()), dtype=np.float64).reshape(len(at), -1)
                link[np.ix_(at, at)] = v @ v.T >= p.threshold
            np.fill_diagonal(link, False)
            if i != j:
                sides = np.array(side)
                link &= sides[:, None] != sides[None, :]
            links, root = link @ np.array(size, dtype=np.int64), np.array(rep)[_roots(link)]
            yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(links, pa.int64()), pa.array(root, pa.int64())], names=["rep", "links", "root"])

    return run


def _in_blocks(df: DataFrame, keys: list[str], rest: list[str], n: int) -> DataFrame:
    """df has `blocks` per key: send each row to the pairs of blocks that its own is part of."""
    side = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = df.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*keys, F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep", *rest)
    return dealt.repartition(n, *keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "rep")


def _fit_pivots(reps: DataFrame, p: PivotParams) -> dict[int, np.ndarray]:
    """The distinct vectors of the smallest hashes are the pivots: one in `per_pivot`, within the bounds of `pivots`."""
    sized = reps.select((F.octet_length("v") / 8).cast("int").alias("dim"), "rep", F.xxhash64("rep").alias("h"))
    counts = {r["dim"]: r["n"] for r in sized.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    want = {d: min(n, max(p.pivots[0], min(p.pivots[1], n // p.per_pivot))) for d, n in counts.items()}
    ranked = sized.withColumn("r", F.row_number().over(W.partitionBy("dim").orderBy("h", "rep"))).where(F.col("r") <= p.pivots[1])
    rows = ranked.join(reps.select("rep", "v"), "rep").select("dim", "r", "v").collect()
    return {d: np.stack([np.frombuffer(r["v"]) for r in sorted(rows, key=lambda r: r["r"]) if r["dim"] == d and r["r"] <= k]) for d, k in want.items()}


def near_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", params: PivotParams = PivotParams()) -> DataFrame:
    """One row per distinct id: vec_id, n_links (other vectors linked directly), component_id, kept. No rows for an empty table.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do
    vectors of different dimension. Rows of one id are one vector: of several values, the one with the
    smallest digest is judged. Rows of a null id are one vector that links with nothing and is kept.
    Vectors of any length are read whole; other columns are not read.
    """
    p, spark = params, df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v")).mapInArrow(_clean, "vec_id long, sig binary, v binary")
    signed = Table(raw.groupBy("vec_id").agg(F.min(F.struct("sig", "v")).alias("s")).select("vec_id", "s.sig", "s.v"), "vectors").df
    able = signed.where("sig is not null and vec_id is not null")
    classes = able.groupBy("sig").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    reps = Table(able.join(classes, "sig").where("vec_id = rep").select("rep", "size", "v"), "distinct-vectors").df
    described = Table(reps.select("rep", "v").mapInArrow(_describe(_fit_pivots(reps, p), p), "dim int, rep long, perm array<int>, sketch binary"), "permutations").df
    keys = ["dim", "one", "two"]
    posts = _postings(described, p)
    sizes = posts.groupBy(*keys).agg(F.ceil(F.count("*") / p.block).cast("int").alias("blocks"))
    heavy = Table(sizes.where("blocks > 1"), "long-lists").df
    heavy = F.broadcast(heavy) if heavy.count() <= p.broadcast_rows else heavy
    sided = posts.join(heavy, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = _in_blocks(sided, keys, ["perm", "sketch"], n)
    comp = connected_components(dealt.mapInArrow(_candidates(p), "a long, b long"))
    comp = Table(comp.select(F.col("node").alias("rep"), F.col("component").alias("comp")), "candidates").df
    blocks = comp.groupBy("comp").agg(F.ceil(F.count("*") / p.block).cast("int").alias("blocks"))
    members = comp.join(blocks, "comp").join(reps, "rep")
    found = Table(_in_blocks(members, ["comp"], ["size", "v"], n).mapInArrow(_verify(p), "rep long, links long, root long"), "links").df
    linked = connected_components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    final = classes.join(links, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    final = final.select("sig", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n"))
    out = signed.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("sig")).alias("sig")).join(final, "sig", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept")
    )
