"""Chosen-path similarity join on word shingles, followed by exact verification.

Every document becomes the set of its five-word shingles, a vector of minhashes and a sketch. A run starts
with all documents in one node; a node picks one or two coordinates (1.25 on average, the inverse of the
threshold) and each document goes to the child named by its minhash there. Nodes of at most `leaf`
documents are compared by brute force on the sketches, larger ones split again. A node still large at
`max_depth` is compared with its smallest document first; what is not near that one is compared with the
whole node, in blocks. Runs repeat until the expected recall is far above 0.99. What the runs join is
verified on the whole sets in blocks, so no link below the threshold is reported.

A sketch has a byte for each of 256 bins of a shingle hash, from the smallest hash of its bin: the share of
equal bytes among the bins that either set fills estimates the similarity with a deviation of 0.025 at
most, so documents that share much boilerplate but not four fifths do not chain up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.graph import connected_components
from siltstone.store import Table
from siltstone.llm.words import chunks, hash_words, mix, ngrams
from siltstone.names import column, fresh


@dataclass(frozen=True)
class JoinParams:
    shingle: int = 5
    threshold: float = 0.8
    hashes: int = 64
    runs: int = 10
    leaf: int = 64
    max_depth: int = 4
    slack: float = 0.1  # pairs whose estimate is this far below the threshold are not verified: 4 deviations
    broadcast_rows: int = 100_000  # leaders of large nodes, under 300 bytes each
    block: int = 1024  # documents on a side of a verified block
    seed: int = 11


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Under k words, all words are the one shingle; none: empty."""
    for a, b in chunks(texts):
        words, counts = hash_words(texts[a:b])
        grams, at = ngrams(words, k), 0
        for n in counts.tolist():
            if n >= k:
                yield np.unique(grams[at : at + n - k + 1])
            else:
                yield ngrams(words[at : at + n], n) if n else words[:0]
            at += n


BINS = 256


def sketch(s: np.ndarray) -> bytes:
    """One byte per bin, 0 where the set has no hash in it."""
    h = mix(s + np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort((h << np.uint64(56)) | (h >> np.uint64(8)))
    bins = (ordered >> np.uint64(56)).astype(np.int64)
    first = np.ones(len(bins), dtype=bool)
    first[1:] = bins[1:] != bins[:-1]
    out = np.zeros(BINS, dtype=np.uint8)
    out[bins[first]] = (ordered[first] & np.uint64(0xFFFF)) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def _sketches(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), dtype=np.uint8).reshape(-1, BINS)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarities of all sketches of a with all of b."""
    neither = (a == 0).astype(np.float32) @ (b == 0).astype(np.float32).T
    same = np.zeros((len(a), len(b)), dtype=np.int16)
    for k in range(BINS):
        same += a[:, k, None] == b[None, :, k]
    return (same - neither) / np.maximum(1, BINS - neither)


def _signatures(p: JoinParams):
    rng = np.random.default_rng(p.seed)
    scale = (rng.integers(0, 2**63, p.hashes).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
    shift = rng.integers(0, 2**63, p.hashes).astype(np.uint64)

    def minhash(s: np.ndarray) -> bytes:
        low = np.full(p.hashes, 2**64 - 1, dtype=np.uint64)
        for a in range(0, len(s), 4096):
            low = np.minimum(low, (s[None, a : a + 4096] * scale[:, None] + shift[:, None]).min(axis=1))
        return (low >> np.uint64(32)).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (hashlib.blake2b(s.tobytes(), digest_size=16).digest(), minhash(s), sketch(s)) if len(s) else (None, None, None)
                for s in shingle_sets(batch.column(1).to_pylist(), p.shingle)
            ]
            columns = zip(*rows) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in columns)], names=["doc_id", "sig", "mh", "sketch"])

    return run


def _choose(keys: np.ndarray, p: JoinParams) -> tuple[np.ndarray, np.ndarray]:
    """The coordinates that the nodes of these keys pick: the first, and the second or -1."""
    r = mix(keys + np.uint64(p.seed))
    first = r % np.uint64(p.hashes)
    step = (r >> np.uint64(16)) % np.uint64(p.hashes - 1) + np.uint64(1)
    twice = (r >> np.uint64(40)) % np.uint64(1000) < np.uint64(round(1000 * (1 / p.threshold - 1)))
    second = np.where(twice, (first + step) % np.uint64(p.hashes), np.uint64(p.hashes))
    return first.astype(np.int64), second.astype(np.int64)


def _children(p: JoinParams, root: bool):
    """(key, rep) of each child; at the root each document enters once per run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mh = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u4").reshape(-1, p.hashes)
            rep = np.asarray(batch.column(0).to_numpy())
            if root:
                rows = np.tile(np.arange(len(rep)), p.runs)
                keys = np.repeat(mix(np.arange(1, p.runs + 1, dtype=np.uint64)), len(rep))
            else:
                rows, keys = np.arange(len(rep)), batch.column(2).to_numpy().view(np.uint64)
            out_rows, out_keys = [], []
            for pick in _choose(keys, p):
                ok = np.flatnonzero(pick < p.hashes)
                value = mh[rows[ok], pick[ok]].astype(np.uint64)
                out_keys.append(mix(mix(keys[ok] ^ (pick[ok] + 1).astype(np.uint64)) + value))
                out_rows.append(rows[ok])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out_keys).view(np.int64)), pa.array(rep[np.concatenate(out_rows)])], names=["key", "rep"]
            )

    return run


def _roots(link: np.ndarray) -> np.ndarray:
    """For a symmetric 0/1 matrix, the index of the first member of each row's component."""
    n = len(link)
    root = np.arange(n)
    while True:
        low = np.where(link, root[None, :], n).min(axis=1)
        new = np.minimum(root, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of equal leading columns of sorted batches, as (key, columns of the rest)."""
    now, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        heads = list(zip(*columns[:keys]))
        a = 0
        while a < len(heads):
            b = a
            while b < len(heads) and heads[b] == heads[a]:
                b += 1
            if heads[a] != now:
                if now is not None:
                    yield now, held
                now, held = heads[a], [[] for _ in columns[keys:]]
            for h, c in zip(held, columns[keys:]):
                h.extend(c[a:b])
            a = b
    if now is not None:
        yield now, held


def _stars(rep: np.ndarray, link: np.ndarray) -> pa.RecordBatch:
    """Each group of a symmetric 0/1 matrix as a star around its first member."""
    root = _roots(link)
    far = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(rep[far], pa.int64()), pa.array(rep[root[far]], pa.int64())], names=["a", "b"])


def _compare_leaves(p: JoinParams):
    """Links of each leaf on the sketches, as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for _, (rep, data) in _grouped(batches, 1):
            v = _sketches(data)
            neither = (v == 0).astype(np.float32)
            neither = neither @ neither.T
            same = (v[:, None, :] == v[None, :, :]).sum(axis=2, dtype=np.int16)
            held.append(_stars(np.array(rep), same - neither >= (p.threshold - p.slack) * np.maximum(1, BINS - neither)))
            if len(held) >= 1000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _near_leader(p: JoinParams):
    """key, rep, low, near: whether the sketch is near that of the node's smallest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, lead = _sketches(batch.column(3).to_pylist()), _sketches(batch.column(4).to_pylist())
            neither = ((v == 0) & (lead == 0)).sum(axis=1)
            near = (v == lead).sum(axis=1) - neither >= (p.threshold - p.slack) * np.maximum(1, BINS - neither)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(near)], names=["key", "rep", "low", "near"])

    return run


def _compare_blocks(p: JoinParams):
    """Links of one block of far documents with one block of the whole node, as stars. Far ones come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (far, rep, data) in _grouped(batches, 3):
            v, n = _sketches(data), int(sum(far))
            link = np.zeros((len(rep), len(rep)), dtype=bool)
            link[:n, n:] = estimates(v[:n], v[n:]) >= p.threshold - p.slack
            link |= link.T
            yield _stars(np.array(rep), link)

    return run


def _large_nodes(nodes: DataFrame, reps: DataFrame, p: JoinParams) -> DataFrame:
    """nodes: key, rep, low (the node's smallest rep). Star edges; all but what is near the smallest is compared in blocks."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaders = nodes.select("key", "low").distinct().join(reps.select(F.col("rep").alias("low"), F.col("sketch").alias("lead")), "low").select("key", "lead")
    leaders = Table(leaders, "leaders").df
    leaders = F.broadcast(leaders) if leaders.count() <= p.broadcast_rows else leaders
    full = nodes.join(reps.select("rep", "sketch"), "rep").join(leaders, "key").select("key", "rep", "low", "sketch", "lead")
    judged = Table(full.mapInArrow(_near_leader(p), "key long, rep long, low long, near boolean"), "near-leader").df
    stars = judged.where("near and rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    sizes = judged.groupBy("key").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("f")).where("f > 0")
    blocks = lambda c: F.ceil(F.col(c) / p.block).cast("int")
    sided = judged.join(sizes.select("key", blocks("n").alias("whole"), blocks("f").alias("far")), "key").join(reps.select("rep", "sketch"), "rep")
    place = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    far = sided.where("not near").select("key", place("far").alias("i"), every("whole").alias("j"), F.lit(1).alias("side"), "rep", "sketch")
    whole = sided.select("key", every("far").alias("i"), place("whole").alias("j"), F.lit(0).alias("side"), "rep", "sketch")
    dealt = far.unionByName(whole).repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", F.desc("side"), "rep")
    return stars.unionByName(dealt.mapInArrow(_compare_blocks(p), "a long, b long"))


def candidate_links(reps: DataFrame, p: JoinParams) -> DataFrame:
    """reps: rep, mh, sketch. Star edges (a, b) of the groups that any run joins."""
    spark = reps.sparkSession
    level = Table(reps.select("rep", "mh").mapInArrow(_children(p, True), "key long, rep long"), "paths").df
    stars, leaves = [], []
    for depth in range(1, p.max_depth + 1):
        sizes = Table(level.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("low")).where("n > 1"), "path-sizes").df
        leaves.append(level.join(sizes.where(F.col("n") <= p.leaf).select("key"), "key"))
        large = sizes.where(F.col("n") > p.leaf)
        if large.isEmpty():
            break
        if depth == p.max_depth:
            stars.append(_large_nodes(Table(level.join(large, "key").select("key", "rep", "low"), "large-nodes").df, reps, p))
        else:
            again = level.join(large.select("key"), "key").join(reps.select("rep", "mh"), "rep").select("rep", "mh", "key")
            level = Table(again.mapInArrow(_children(p, False), "key long, rep long"), "paths").df
    small = leaves[0]
    for more in leaves[1:]:
        small = small.unionByName(more)
    full = small.join(reps.select("rep", "sketch"), "rep").select("key", "rep", "sketch")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stars.append(full.repartition(n, "key").sortWithinPartitions("key", "rep").mapInArrow(_compare_leaves(p), "a long, b long"))
    edges = stars[0]
    for more in stars[1:]:
        edges = edges.unionByName(more)
    return edges.distinct()


def _verify(p: JoinParams):
    """Exact links inside one block pair: rep, links (weighted by class size), root (first member of its group)."""

    def overlaps(sets: list[np.ndarray]) -> np.ndarray:
        token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        values, inverse, count = np.unique(token, return_inverse=True, return_counts=True)
        shared = count > 1
        column = np.cumsum(shared) - 1
        keep = shared[inverse]
        row, col = owner[keep], column[inverse[keep]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        out = np.zeros((len(sets), len(sets)), dtype=np.float32)
        step = 4096
        bounds = np.searchsorted(col, np.arange(0, int(shared.sum()) + step, step))
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            m = np.zeros((len(sets), step), dtype=np.float32)
            m[row[a:b], col[a:b] - k * step] = 1
            out += m @ m.T
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), (side, rep, size, data) in _grouped(batches, 3):
            once = [k for k, r in enumerate(rep) if not k or rep[k - 1] != r]  # an input row may repeat
            side, rep, size, data = ([c[k] for k in once] for c in (side, rep, size, data))
            sets = [np.frombuffer(x, dtype="<u8") for x in data]
            n = np.array([len(s) for s in sets], dtype=np.float64)
            both = overlaps(sets).astype(np.float64)
            link = both >= p.threshold * (n[:, None] + n[None, :] - both) - 1e-9
            np.fill_diagonal(link, False)
            if i != j:
                side = np.array(side)
                link &= side[:, None] != side[None, :]
            links = link @ np.array(size, dtype=np.int64)
            root = np.array(rep)[_roots(link)]
            yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(links, pa.int64()), pa.array(root, pa.int64())], names=["rep", "links", "root"])

    return run


def _sets(p: JoinParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), p.shingle)]
            sig = [hashlib.blake2b(x, digest_size=16).digest() for x in data]
            ok = [a == b for a, b in zip(sig, batch.column(2).to_pylist())]
            made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), batch.column(5), pa.array(data, pa.binary())], names=["rep", "comp", "size", "blocks", "data"])
            yield made.filter(pa.array(ok, pa.bool_()))

    return run


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: JoinParams = JoinParams()) -> DataFrame:
    """One row per distinct id: doc_id, class_id (smallest id reachable over links), n_links (documents linked directly).

    Two documents link if their shingle sets have a Jaccard similarity of at least the threshold. A text
    without words (null, empty, blank) links with nothing; a very long one is read whole. Rows of one id are one document: of several
    texts, the one with the smallest digest is judged. Rows of a null id are one document that links with
    nothing. Equal sets are joined as one class first and count in n_links by their number.
    """
    p, spark = params, docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    raw = d.mapInArrow(_signatures(p), "doc_id long, sig binary, mh binary, sketch binary")
    signed = Table(raw.groupBy("doc_id").agg(F.min(F.struct("sig", "mh", "sketch")).alias("s")).select("doc_id", "s.*"), "signatures").df
    able = signed.where("sig is not null and doc_id is not null")
    classes = able.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    reps = Table(able.join(classes, "sig").where("doc_id = rep").select("rep", "mh", "sketch", "sig", "size"), "classes").df
    comp = connected_components(candidate_links(reps, p)).select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    comp = Table(comp, "candidates").df
    blocks = comp.groupBy("comp").agg(F.ceil(F.count("*") / p.block).cast("int").alias("blocks"))
    members = comp.join(blocks, "comp").join(reps.select("rep", "sig", "size"), "rep")
    text_of = d.join(members, d.doc_id == members.rep).select("rep", "text", "sig", "comp", "size", "blocks")
    sets = text_of.mapInArrow(_sets(p), "rep long, comp long, size long, blocks int, data binary")
    side = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = sets.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("comp", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep", "size", "data")
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "rep")
    found = Table(dealt.mapInArrow(_verify(p), "rep long, links long, root long"), "links").df
    linked = connected_components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    final = classes.join(links, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    final = final.select("sig", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n"))
    out = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("sig")).alias("sig")).join(final, "sig", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: JoinParams = JoinParams()) -> DataFrame:
    """The rows of the smallest id of each class, columns as they were, whatever their names; rows of a null id stay."""
    name = fresh(docs, "gone")
    gone = similar_documents(docs, doc_id, text, params).where("doc_id <> class_id").select(F.col("doc_id").alias(name))
    return docs.join(gone, column(doc_id) == F.col(name), "left_anti")
