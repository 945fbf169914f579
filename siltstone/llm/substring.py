"""Substring dedup by prefix-partitioned suffix trees over words.

A window's anchor is the place of the smallest hash among its five-word runs (the first of equal ones), so
equal windows have equal anchors, and about one position in five is one. Windows whose anchor occurs in one
document alone are unique. Of the others only the suffixes that start at an anchor enter the trees, each
with the words before it that its windows need: a sampled suffix tree.

The suffixes are split by their first five words, the anchor. A group is sorted; the common prefixes of
neighbours are the depths of its internal nodes, and for a window that begins `back` words before the
anchor the nodes at least `window - back` deep hold its equals, parted once more by the words before the
anchor. Anchors with more than `group_suffixes` suffixes are split further: there each window is a suffix of
its own, divided by prefixes of 8 or 13 words. What still exceeds a group at 13 words is one window, for
which the smallest document is an aggregate. Windows that start in a smaller document too are joined to
the maximal repeats of each document.

Equal texts enter the trees once, as their smallest document, of which the others are one whole repeat.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.words import chunks, hash_words, mix, ngrams
from siltstone.store import Table

BATCH = 20_000  # suffixes of an Arrow batch


@dataclass(frozen=True)
class SubstringParams:
    window: int = 13
    anchor: int = 5  # words of an anchor: the first prefix
    prefixes: tuple[int, ...] = (8, 13)  # further prefixes of large groups, in words; the last is the window
    group_suffixes: int = 100_000
    broadcast_rows: int = 200_000  # of heavy prefixes, 8 bytes each

    @property
    def reach(self) -> int:
        """Words that a window may have before its anchor, at most."""
        return self.window - self.anchor


def _check(text: str | None) -> int:
    return zlib.crc32((text or "").encode("utf-8", "surrogatepass"))


@dataclass
class Anchors:
    """Per anchor of a batch of texts: text, place of the anchor, and how many words before it its windows begin, at least and at most."""

    hashes: np.ndarray
    first: np.ndarray  # of each text, its first word's place
    counts: np.ndarray
    text: np.ndarray
    at: np.ndarray
    least: np.ndarray
    most: np.ndarray
    key: np.ndarray

    def pick(self, rows: np.ndarray) -> "Anchors":
        return Anchors(self.hashes, self.first, self.counts, *(x[rows] for x in (self.text, self.at, self.least, self.most, self.key)))


def find_anchors(texts: list[str | None], p: SubstringParams) -> Anchors:
    hashes, counts = hash_words(texts)
    grams, span = ngrams(hashes, p.anchor), p.reach + 1
    first = np.cumsum(counts) - counts
    per = np.maximum(0, counts - p.window + 1)
    text = np.repeat(np.arange(len(counts)), per)
    start = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(first, per)
    if not len(start):
        none = np.empty(0, dtype=np.int64)
        return Anchors(hashes, first, counts, none, none, none, none, np.empty(0, dtype=np.uint64))
    many = len(grams) - span + 1
    low, at = grams[:many].copy(), np.zeros(many, dtype=np.int64)
    for j in range(1, span):
        less = grams[j : many + j] < low
        low[less] = grams[j : many + j][less]
        at[less] = j
    back = at[start]
    place = start + back
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(start)) - 1
    return Anchors(hashes, first, counts, text[head], place[head], back[tail], back[head], grams[place[head]])


def _anchor_rows(p: SubstringParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                found = find_anchors(texts[a:b], p)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + found.text]), pa.array(found.key.view(np.int64))], names=["doc_id", "anchor"])

    return run


def _among(found: Anchors, lists: pa.Array, a: int, b: int) -> np.ndarray:
    """Rows of the anchors that their text's list holds."""
    known = lists.slice(a, b - a)
    owner = np.repeat(np.arange(b - a), np.diff(known.offsets.to_numpy()))
    kind = [("t", "<i8"), ("h", "<u8")]
    listed, have = np.empty(len(owner), dtype=kind), np.empty(len(found.text), dtype=kind)
    listed["t"], listed["h"] = owner, known.flatten().to_numpy().view(np.uint64)
    have["t"], have["h"] = found.text, found.key
    return np.flatnonzero(np.isin(have, listed))


def _places(found: Anchors, word: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """The text's check sum, for rows of one id with several texts, and the position in words."""
    check = np.array([_check(t) for t in texts], dtype=np.uint64)
    return ((check[found.text] << np.uint64(32)) | (word - found.first[found.text]).astype(np.uint64)).view(np.int64)


def _binaries(values: np.ndarray, keep: np.ndarray | None = None) -> pa.Array:
    """The rows of a matrix as binaries of big-endian words; of each row only the kept words."""
    raw = values.astype(">u8")
    size = np.full(len(raw), raw.shape[1]) if keep is None else keep.sum(axis=1)
    ends = np.concatenate([[0], np.cumsum(size)]) * 8
    data = (raw if keep is None else raw[keep]).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


_SUFFIXES = "anchor long, ahead binary, behind binary, doc_id long, place long, least int, most int"


def _suffix_rows(p: SubstringParams):
    """The suffixes at anchors: `ahead` the words from the anchor on, `behind` those before it, nearest first, as far as windows reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                found = find_anchors(texts[a:b], p)
                listed = _among(found, batch.column(2), a, b)
                for i in range(0, len(listed), BATCH):
                    few = found.pick(listed[i : i + BATCH])
                    right = few.at[:, None] + np.arange(p.window)
                    left = few.at[:, None] - 1 - np.arange(p.reach)
                    ahead = _binaries(few.hashes[np.minimum(right, len(few.hashes) - 1)], np.arange(p.window) < p.window - few.least[:, None])
                    behind = _binaries(few.hashes[np.maximum(left, 0)], np.arange(p.reach) < few.most[:, None])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(few.key.view(np.int64)), ahead, behind, pa.array(ids[a + few.text]),
                            pa.array(_places(few, few.at, texts[a:b])), pa.array(few.least.astype(np.int32)), pa.array(few.most.astype(np.int32)),
                        ],
                        names=["anchor", "ahead", "behind", "doc_id", "place", "least", "most"],
                    )

    return run


def _window_rows(p: SubstringParams):
    """doc_id, place and suffix (the window's words) of each window of the listed anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                found = find_anchors(texts[a:b], p)
                found = found.pick(_among(found, batch.column(2), a, b))
                many = found.most - found.least + 1
                row = np.repeat(np.arange(len(many)), many)
                start = found.at[row] - found.most[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                found = found.pick(row)
                for i in range(0, len(start), BATCH):
                    part = start[i : i + BATCH]
                    few = found.pick(np.arange(i, i + len(part)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a + few.text]), pa.array(_places(few, part, texts[a:b])), _binaries(few.hashes[part[:, None] + np.arange(p.window)])],
                        names=["doc_id", "place", "suffix"],
                    )

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Binaries of at most `width` words as rows, filled up with zeros."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    out = np.zeros((len(column), width), dtype=np.uint64)
    data = column.buffers()[2]
    if data is not None:
        words = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].tobytes()
        out[np.arange(width) < (np.diff(ends) // 8)[:, None]] = np.frombuffer(words, dtype=">u8")
    return out


def common_prefixes(suffixes: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """suffixes: a sorted suffix array, one row of words each. For each row but the first, the words it shares
    with the row before: the depth of the internal node between them. Rows of different groups share none."""
    same = suffixes[1:] == suffixes[:-1]
    common = np.where(same.all(axis=1), suffixes.shape[1], np.argmin(same, axis=1))
    return common if group is None else np.where(group[1:] == group[:-1], common, 0)


def deep_nodes(suffixes: np.ndarray, depth: int, group: np.ndarray | None = None) -> np.ndarray:
    """For each row of a sorted suffix array the number of its deepest subtree whose node is at least `depth` deep, or of itself."""
    opens = np.ones(len(suffixes), dtype=np.int64)
    if len(suffixes):
        opens[1:] = common_prefixes(suffixes, group) < depth
    return np.cumsum(opens) - 1


def repeated(group: np.ndarray, ahead: np.ndarray, behind: np.ndarray, doc: np.ndarray, least: np.ndarray, most: np.ndarray, p: SubstringParams) -> np.ndarray:
    """Whole groups, sorted: for each suffix and each number of words back, whether that window starts in a smaller document too."""
    hits = np.zeros((len(doc), p.reach + 2), dtype=bool)
    common = common_prefixes(ahead, group) if len(doc) else None
    before = np.zeros(len(doc), dtype=np.uint64)
    for back in range(p.reach + 1):
        if back:
            before = mix(before * np.uint64(0xD6E8FEB86659FD93) + behind[:, back - 1])
        own = np.flatnonzero((least <= back) & (back <= most))
        if not len(own):
            continue
        opens = np.ones(len(doc), dtype=np.uint64)
        opens[1:] = common < p.window - back
        leaf = mix(np.cumsum(opens)[own] ^ before[own])
        order = np.argsort(leaf, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], leaf[order][1:] != leaf[order][:-1]]))
        docs = doc[own][order]
        low = np.repeat(np.minimum.reduceat(docs, heads), np.diff(np.append(heads, len(docs))))
        hits[own[order], back] = docs > low
    return hits


def _trees(p: SubstringParams, at_once: int = BATCH):
    """Rows sorted by group and suffix: the pieces of repeats, as doc_id, place of the first window, and number of windows."""

    def pieces(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        col = lambda i: t.column(i).chunk(0)
        doc, place = col(3).to_numpy(), col(4).to_numpy()
        hits = repeated(col(0).to_numpy(), _matrix(col(1), p.window), _matrix(col(2), p.reach), doc, col(5).to_numpy(), col(6).to_numpy(), p)
        edge = np.diff(hits.astype(np.int8), axis=1, prepend=0)
        row, begin = np.nonzero(edge == 1)
        end = np.nonzero(edge == -1)[1] - 1
        return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(place[row] - end), pa.array((end - begin + 1).astype(np.int64))], names=["doc_id", "place", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if rows >= at_once:
                # Give the whole groups so far to the trees; the rest of the last one stays.
                group = batch.column(0).to_numpy()
                last = held[-1].column(0)[-1].as_py()
                cut = int(np.argmax(group != last)) if (group != last).any() else len(group)
                if cut < len(group):
                    yield pieces(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield pieces(pa.Table.from_batches(held))

    return run


def _window_trees(p: SubstringParams):
    """As `_trees` for suffixes that start a window each, of groups of any size: rows sorted by group, suffix and document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, low = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            words = _matrix(batch.column(2), p.window)
            node = deep_nodes(words, p.window)
            least = doc[np.flatnonzero(np.diff(node, prepend=-1))][node]
            if last is not None and np.array_equal(words[0], last):
                least = np.where(node == 0, low, least)
            last, low = words[-1].copy(), least[-1]
            hit = doc > least
            yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(place[hit]), pa.array(np.ones(int(hit.sum()), dtype=np.int64))], names=["doc_id", "place", "n"])

    return run


_PIECES = "doc_id long, place long, n long"


def _large_groups(windows: DataFrame, p: SubstringParams) -> DataFrame:
    """windows: doc_id, place, suffix. The pieces of repeats, from groups by the shortest prefix that makes them fit."""
    prefix = lambda n: F.xxhash64(F.substring("suffix", 1, 8 * n))
    rest, groups = windows, []
    for n in p.prefixes:
        heavy = Table(rest.groupBy(prefix(n).alias("h")).count().where(F.col("count") > p.group_suffixes).select("h"), "heavy-prefixes").df
        many = heavy.count()
        if not many:
            groups.append(rest.withColumn("group", prefix(n)))
            rest = None
            break
        heavy = F.broadcast(heavy) if many <= p.broadcast_rows else heavy
        keyed = rest.withColumn("h", prefix(n))
        groups.append(keyed.join(heavy, "h", "left_anti").drop("h").withColumn("group", prefix(n)))
        rest = keyed.join(heavy, "h", "left_semi").drop("h")
    every = groups[0]
    for more in groups[1:]:
        every = every.unionByName(more)
    n = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = every.repartition(n, "group").sortWithinPartitions("group", "suffix", "doc_id").select("doc_id", "place", "suffix")
    found = ordered.mapInArrow(_window_trees(p), _PIECES)
    if rest is not None:
        least = rest.groupBy("suffix").agg(F.min("doc_id").alias("low"))
        found = found.unionByName(rest.join(least, "suffix").where("doc_id > low").selectExpr("doc_id", "place", "1L n"))
    return found


def _repeats(docs: DataFrame, p: SubstringParams) -> DataFrame:
    """docs: doc_id, text, none null. doc_id, pieces: the places and numbers of windows that start in a smaller document too."""
    anchors = Table(docs.mapInArrow(_anchor_rows(p), "doc_id long, anchor long"), "anchors")
    shared = anchors.df.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b")
    shared = Table(shared.select("anchor", (F.col("n") > p.group_suffixes).alias("large")), "shared")
    pick = lambda large: F.collect_set(F.when(F.col("large") == large, F.col("anchor")))
    lists = Table(anchors.df.join(shared.df, "anchor").groupBy("doc_id").agg(pick(False).alias("few"), pick(True).alias("many")), "shared-by-doc")
    anchors.drop()
    shared.drop()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = lambda c: docs.join(lists.df.where(F.size(c) > 0).select("doc_id", c), "doc_id").select("doc_id", "text", c)
    suffixes = listed("few").mapInArrow(_suffix_rows(p), _SUFFIXES)
    ordered = suffixes.repartition(n, "anchor").sortWithinPartitions("anchor", "ahead")
    found = [Table(ordered.mapInArrow(_trees(p), _PIECES), "repeats").df]
    if not lists.df.where(F.size("many") > 0).isEmpty():
        windows = Table(listed("many").mapInArrow(_window_rows(p), "doc_id long, place long, suffix binary"), "windows")
        found.append(Table(_large_groups(windows.df, p), "repeats").df)
        windows.drop()
    lists.drop()
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return every.groupBy("doc_id").agg(F.collect_list(F.struct("place", "n")).alias("pieces"))


def _keep(p: SubstringParams):
    def one(text: str | None, pieces: list[dict] | None, copy: bool | None) -> tuple:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        runs: list[tuple[int, int]] = []
        if copy and len(words) >= p.window:
            runs = [(0, len(words))]
        elif pieces:
            place = np.array([x["place"] for x in pieces], dtype=np.int64).view(np.uint64)
            mine = place >> np.uint64(32) == _check(text)
            start = (place & np.uint64(2**32 - 1)).astype(np.int64)[mine]
            end = start + np.array([x["n"] for x in pieces], dtype=np.int64)[mine]
            # Windows that follow each other are one repeat.
            opens = np.bincount(start, minlength=len(words) + 1)[: len(words) + 1] - np.bincount(end, minlength=len(words) + 1)[: len(words) + 1]
            edge = np.diff((np.cumsum(opens) > 0).astype(np.int8), prepend=0)
            runs = [(int(a), int(b - a) + p.window - 1) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
        gone = np.zeros(len(words), dtype=bool)
        for a, n in runs:
            gone[a : a + n] = True
        kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if runs else b" ".join(words)
        return len(words), int(gone.sum()), kept.decode("utf-8", "replace"), [{"start": a, "length": n} for a, n in runs]

    types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, max(1, whole.num_rows), 1000):
                batch = whole.slice(a, 1000)
                rows = [one(*r) for r in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
                columns = list(zip(*rows)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "n_words", "n_removed", "kept", "repeats"])

    return run


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: SubstringParams = SubstringParams()) -> DataFrame:
    """One row per row: doc_id, n_words, n_removed, kept (the remaining words, joined by one space), repeats.

    repeats: the maximal repeats of the document, by start, as structs of start and length in words: runs of
    which every window starts in a smaller document too. Their words are removed; repeats may overlap by less
    than a window. Windows are judged on the input, not on what is left.

    A null text has no words; a document under `window` words loses none; a very long text is read whole.
    Rows of one doc_id are not smaller than each other, so they take nothing from each other; rows of a null
    doc_id neither take nor lose words. Other columns are not read. An empty table gives no rows.
    """
    p = params
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = d.where("doc_id is not null and text is not null")
    digests = Table(known.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest")), "digests")
    least = digests.df.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    # Ids of which every row is a copy of an earlier text: an id with another text of its own is compared window by window.
    copies = digests.df.join(least, "digest", "left").groupBy("doc_id").agg(F.min(F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False))).alias("copy"))
    copies = Table(copies.where("copy").select("doc_id", "copy"), "copies").df
    digests.drop()
    found = Table(_repeats(known.join(copies, "doc_id", "left_anti"), p), "repeats-by-doc").df
    full = d.join(found, "doc_id", "left").join(copies, "doc_id", "left").select("doc_id", "text", "pieces", "copy")
    return full.mapInArrow(_keep(p), "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<start:bigint,length:bigint>>")


def substring_digest(docs: DataFrame) -> DataFrame:
    kept = dedup_substrings(docs)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), F.size("repeats").cast("bigint").alias("n_repeats"))
