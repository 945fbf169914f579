"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Examples are a bounded sample of labelled texts. The vocabulary is the words and word beginnings that are
significantly more frequent in toxic examples than in others; document frequencies are counted over all
documents. Each text is then a short TF-IDF vector. The examples' vectors lie in an inverted index whose
posting lists are cut at the same example numbers into blocks, each with the largest weight in it: summed
over a query's terms, these maxima bound every similarity in a block, and blocks that cannot reach the
k-th best so far are skipped, which leaves the top k exact. The neighbours vote, weighted by
nearness and by how many labelled documents an example stands for; a monotone map, fitted on votes that leave the voter out, turns a
vote into a probability. The nearest neighbours are given as evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.langid import held_out
from siltstone.llm.words import _BASE, _INVERSE, _power_table, chunks, mix
from siltstone.store import Table

_BREAK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


@dataclass(frozen=True)
class ToxicityParams:
    examples: int = 4000  # labelled documents of each label that can be neighbours, at most
    vocabulary: int = 4096  # terms, at most (below 65,536)
    beginnings: tuple[int, ...] = (4, 5, 6)  # bytes of word beginnings that are terms beside whole words
    support: int = 3  # toxic examples that hold a term, at least
    chance: float = 0.01  # of one or more terms in the vocabulary that only chance made significant
    neighbours: int = 16
    block: int = 64  # examples in a block of the index
    own: float = 1.0  # weight of the label's share among all labelled documents in a vote
    threshold: float = 0.3
    evidence: int = 3  # neighbours that are shown
    rows_per_task: int = 10_000  # scored in one task


def terms(texts: list[str | None], p: ToxicityParams) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Hashes of the terms of texts and the text that each stands in, for stretches of the texts: (first text, hashes, numbers).

    Words are lower-case runs of ASCII letters and digits and of all characters beyond ASCII.
    """
    for a, b in chunks(texts):
        raw = [(t or "").lower().encode("utf-8", "replace") for t in texts[a:b]]
        buf = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
        gap = _BREAK[buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        start, size = edge[::2], edge[1::2] - edge[::2]
        sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((buf + np.uint64(1)) * _power_table("up", _BASE, len(buf)), out=sums[1:])
        down = _power_table("down", _INVERSE, len(buf))[start]
        owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, side="left")
        hashes, owners = [mix((sums[start + size] - sums[start]) * down ^ size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))], [owner]
        for k in p.beginnings:
            long = size >= k
            hashes.append(mix((sums[start[long] + k] - sums[start[long]]) * down[long] + np.uint64(k)))
            owners.append(owner[long])
        yield a, np.concatenate(hashes), np.concatenate(owners)


def _count_terms(p: ToxicityParams):
    """(toxic, text) to (term, a, b): toxic and other examples of the batch that hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for first, h, owner in terms(batch.column(1).to_pylist(), p):
                pairs = np.unique(np.stack([h, owner.astype(np.uint64)]), axis=1)
                each, at = np.unique(pairs[0], return_inverse=True)
                marked = np.bincount(at, weights=toxic[first + pairs[1].astype(np.int64)], minlength=len(each)).astype(np.int64)
                every = np.bincount(at, minlength=len(each))
                yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(marked), pa.array(every - marked)], names=["term", "a", "b"])

    return run


def _vocabulary(examples: DataFrame, p: ToxicityParams) -> np.ndarray:
    """Sorted hashes of the terms whose G statistic passes the chance level of the best of so many terms."""
    n = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    at, bt = n.get(True, 0), n.get(False, 0)
    if not at or not bt:
        return np.empty(0, dtype=np.uint64)
    counted = Table(examples.select("toxic", "text").mapInArrow(_count_terms(p), "term long, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "term-counts")
    plus = lambda seen, total: F.when(seen > 0, seen * F.log(seen / total)).otherwise(0.0)
    a, b, s = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    g = 2 * (plus(a, s * at / (at + bt)) + plus(b, s * bt / (at + bt)) + plus(at - a, (at + bt - s) * at / (at + bt)) + plus(bt - b, (at + bt - s) * bt / (at + bt)))
    tested = counted.df.count()
    found = counted.df.where((a >= p.support) & (a * bt > b * at)).select("term", g.alias("g")).where(F.col("g") > 2 * np.log(max(1, tested) / p.chance))
    rows = found.orderBy(F.desc("g"), "term").limit(p.vocabulary).collect()
    counted.drop()
    return np.sort(np.array([r["term"] for r in rows], dtype=np.int64).view(np.uint64))


def _vectors(vocabulary: np.ndarray, p: ToxicityParams):
    """Replace the last column, a text, by `terms` (numbers in the vocabulary, 16 bits) and `counts` (32 bits)."""
    bits = np.uint64((1 << 20) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.zeros(1 << 20, dtype=bool)
        maybe[vocabulary & bits] = True
        for batch in batches:
            out_terms, out_counts = [b""] * len(batch), [b""] * len(batch)
            if len(vocabulary):
                for first, h, owner in terms(batch.column(batch.num_columns - 1).to_pylist(), p):
                    some = maybe[h & bits]
                    h, owner = h[some], owner[some]
                    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                    hit = vocabulary[at] == h
                    key, count = np.unique(owner[hit].astype(np.int64) * len(vocabulary) + at[hit], return_counts=True)
                    number, cut = np.unique(key // len(vocabulary), return_index=True)
                    for i, a, b in zip(number.tolist(), cut.tolist(), [*cut[1:].tolist(), len(key)]):
                        out_terms[first + i] = (key[a:b] % len(vocabulary)).astype("<u2").tobytes()
                        out_counts[first + i] = count[a:b].astype("<u4").tobytes()
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out_terms, pa.binary()), pa.array(out_counts, pa.binary())], names=[*batch.schema.names[:-1], "terms", "counts"])

    return run


def _document_frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, dtype=np.int64)
        for batch in batches:
            seen += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<u2"), minlength=size)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], names=["term", "n"])

    return run


class BlockMaxIndex:
    """Inverted lists of the examples' unit vectors, in blocks of the same examples for every term."""

    def __init__(self, rows: list[tuple[int, bool, bytes, bytes]], idf: np.ndarray, share: dict[bool, float], p: ToxicityParams):
        """rows: id, toxic, terms, counts. share: how many labelled documents an example of each label stands for."""
        self.p, self.idf = p, idf
        same: dict[tuple[bytes, bytes], list[tuple[int, bool]]] = {}
        for i, toxic, t, c in rows:
            same.setdefault((t, c), []).append((i, toxic))
        total = share[True] * sum(r[1] for r in rows) + share[False] * sum(not r[1] for r in rows)
        self.prior = share[True] * sum(r[1] for r in rows) / total if total else 0.0
        bare = same.pop((b"", b""), [])
        votes = lambda members: [sum(share[y] for _, y in members if y), sum(share[y] for _, y in members)]
        self.bare = votes(bare)
        # Examples with the same heaviest term stand together, so the maxima of a block are close to its weights.
        items = sorted((((*self.vector(t, c),), t, c, m) for (t, c), m in same.items()), key=lambda x: (int(x[0][0][x[0][1].argmax()]), x[1], x[2]))
        self.n = len(items)
        self.votes = np.array([votes(m) for *_, m in items]).reshape(self.n, 2)
        self.shown = [min(m) for *_, m in items]
        self.number = {(t, c): i for i, (_, t, c, _) in enumerate(items)}
        example = np.repeat(np.arange(self.n), [len(v[0]) for v, *_ in items])
        term = np.concatenate([v[0] for v, *_ in items]) if items else np.empty(0, dtype=np.int64)
        weight = np.concatenate([v[1] for v, *_ in items]) if items else np.empty(0)
        order = np.lexsort([example, term])
        self.example, self.weight = example[order], weight[order]
        self.blocks = max(1, -(-self.n // p.block))
        place = term[order] * self.blocks + self.example // p.block
        self.start = np.searchsorted(place, np.arange(len(idf) * self.blocks + 1))  # of each term's list in each block
        self.most = np.zeros(len(idf) * self.blocks)
        np.maximum.at(self.most, place, self.weight)
        self.most = self.most.reshape(len(idf), self.blocks)
        self.points: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([self.prior]))

    def vector(self, t: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
        number = np.frombuffer(t, dtype="<u2").astype(np.int64)
        w = (1 + np.log(np.frombuffer(c, dtype="<u4"))) * self.idf[number]
        return number, w / np.sqrt((w * w).sum())

    def similarities(self, number: np.ndarray, w: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Exact similarities of all examples of the given blocks; 0 elsewhere."""
        at = (number[:, None] * self.blocks + blocks[None, :]).ravel()
        a, size = self.start[at], self.start[at + 1] - self.start[at]
        ends = np.cumsum(size)
        flat = np.arange(ends[-1]) + np.repeat(a - ends + size, size)
        return np.bincount(self.example[flat], weights=np.repeat(np.repeat(w, len(blocks)), size) * self.weight[flat], minlength=self.n)

    def top(self, t: bytes, c: bytes, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples of a vector and their similarities, best first; of equals, those of smaller number."""
        if not t or not self.n:
            return np.empty(0, dtype=np.int64), np.empty(0)
        number, w = self.vector(t, c)
        bound = w @ self.most[number]
        best = np.argsort(-bound, kind="stable")
        best = best[bound[best] > 0]
        found, done, k = np.zeros(self.n), 0, self.p.neighbours
        for ahead in (2, 8, len(best)):
            found += self.similarities(number, w, best[done:ahead]) if ahead > done and done < len(best) else 0
            if without is not None:
                found[without] = 0
            done = max(done, ahead)
            least = np.partition(found, -k)[-k] if self.n >= k else 0.0
            # A block that only equals the k-th best is read too: a smaller number goes first.
            reach = int(np.searchsorted(-bound[best], -(least - 1e-9), side="right"))
            best = best[: max(done, reach)] if least > 0 else best
            if done >= len(best):
                break
        some = np.flatnonzero(found > 0)
        near = np.round(found[some], 9)
        order = np.lexsort([some, -near])[:k]
        return some[order], near[order]

    def vote(self, t: bytes, c: bytes, without: int | None = None) -> tuple[float | None, np.ndarray, np.ndarray]:
        """The weighted share of toxic neighbours, drawn towards the overall share; None without any neighbour."""
        at, near = self.top(t, c, without)
        if not len(at):
            return None, at, near
        w = near * near
        mean = self.votes[:, 1].mean()
        toxic, every = w @ self.votes[at, 0] / mean, w @ self.votes[at, 1] / mean
        return float((toxic + self.p.own * self.prior) / (every + self.p.own)), at, near

    def score(self, t: bytes, c: bytes) -> tuple[float, str]:
        vote, at, near = self.vote(t, c)
        if vote is None:
            return self.without_neighbours(), ""
        x, y = self.points
        shown = [f"{self.shown[i][0]}:{int(self.shown[i][1])}:{s:.3f}" for i, s in zip(at[: self.p.evidence].tolist(), near.tolist())]
        return float(np.interp(vote, x, y)), ",".join(shown)

    def without_neighbours(self) -> float:
        return float((self.bare[0] + self.prior) / (self.bare[1] + 1))


def calibrate(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Points of a monotone map from votes to probabilities (pool adjacent violators), each pool drawn towards `prior` by one document."""
    pools: list[list[float]] = []  # weighted votes, toxic, weight
    each, at = np.unique(votes, return_inverse=True)
    hit, all_ = np.bincount(at, weights=weight * toxic), np.bincount(at, weights=weight)
    for v, a, n in zip(each.tolist(), hit.tolist(), all_.tolist()):
        pools.append([v * n, a, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    x = np.array([v / n for v, _, n in pools])
    return x, np.maximum.accumulate(np.array([(a + prior) / (n + 1) for _, a, n in pools]))


def _leave_out(index):
    """The votes of examples among the others: vote, toxic, for those that have neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = index.value
            votes = [held.vote(t, c, held.number.get((t, c)))[0] for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), batch.column(0)], names=["vote", "toxic"])

    return run


def _score(index, keep: int = 100_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[bytes, bytes], tuple[float, str]] = {}
        for batch in batches:
            out = []
            for key in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if key not in known:
                    if len(known) >= keep:
                        known.clear()
                    known[key] = index.value.score(*key)
                out.append(known[key])
            score = np.clip(np.array([s for s, _ in out]), 0.0, 1.0)
            predicted = (score >= index.value.p.threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array(predicted), pa.array([e for _, e in out], pa.string())],
                names=["doc_id", "held_out", "score", "predicted", "evidence"],
            )

    return run


def _examples(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str, hidden: Column, p: ToxicityParams) -> tuple[Table, dict[bool, int]]:
    """doc_id, toxic, text of the sample, those of the smallest hashes of the id; and how many labelled ids there are of each label."""
    asked = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{toxic}`").alias("toxic")).where(~hidden & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    asked = asked.groupBy("doc_id").agg((F.max((F.col("toxic") == 1).cast("int")) == 1).alias("toxic"))
    n = {r["toxic"]: r["n"] for r in asked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    few = lambda y: asked.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.examples)
    chosen = few(True).unionByName(few(False)).withColumnsRenamed({"doc_id": "example", "toxic": "toxic"})
    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    met = d.join(F.broadcast(chosen), F.col("doc_id") == F.col("example"))  # twice `examples` rows
    return Table(met.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "examples", batch_rows=200), n


def score_toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", params: ToxicityParams = ToxicityParams()
) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (score >= threshold), evidence (nearest examples as id:label:similarity).

    Labels are learned from ids that are not held out alone (see langid.held_out); a text's score depends on the text alone.
    A null text is empty; an empty text, or one without a term of the vocabulary, gets the share of toxic
    examples among those without any. Very long texts are read whole. Repeated rows get equal results. Several labels of one id: toxic
    if any is 1; null ones count for nothing; rows of one labelled id are one example, the text of the smallest hash. A null id is
    scored, not held out and never an example. Without toxic or without other examples nothing is learned and all get the share of the
    labels (0 without labels). Empty tables give no rows. Other columns are not read.
    """
    p, spark = params, docs.sparkSession
    examples, n = _examples(docs, labels, doc_id, text, toxic, held_out("doc_id"), p)
    vocabulary = _vocabulary(examples.df, p)
    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    d = d.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    found = Table(d.mapInArrow(_vectors(vocabulary, p), "doc_id long, held_out boolean, terms binary, counts binary"), "term-vectors").df
    sizes = found.select("terms").mapInArrow(_document_frequencies(len(vocabulary)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df, total = np.zeros(len(vocabulary)), found.count()
    for r in sizes.collect():  # a row per term of the vocabulary
        df[r["term"]] = r["n"]
    idf = 1 + np.log((total + 1) / (df + 1))
    known = Table(examples.df.select("doc_id", "toxic", "text").mapInArrow(_vectors(vocabulary, p), "doc_id long, toxic boolean, terms binary, counts binary"), "example-vectors")
    rows = [(r["doc_id"], r["toxic"], bytes(r["terms"]), bytes(r["counts"])) for r in known.df.collect()]  # twice `examples` at most
    kept = {y: sum(r[1] == y for r in rows) for y in (True, False)}
    share = {y: n.get(y, 0) / kept[y] if kept[y] else 0.0 for y in kept}
    index = BlockMaxIndex(rows, idf, share, p)
    votes = known.df.select("toxic", "terms", "counts").mapInArrow(_leave_out(spark.sparkContext.broadcast(index)), "vote double, toxic boolean").where("vote is not null").collect()
    if votes:
        label = np.array([r["toxic"] for r in votes])
        index.points = calibrate(np.array([r["vote"] for r in votes]), label, np.where(label, share[True], share[False]), index.prior)
    known.drop()
    examples.drop()
    # Vectors are small beside the work on them: files would be packed into few tasks.
    dealt = found.repartition(max(spark.sparkContext.defaultParallelism, -(-total // p.rows_per_task)))
    return dealt.mapInArrow(_score(spark.sparkContext.broadcast(index)), "doc_id long, held_out boolean, score double, predicted int, evidence string")
