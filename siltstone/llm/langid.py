"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language, bit-sliced: a slot holds one bit per language, so the AND over an
n-gram's slots gives every language that holds it. The hits of each language, corrected for its
filter's false positives, decide.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.names import column, fresh

UND = "und"
_PRIMES = [np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class LangParams:
    sizes: tuple[int, ...] = (2, 3, 4)  # code points per n-gram
    per_language: int = 4000  # the most frequent n-grams of each size that a language's filter takes
    sample: int = 4000  # labelled documents per language that the filters are fitted on, at most
    languages: int = 1024  # the most frequent label values are learned, at most so many: 64 of them take 4 MB of filters
    slots_log2: int = 19
    hashes: int = 4
    chunk: int = 1 << 20  # code points handled at once


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@functools.cache
def _kinds() -> np.ndarray:
    """For each code point 1 for a letter, 2 for a combining mark, 0 for all else (Unicode categories L and M)."""
    return np.array([{"L": 1, "M": 2}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], dtype=np.int8)


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-case words (letters and their marks), behind and before one space each; empty without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype="<u4")
    kind = _kinds()[points]
    if not (kind == 1).any():
        return np.empty(0, dtype=np.uint64)
    spaced = np.concatenate([[32], np.where(kind > 0, points, 32), [32]])
    fresh = np.ones(len(spaced), dtype=bool)
    fresh[1:] = (spaced[1:] != 32) | (spaced[:-1] != 32)
    return spaced[fresh].astype(np.uint64)


def grams(points: np.ndarray, n: int) -> np.ndarray:
    """64-bit keys of all n-grams of n code points."""
    if len(points) < n:
        return np.empty(0, dtype=np.uint64)
    key = np.full(len(points) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        key = (key ^ points[i : len(points) - n + 1 + i]) * _PRIMES[i % 4]
    return _mix(key)


def _count(params: LangParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                by.setdefault(lang, []).append(letters(text))
            for lang, texts in by.items():
                points = np.concatenate(texts)
                for n in params.sizes:
                    keys, count = np.unique(grams(points, n), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys)), pa.array([n] * len(keys), pa.int32()), pa.array(keys.view(np.int64)), pa.array(count.astype(np.int64))],
                        names=["lang", "n", "gram", "c"],
                    )

    return run


class BitmaskFilters:
    """Bit-sliced Bloom filters: slots of 64 languages each."""

    def __init__(self, by_lang: dict[str, np.ndarray], params: LangParams):
        self.langs, self.params = sorted(by_lang), params
        self.size = np.uint64((1 << params.slots_log2) - 1)
        self.slots = np.zeros((-(-max(1, len(self.langs)) // 64), 1 << params.slots_log2), dtype=np.uint64)
        for i, lang in enumerate(self.langs):
            bit = np.uint64(1 << (i % 64))
            for slot in self._slots(by_lang[lang]):
                self.slots[i // 64][slot] |= bit
        fill = [np.mean((self.slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(self.langs))]
        self.false_positive = np.array(fill) ** params.hashes

    def _slots(self, keys: np.ndarray):
        step = (keys >> np.uint64(32)) | np.uint64(1)
        return [(keys + np.uint64(j) * step) & self.size for j in range(self.params.hashes)]

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """For each n-gram, the bits of all languages that hold it, 64 languages to a row."""
        slots = self._slots(keys)
        out = self.slots[:, slots[0]]
        for s in slots[1:]:
            out &= self.slots[:, s]
        return out

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, int]:
        """Corrected hits per language, and the number of n-grams, of one prepared text."""
        counts, total = np.zeros(len(self.langs)), 0
        for a in range(0, max(1, len(points)), self.params.chunk):
            for n in self.params.sizes:
                keys = grams(points[a : a + self.params.chunk + n - 1], n)
                masks = self.masks(keys)
                total += len(keys)
                counts += [np.count_nonzero(masks[i // 64] & np.uint64(1 << (i % 64))) for i in range(len(self.langs))]
        f = self.false_positive
        return np.maximum(0.0, (counts - total * f) / (1 - f)), total

    def decide(self, text: str | None) -> tuple[str, float]:
        """The language with most corrected hits, and the share of the n-grams that are hits."""
        words = letters(text)
        if not len(words) or not self.langs:
            return UND, 0.0
        counts, total = self.hits(words)
        best = int(np.argmax(counts))
        return self.langs[best], float(min(1.0, counts[best] / max(1, total)))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", params: LangParams = LangParams()) -> BitmaskFilters:
    """Fit on at most `sample` labelled documents per language, those with the smallest hash of `key`.

    Null languages are left out. Of more than `languages` values the most frequent are learned (the first by name of equals):
    a dirty label column costs the rare values, not the run. Rows of one language and id are one document, the text of the smallest
    hash. The filters hold at most `per_language` n-grams of each size and language, and those are all that comes to the driver.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r["l"]: r["n"] for r in labelled.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("rows"), F.approx_count_distinct(F.col(key)).alias("n")).orderBy(F.desc("rows"), "l").limit(params.languages).collect()}
    # A share of the hash range with a fifth to spare leaves few rows to rank, however many there are.
    share = {x: min(1.0, (1.2 * params.sample + 50) / max(1, n)) for x, n in counts.items()}
    if not share:
        return BitmaskFilters({}, params)
    top = {x: min(2**63 - 1, int(s * 2**64) - 2**63) for x, s in share.items()}
    within = F.element_at(F.create_map(*[F.lit(x) for kv in top.items() for x in kv]), F.col(lang))
    ids = labelled.select(F.col(lang).alias("l"), F.col(key).alias("k"), F.xxhash64(F.col(key)).alias("h"), within.alias("top")).where("h <= top").distinct()
    order = W.partitionBy("l").orderBy("h", "k")
    last = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= params.sample)
    bound = {r["l"]: r["h"] for r in last.groupBy("l").agg(F.max("h").alias("h")).collect()}
    if not bound:
        return BitmaskFilters({}, params)
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in bound.items() for x in kv]), F.col(lang))
    sample = labelled.where(F.xxhash64(F.col(key)) <= limit).groupBy(F.col(lang).alias("l"), F.col(key).alias("k")).agg(F.min_by(text, F.xxhash64(text)).alias("t")).select("l", "t")
    grams_of = sample.mapInArrow(_count(params), "lang string, n int, gram long, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    best = grams_of.withColumn("r", F.row_number().over(W.partitionBy("lang", "n").orderBy(F.desc("c"), "gram"))).where(F.col("r") <= params.per_language)
    found: dict[str, list[int]] = {x: [] for x in bound}
    for r in best.select("lang", "gram").toLocalIterator():
        found[r["lang"]].append(r["gram"])
    return BitmaskFilters({x: np.array(g, dtype=np.int64).view(np.uint64) for x, g in found.items()}, params)


def predict(docs: DataFrame, filters: BitmaskFilters, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Add the predicted language and its score (0 to 1) to each row, from its whole text alone.

    `und` and 0 for a null text or one without letters (Unicode category L). Ties go to the first language by name; equal rows
    get equal results. Columns of the output's names are replaced; all others stay as they are.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(filters)  # slots_log2 and languages bound its size

    @F.pandas_udf("struct<lang:string,score:double>")
    def judge(texts):
        import pandas as pd

        return pd.DataFrame([shared.value.decide(t) for t in texts], columns=["lang", "score"])

    name = fresh(docs, "judged")
    judged = docs.withColumn(name, judge(column(text)))
    return judged.withColumns({lang_out: F.col(f"{name}.lang"), score_out: F.col(f"{name}.score")}).drop(name)


def held_out(key):
    """The fold that no fit may see: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", params: LangParams = LangParams()) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score; fitted on the rows that are not held out."""
    filters = fit(docs.where(~held_out(doc_id)), text, lang, doc_id, params)
    out = predict(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), filters)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
