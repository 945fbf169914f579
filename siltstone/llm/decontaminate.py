"""Benchmark decontamination by spaced seeds, with DataFrame and Column operations only.

A seed is the hash of the tokens at the fixed positions of a mask; the positions it skips may differ.
Seeds of benchmark items and of documents are joined, and around each hit the item is laid over the
document on the hit's diagonal: a run of `window` tokens with at most `max_substitutions` differences
is an overlap. The masks hit every run of 13 tokens with up to three differences, wherever these are.
Items under `window` tokens have masks of their own (`seed_kinds`), which hit every case that is accepted.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.names import column, fresh

# Fixed masks: the token positions that are hashed, counted from the seed's start. Of the 286 ways to change three
# of 13 tokens each leaves some placement of some mask untouched (tests/llm/test_decontaminate_short.py counts them).
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 7), (0, 1, 2, 6, 9))


@dataclass(frozen=True)
class DecontaminationParams:
    window: int = 13
    max_substitutions: int = 3
    broadcast_seeds: int = 500_000  # seeds of 24 bytes each; beyond that the join shuffles


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; null gives an empty array."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, r"[^\p{L}\p{N}]+"))


@dataclass(frozen=True)
class SeedKind:
    """Masks for the items of at least `least` and at most `most` tokens."""

    name: int
    least: int
    most: int | None
    masks: tuple[tuple[int, ...], ...]


def seed_kinds(params: DecontaminationParams, short: list[int]) -> list[SeedKind]:
    """The fixed masks for items of `window` tokens and more, and kinds for the shorter lengths that occur.

    Items that may differ in k tokens are cut into k + 2 parts, and each mask leaves k of these out, so
    that one mask at least meets no difference. Items without tolerance are hashed whole.
    """
    kinds = [SeedKind(0, params.window, None, MASKS)]
    allowed = lambda n: n * params.max_substitutions // params.window
    for k in sorted({allowed(n) for n in short}):
        alike = [n for n in range(1, params.window) if allowed(n) == k]
        if k == 0:
            kinds += [SeedKind(n, n, n, (tuple(range(n)),)) for n in alike if n in short]
            continue
        span = alike[0]
        parts = [range(span * i // (k + 2), span * (i + 1) // (k + 2)) for i in range(k + 2)]
        masks = tuple(tuple(x for i, part in enumerate(parts) if i not in out for x in part) for out in combinations(range(k + 2), k))
        kinds.append(SeedKind(span, span, alike[-1], masks))
    return kinds


def _seeds(df: DataFrame, toks: str, at: str, kinds: list[SeedKind], items: bool = False) -> DataFrame:
    """One row per seed: `at`, seed. Documents and long items have seeds at all positions, short items at their start."""

    def fits(kind: SeedKind, mask: tuple[int, ...]) -> Column:
        inside = F.col(at) < F.size(toks) - mask[-1]
        if not items:
            return inside
        inside &= F.size(toks) >= kind.least
        return inside if kind.most is None else inside & (F.size(toks) <= kind.most) & (F.col(at) == 0)

    pick = lambda kind, k, mask: F.xxhash64(F.lit(100 * kind.name + k), *[F.get(F.col(toks), F.col(at) + i) for i in mask])
    least = min(mask[-1] + 1 for kind in kinds for mask in kind.masks)
    here = df.where(F.size(toks) >= least).withColumn(at, F.explode(F.sequence(F.lit(0), F.size(toks) - least)))
    seeds = [F.when(fits(kind, m), pick(kind, k, m)) for kind in kinds for k, m in enumerate(kind.masks)]
    return here.withColumn("seed", F.explode(F.array(*seeds))).where(F.col("seed").isNotNull())


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    params: DecontaminationParams = DecontaminationParams(),
) -> DataFrame:
    """Verified overlaps: doc_id, item_id, n_overlaps (diagonals), best_matched and best_window (tokens).

    Null and empty texts, and items without letters or digits, match nothing. Very long texts are read whole.
    Repeated documents and repeated items each count by id: an id of several rows yields one row, with the
    overlaps of all its texts; a null id is one id. Other columns are not read. Empty tables give no rows.
    Items shorter than `window` must lie in a document whole, with the same share of differences.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), tokens(F.col(item_text)).alias("item_toks"))
    n = F.size("item_toks")
    short = items.select(F.collect_set(F.when((n > 0) & (n < params.window), n))).first()[0]
    kinds = seed_kinds(params, short)
    item_seeds = _seeds(items, "item_toks", "item_at", kinds, items=True).select("seed", "item_id", "item_at", F.size("item_toks").alias("item_len"))
    bounded = item_seeds.count() <= params.broadcast_seeds
    # Rows of one id may differ: a text is known by the id and its hash.
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("version"), tokens(F.col(text)).alias("toks"))
    seeds = _seeds(d, "toks", "doc_at", kinds)
    diag = F.col("doc_at") - F.col("item_at")
    part = F.slice("toks", F.greatest(F.col("diag"), F.lit(0)) + 1, F.col("item_len") + F.least(F.col("diag"), F.lit(0))).alias("doc_part")
    where = ["doc_id", "version", "item_id", "diag"]
    if bounded:
        hits = seeds.join(F.broadcast(item_seeds), "seed").select("doc_id", "version", "item_id", "item_len", diag.alias("diag"), "toks").select(*where, part)
    else:
        # Only seeds and places are shuffled; the texts come back for the hits alone.
        lean = seeds.select("seed", "doc_id", "version", "doc_at").join(item_seeds, "seed").select("doc_id", "version", "item_id", "item_len", diag.alias("diag")).distinct()
        lean = lean.withColumnsRenamed({"doc_id": "hit_id", "version": "hit_version"})
        back = lean.join(d, F.col("hit_id").eqNullSafe(F.col("doc_id")) & (F.col("hit_version") == F.col("version")))
        hits = back.select(*where, part)
    hits = hits.groupBy(*where).agg(F.first("doc_part").alias("doc_part"))
    per_item = items.groupBy("item_id").agg(F.collect_set("item_toks").alias("versions")).select("item_id", F.explode("versions").alias("item_toks"))
    laid = hits.join(F.broadcast(per_item) if bounded else per_item, "item_id")
    item_part = F.slice("item_toks", F.greatest(-F.col("diag"), F.lit(0)) + 1, F.size("doc_part"))
    same = F.zip_with("doc_part", item_part, lambda a, b: (a == b).cast("int"))
    laid = laid.withColumn("same", F.transform(same, lambda x: F.coalesce(x, F.lit(0)))).withColumn("width", F.least(F.lit(params.window), F.size("item_toks")))
    sums = F.transform(
        F.sequence(F.lit(1), F.size("same") - F.col("width") + 1),
        lambda i: F.aggregate(F.slice("same", i, F.col("width")), F.lit(0), lambda a, x: a + x),
    )
    best = F.when(F.size("same") >= F.col("width"), F.array_max(sums)).otherwise(F.lit(0))
    laid = laid.withColumn("best", best)
    allowed = F.floor(F.col("width") * params.max_substitutions / params.window)
    found = laid.where((F.col("best") > 0) & (F.col("best") >= F.col("width") - allowed))
    return found.groupBy("doc_id", "item_id").agg(
        F.countDistinct("diag").alias("n_overlaps"), F.max("best").cast("bigint").alias("best_matched"), F.max("width").cast("bigint").alias("best_window")
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """The documents without any verified overlap, columns as they were, whatever their names; a null doc_id stays."""
    name = fresh(docs, "leak")
    leaks = find_leaks(docs, benchmark, doc_id, text, params=params).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(leaks, column(doc_id) == F.col(name), "left_anti")
