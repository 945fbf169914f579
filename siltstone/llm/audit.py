"""Filter interaction audit by inclusion-exclusion.

One aggregate counts, for every set of filters, the documents that fail all of them (sums of flag products).
Möbius inversion of these joint failures gives the survivors of every set, and from the survivors follows
each step of each order of the filters: kept, removed, redundant and unique failures. The signed joint
failures are the Harsanyi dividends of the game "documents removed by a set", so a filter's Shapley value
is the sum of the dividends it takes part in, each shared equally.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILTERS = "ABCDE"


@dataclass(frozen=True)
class FilterParams:
    least_words: int = 100  # A fails below
    distinct_percent: int = 80  # B: distinct words of all
    upper_percent: int = 10  # C: A to Z of all code points
    symbols: str = "[#$%&*|]"  # D


def quality_flags(text: Column, p: FilterParams) -> dict[str, Column]:
    """Failures of A to D of a whole text; null counts as empty. Words are maximal runs without space and tab to carriage return."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < p.least_words,
        "B": 100 * F.size(F.array_distinct(words)) < p.distinct_percent * F.size(words),
        "C": 100 * upper > p.upper_percent * F.length(text),
        "D": text.rlike(p.symbols),
    }


def _total(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def audit_counts(counts: DataFrame, filters: Sequence[str], part: str, n: str, good: str, toxic: str) -> DataFrame:
    """counts: boolean columns `filters`, and how many documents, good and toxic ones among them, a row stands for.

    Returns one row per part, order of the filters and step: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley. Filter names are single letters.
    """
    k = len(filters)
    sets = range(1 << k)
    holds = lambda s: [i for i in range(k) if s >> i & 1]
    one = F.lit(True)
    fails = lambda s: one if not s else _all([F.col(filters[i]) for i in holds(s)])
    joint = [F.sum(F.when(fails(s), F.col(c)).otherwise(0)).alias(f"{tag}{s}") for tag, c in (("n", n), ("g", good), ("t", toxic)) for s in sets]
    sums = counts.groupBy(F.col(part).alias("part")).agg(*joint)
    sign = lambda s: -1 if len(holds(s)) % 2 else 1
    survivors = lambda tag: F.array(*[_total([sign(t) * F.col(f"{tag}{t}") for t in sets if t & ~s == 0]) for s in sets])
    share = lambda i: _total([-sign(t) * (factorial(k) // len(holds(t))) * F.col(f"n{t}") for t in sets if t >> i & 1])
    known = sums.select(
        "part",
        F.array(*[F.col(f"n{1 << i}") for i in range(k)]).alias("fail"),
        *[survivors(tag).alias(tag) for tag in "ngt"],
        F.array(*[share(i) for i in range(k)]).alias("shares"),
    )
    orders = F.explode(F.array(*[F.lit("".join(o)) for o in permutations(filters)]))
    steps = known.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    mask = lambda letters: _total([F.when(letters.contains(f), F.lit(1 << i)).otherwise(0) for i, f in enumerate(filters)])
    steps = steps.withColumns(
        {
            "before": mask(F.substring("filter_order", F.lit(1), F.col("step") - 1)),
            "after": mask(F.substring("filter_order", F.lit(1), F.col("step"))),
            "at": F.instr(F.lit("".join(filters)), F.substring("filter_order", F.col("step"), F.lit(1))) - 1,
        }
    )
    lost = lambda tag: F.get(tag, F.col("before")) - F.get(tag, F.col("after"))
    others = _total([F.when(F.col("at") == i, F.lit((1 << k) - 1 - (1 << i))).otherwise(0) for i in range(k)])
    out = {
        "kept": F.get("n", F.col("after")),
        "removed": lost("n"),
        "redundant": F.get("fail", F.col("at")) - lost("n"),
        "unique_fails": F.get("n", others) - F.get("n", F.lit((1 << k) - 1)),
        "good_lost": lost("g"),
        "toxic_lost": lost("t"),
        "shapley": F.get("shares", F.col("at")),
    }
    return steps.select("part", "filter_order", "step", *[c.cast("long").alias(name) for name, c in out.items()])


def _all(flags: list[Column]) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out & f
    return out


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    quality: str = "quality",
    toxic: str = "toxic",
    params: FilterParams = FilterParams(),
) -> DataFrame:
    """The audit of five filters on whole texts, by language: 600 rows per value of `lang` (null: the empty string).

    A null text is empty. E fails a row whose text a row of a smaller id has, in any part; rows of one id and text
    stand or fall together, and a row of a null id never fails E nor makes another fail it. A document counts as good
    (toxic) if any of its label rows says 1; null and missing labels say neither. Repeated rows all count. Very long
    texts are read whole, and only digests and flags are shuffled, equal ones combined first. An empty
    table gives no rows. Other columns are not read.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    lean = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")).alias("part"),
        F.sha2(t.cast("binary"), 256).alias("digest"),
        *[c.alias(f) for f, c in quality_flags(t, params).items()],
    )
    rows = lean.groupBy(*lean.columns).agg(F.count("*").alias("rows"))
    says = lambda c: F.coalesce(F.max(F.col(f"`{c}`") == 1), F.lit(False))
    marks = labels.where(F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("labelled")).agg(says(quality).alias("good"), says(toxic).alias("toxic"))
    marked = rows.join(marks, F.col("doc_id") == F.col("labelled"), "left")
    keys = ["digest", "part", *"ABCD", "good", "toxic"]
    marked = marked.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # Equal rows of one text become one row, however many there are, with those of its smallest id told apart.
    texts = marked.groupBy(*keys).agg(
        F.sum("rows").alias("n"), F.min("doc_id").alias("low"), F.coalesce(F.min_by("rows", "doc_id"), F.lit(0)).alias("at_low"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("rows"))), F.lit(0)).alias("unnamed")
    )
    first = F.min("low").over(W.partitionBy("digest"))
    again = F.col("n") - F.col("unnamed") - F.when(F.col("low") == first, F.col("at_low")).otherwise(0)
    split = texts.withColumn("again", F.coalesce(again, F.lit(0)))
    copies = F.array(F.struct(F.lit(False).alias("E"), (F.col("n") - F.col("again")).alias("n")), F.struct(F.lit(True).alias("E"), F.col("again").alias("n")))
    counted = split.select("part", *"ABCD", "good", "toxic", F.explode(copies).alias("copy")).select("part", *"ABCD", "copy.E", "copy.n", "good", "toxic")
    counted = counted.select("part", *FILTERS, "n", F.when(F.col("good"), F.col("n")).otherwise(0).alias("good"), F.when(F.col("toxic"), F.col("n")).otherwise(0).alias("toxic"))
    return audit_counts(counted, FILTERS, "part", "n", "good", "toxic")


AUDIT_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
           min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS lowest
    FROM documents
), l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
           || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
           || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END
           || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
           || CASE WHEN coalesce(d.doc_id > lowest, false) THEN 'E' ELSE '' END AS failed
    FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), p AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
    SELECT a.c || b.c || c.c || d.c || e.c AS filter_order
    FROM x a JOIN x b ON b.c <> a.c JOIN x c ON c.c NOT IN (a.c, b.c) JOIN x d ON d.c NOT IN (a.c, b.c, c.c) JOIN x e ON e.c NOT IN (a.c, b.c, c.c, d.c)
), s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, filter_order[k] AS c, filter_order[1:k - 1] AS before FROM o, range(1, 6) r(k)),
r AS (
    SELECT part, filter_order, step, c, before, n, good, toxic, failed,
           contains(failed, c) AS fails,
           length(before) > 0 AND length(translate(failed, before, '')) < length(failed) AS gone
    FROM p, s
), q AS (
    SELECT part, filter_order, step, c,
           sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN failed = c THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost
    FROM r GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley
FROM q
"""
