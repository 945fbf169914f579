"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts.

All of it is built from Column expressions, so it runs inside the JVM. Spans are code points, end
exclusive. Possessive repeats keep each pattern linear in the text and free of recursion; a match
starts only at the start of a run of its first class, or where the last match ended, which finds the
same leftmost matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.names import fresh

# The base patterns, in the order in which kinds are listed.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE_PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Patterns that the method adds: confirmed by mod-97, or by context words nearby.
ADDED_PATTERNS = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
}
KINDS = [*BASE_PATTERNS, *ADDED_PATTERNS]
# A cheap substring or class test that a text must pass before the pattern runs.
_NEEDLE = {"email": "@", "phone": "+", "key": "IA"}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "key": 0.8}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "address|host|server|login",
    "card": "card|visa|credit|pay",
    "phone": "phone|call|tel|mobile",
    "iban": "iban|account|bank",
    "ssn": "ssn|social|security",
    "key": "key|secret|access|token",
}
NEGATIVE_CONTEXT = r"version|example|sample|order|invoice"


@dataclass(frozen=True)
class PiiParams:
    window: int = 40  # code points on either side in which context words count
    boost: float = 0.3
    penalty: float = 0.2
    threshold: float = 0.5  # for added kinds; base spans stay whatever their score


def luhn_ok(digits: Column) -> Column:
    """Luhn over a string of digits."""

    def step(acc, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return acc + doubled

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def mod97_ok(iban: Column) -> Column:
    """ISO 7064 mod-97 of an IBAN without spaces: letters count as 10 to 35."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def step(acc, c):
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(m, r"[\x20-]", "")
        return F.when(F.length(digits).between(12, 19), luhn_ok(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        plain = F.regexp_replace(m, " ", "")
        return F.when(F.length(plain).between(15, 34), mod97_ok(plain)).otherwise(False)
    if kind == "ssn":
        return m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    return F.lit(True)


def _spans(text: Column, kind: str, p: PiiParams) -> Column:
    """array<struct<start, rank, end, kind, score>> of one kind, in order."""
    pattern = {**BASE_PATTERNS, **ADDED_PATTERNS}[kind]
    rank = KINDS.index(kind)
    kind_of = "struct<start:bigint,rank:int,end:bigint,kind:string,score:double>"
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern, -1)
    pieces = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    start_acc = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{kind_of}>").alias("found"))

    def step(acc, x):
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        near = F.lower(F.substring(text, F.greatest(start - p.window + 1, F.lit(1)).cast("int"), F.least(start, F.lit(p.window)).cast("int")))
        after = F.lower(F.substring(text, (end + 1).cast("int"), F.lit(p.window)))
        around = F.concat(near, F.lit(" "), after)
        score = (
            F.lit(PRIOR[kind])
            + F.when(around.rlike(CONTEXT[kind]), p.boost).otherwise(0.0)
            - F.when(around.rlike(NEGATIVE_CONTEXT), p.penalty).otherwise(0.0)
        )
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).cast("double")
        keep = _valid(kind, x["m"])
        if kind not in BASE_PATTERNS:
            keep = keep & (score >= p.threshold)
        one = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), score.alias("score")
        ).cast(kind_of)
        return F.struct(
            end.cast("bigint").alias("at"), F.when(keep, F.concat(acc["found"], F.array(one))).otherwise(acc["found"]).alias("found")
        )

    found = F.aggregate(pieces, start_acc, step, lambda acc: acc["found"])
    worth = text.contains(_NEEDLE[kind]) if kind in _NEEDLE else text.rlike("[0-9]")
    return F.when(worth, found).otherwise(F.array().cast(f"array<{kind_of}>"))


def detect_pii(df: DataFrame, text: str = "text", out: str = "pii", params: PiiParams = PiiParams()) -> DataFrame:
    """Add `out`: array<struct<start, rank, end, kind, score>> ordered by start, then kind as listed.

    A null text counts as empty and gives an empty array, as does an empty text. Each row is judged by
    itself, so ties and repeated rows need no rule. All input columns stay; an input column named as
    `out` is replaced.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    every = F.concat(*[_spans(t, k, params) for k in KINDS])
    return df.withColumn(out, F.array_sort(every))


def redact(df: DataFrame, text: str = "text", params: PiiParams = PiiParams()) -> DataFrame:
    """Replace every span in `text` by its kind in brackets; overlapping spans become one tag. Null texts stay null; all other columns stay, whatever their names."""
    name = fresh(df, "pii")
    found = detect_pii(df, text, name, params)
    t = F.col(f"`{text}`")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, s):
        lead = F.substring(t, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = s["start"] >= acc["at"]
        tag = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["parts"], F.array(lead, tag))).otherwise(acc["parts"]).alias("parts"),
        )

    def finish(acc):
        tail = F.substring(t, (acc["at"] + 1).cast("int"), F.length(t))
        return F.concat(F.array_join(acc["parts"], ""), tail)

    clean = F.when(F.size(name) > 0, F.aggregate(F.col(name), zero, step, finish)).otherwise(t)
    return found.withColumn(text, clean).drop(name)


def pii_digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text", params: PiiParams = PiiParams()) -> DataFrame:
    """Per row: counts per base kind, the digest of the base spans, all spans as one string, the best score."""
    found = detect_pii(df.select(F.col(doc_id), F.col(text)), text, "__pii", params)
    show = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter(F.col("__pii"), lambda s: s["rank"] < len(BASE_PATTERNS))
    count = lambda k: F.size(F.filter(F.col("__pii"), lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        F.col(doc_id),
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(show(base).cast("binary"), 256).alias("base_sha256"),
        show(F.col("__pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform(F.col("__pii"), lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
