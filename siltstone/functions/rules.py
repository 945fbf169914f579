"""Rule tables as Column expressions: classifiers, tags, ladders, rubrics and number extraction.

A rule is (label, pattern); its order is data. Survey ids P23-P29, P31, P38, F3, F9, C6; `screening` has the rubrics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, str]


def word(*terms: str) -> str:
    """A pattern for any of the terms as a whole ASCII word, the same in every regex dialect."""
    return f"(^|[^a-z0-9])({'|'.join(terms)})([^a-z0-9]|$)"


def first_match(text: Column, rules: Sequence[Rule], default: str | None = None) -> Column:
    """The label of the first rule that fits."""
    out = None
    for label, pattern in rules:
        out = F.when(text.rlike(pattern), label) if out is None else out.when(text.rlike(pattern), label)
    return out.otherwise(F.lit(default))


def all_matches(text: Column, rules: Sequence[Rule], most: int | None = None) -> Column:
    """The labels of all rules that fit, in the rules' order, at most `most`."""
    found = F.filter(F.array(*[F.when(text.rlike(p), F.lit(label)) for label, p in rules]), lambda x: x.isNotNull())
    return F.slice(found, 1, most) if most else found


def blocked_or_supported(text: Column, block: str, support: str) -> Column:
    """P25: `blocked` is looked for before `supported`."""
    return F.when(text.rlike(block), "blocked").when(text.rlike(support), "supported").otherwise("unknown")


def largest_number(text: Column, pattern: str, group: int = 1) -> Column:
    """The largest number that the pattern's group finds; null if none."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(pattern), group), lambda x: x.try_cast("int")))


# Monthly salary floors in thousands, as (pattern, multiplier); annual first, then daily, then monthly.
SALARY_RULES = (
    (r"([0-9]+(?:\.[0-9]+)?)\s*(?:-|~|至)\s*[0-9]+(?:\.[0-9]+)?\s*万\s*/?\s*年", 10 / 12),
    (r"([0-9]+(?:\.[0-9]+)?)\s*(?:-\s*[0-9]+(?:\.[0-9]+)?\s*)?元\s*/\s*(?:天|日)", 21.75 / 1000),
    (r"([0-9]+(?:\.[0-9]+)?)\s*千\s*(?:-|~|至)\s*[0-9]+(?:\.[0-9]+)?\s*万", 1.0),
    (r"([0-9]+(?:\.[0-9]+)?)\s*(?:-|~|至)\s*[0-9]+(?:\.[0-9]+)?\s*万", 10.0),
    (r"([0-9]+(?:\.[0-9]+)?)\s*(?:-|~|至)\s*[0-9]+(?:\.[0-9]+)?\s*(?:千|[kK])", 1.0),
    (r"(?:薪资|月薪)\D{0,4}([0-9]{4,6})", 1 / 1000),
    (r"([0-9]{4,6})\s*(?:-|~|至)\s*[0-9]{4,6}", 1 / 1000),
)


def monthly_floor(text: Column, rules: Sequence[tuple[str, float]] = SALARY_RULES) -> Column:
    """The first rule's number times its multiplier; null if no rule fits."""
    return F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, p, 1).cast("double") * m) for p, m in rules])


DEADLINE_SIGNAL = r"(?i)(?:deadline|apply by|applications? close|closing date|closes on|last date to apply|applications? due|申请截止|报名截止|(?<!申请|报名)截止)"
# The four date forms, with the groups of year, month and day. The edges are those of ASCII words in any Java.
_EDGES = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
DATE_FORMS = (
    (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})".join(_EDGES), (1, 2, 3)),
    (r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})".join(_EDGES), (3, 1, 2)),
    (r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", (1, 2, 3)),
)
NAMED_DATE = r"(?i)" + (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
    r"\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"
).join(_EDGES)
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"


def deadline(text: Column) -> Column:
    """The first valid date near a deadline signal, from 20 characters before its start to 140 behind it; null if none.

    White space counts as one space. A match is empty and stands 20 characters before its signal, so each
    signal has a window of its own, however close the next one is.
    """
    padded = F.concat(F.lit(" " * 20), F.trim(F.regexp_replace(text, r"(?U)[\s\uFEFF]+", " ")))
    windows = F.regexp_extract_all(padded, F.lit(f"(?is)(?=.{{20}}{DEADLINE_SIGNAL[4:]})(?=(.{{1,160}}))"), 1)

    def read(w):
        dates = []
        for form, (y, m, d) in DATE_FORMS:
            part = lambda g, form=form: F.regexp_extract(w, form, g)
            dates.append(F.when(w.rlike(form), F.try_to_date(F.concat_ws("-", part(y), F.lpad(part(m), 2, "0"), F.lpad(part(d), 2, "0")), "yyyy-MM-dd")))
        form = NAMED_DATE
        month = ((F.position(F.lower(F.substring(F.regexp_extract(w, form, 1), 1, 3)), F.lit(_MONTHS)) + 3) / 4).cast("int").cast("string")
        named = F.concat_ws("-", F.regexp_extract(w, form, 3), F.lpad(month, 2, "0"), F.lpad(F.regexp_extract(w, form, 2), 2, "0"))
        return F.coalesce(*dates, F.when(w.rlike(form), F.try_to_date(named, "yyyy-MM-dd")))

    return F.get(F.filter(F.transform(windows, read), lambda d: d.isNotNull()), F.lit(0))


def ladder(reasons: Sequence[tuple[str, Column]]) -> Column:
    """the first reason that holds; null keeps the row."""
    out = None
    for label, test in reasons:
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def points(text: Column, rules: Sequence[tuple[str, int]], cap: int | None = None) -> Column:
    """The sum of the points of the rules that fit, at most `cap`."""
    total = sum((F.when(text.rlike(p), n).otherwise(0) for p, n in rules), F.lit(0))
    return F.least(total, F.lit(cap)) if cap is not None else total


def clamp(c: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def band(score: Column, bands: Sequence[tuple[int, str]], default: str) -> Column:
    """The label of the first lower bound that the score reaches."""
    out = None
    for low, label in bands:
        out = F.when(score >= low, label) if out is None else out.when(score >= low, label)
    return out.otherwise(default)


def display_rank(saved: Column, manual: Column, has_description: Column, skills_json: Column, score: Column) -> Column:
    """The length of the skills' JSON text, not of the list, counts up to 10."""
    flag = lambda c, n: F.when(c, n).otherwise(0)
    return flag(saved, 100) + flag(manual, 30) + flag(has_description, 10) + F.least(F.lit(10), F.length(skills_json)) + F.least(F.lit(10.0), score / 10)
