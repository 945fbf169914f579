"""Posting life cycle: capture checks, status, verification, archive ids, summaries and structured evidence.

Survey ids P35, P36, P39, P42, F7, F8, F10, F16-F18, D9, K8, A5, A7, A10, A11, A13, A21, A25, C7, R9, R11, R13,
R16, R20, R21, R23, W11, X7, T9.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions import urls as U
from siltstone.operators.reports import count_if
from siltstone.operators.retrieval import contains_phrase, form_contains, ochiai, phrase_form, tokens

# Status vocabularies and the signals of closed postings and interruptions.
ACTIVE_STATUS = ("开放", "待官网核验", "已捕获完整JD", "待核验")
CLOSED_SIGNAL = r"(?i)no longer accepting applications|no longer available|job (?:is )?closed|position (?:has been )?filled|posting (?:has been )?removed|职位已下线|停止招聘|招聘已结束|职位不存在|该职位已关闭"
TRUNCATED = r"(?i)(?:和|与|及|以及|或|包括|包含|and|or|including|such as|[,，:：;；(（])\s*$"
INTERRUPTIONS = (
    ("verification_required", r"code\s*[:=]\s*37(?![0-9])|环境存在异常|captcha|验证码|安全验证|访问频繁|verify"),
    ("login_required", r"login|登录|sign in|session"),
    ("network_error", r"timeout|timed out|network|connection|网络"),
)
LIMITED_STATUS = ("job_pages_not_indexed", "rate_limited", "verification_required", "search_source_error")
RELATION_CONFIDENCE = {"exact_equivalent": 1.0, "native_synonym": 0.98, "narrower_than": 0.94, "evidence_for": 0.94, "transferable_to": 0.78, "related_only": 0.48, "excluded": 0.0}
EVIDENCE_RANK = {"Direct": 4, "Credential Direct": 4, "Coursework Match": 2, "Credential Status Gap": 1}
EVIDENCE_ROWS, EVIDENCE_MOST = 250_000, 2_000_000  # candidates of a task, and where that would make more than UNSORTED tasks
UNSORTED = 200  # up to so many tasks Spark's shuffle writes rows as they come; beyond, it holds a file split's rows to sort them


def parse_time(c: Column) -> Column:
    """ISO time, UTC where no offset is given; null if it does not parse."""
    return F.coalesce(F.try_to_timestamp(T.squeeze(c)), F.try_to_timestamp(T.squeeze(c), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def is_active(status: Column) -> Column:
    """F10."""
    return F.coalesce(status.isin(*ACTIVE_STATUS), F.lit(False))


def deadline_passed(deadline: Column, kind: Column, today: Column) -> Column:
    """A dated deadline before today; anything else has not passed."""
    return F.coalesce((kind == "date") & deadline.rlike(r"^\d{4}-\d{2}-\d{2}$") & (deadline < F.date_format(today, "yyyy-MM-dd")), F.lit(False))


def capture_error(title: Column, description: Column, url: Column) -> Column:
    """F16: why a captured page cannot be used; null if it can."""
    d = F.trim(F.coalesce(description, F.lit("")))
    return (
        F.when(F.trim(F.coalesce(title, F.lit(""))) == "", "no_title")
        .when(F.length(d) < 20, "no_description")
        .when(d.rlike(TRUNCATED), "truncated")
        .when(~F.coalesce(url.rlike("(?i)^https?://[^/]+"), F.lit(False)), "no_url")
    )


def interruption(log: Column) -> Column:
    """the kind of a collector's failure from the end of its log."""
    t = F.lower(F.regexp_extract(T.squeeze(log), "(?s)(.{0,900})$", 1))
    out = F.lit("source_error")
    for kind, pattern in reversed(INTERRUPTIONS):
        out = F.when(t.rlike(pattern), kind).otherwise(out)
    return out


def in_region(location: Column, inside: str, outside: str, named: str) -> Column:
    """blank passes; a foreign name fails unless the region itself is named; else a regional name is needed."""
    place = T.squeeze(location)
    return (place == "") | F.when(place.rlike(outside) & ~place.rlike(named), False).otherwise(place.rlike(inside))


def unsupported_core(title: Column, description: Column, signals: Sequence[str], core: str, subject: str) -> Column:
    """F8: a signal in the title, or a core phrase within 30 characters before the subject."""
    t = F.lower(F.coalesce(title, F.lit("")))
    named = F.lit(False)
    for s in signals:
        named = named | t.contains(s)
    return named | F.lower(F.coalesce(description, F.lit(""))).rlike(f"(?:{core}).{{0,30}}(?:{subject})")


def verification(status_code: Column, body: Column, title_share: Column) -> Column:
    """The decision from a fetched official page."""
    text = F.coalesce(body, F.lit(""))
    return (
        F.when(status_code.isin(404, 410), "closed")
        .when((status_code != 200) | (text == ""), "unknown")
        .when(text.rlike(CLOSED_SIGNAL), "closed")
        .when(title_share >= 0.55, "open")
        .otherwise("manual")
    )


def company_code(company: Column) -> Column:
    """Three letters or digits of the name, filled with X."""
    joined = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(company, F.lit(""))), "[^A-Z0-9]+", ""), "^(?:THE|INC|LLC|LTD|CORP)", "")
    base = F.when(joined == "", F.upper(T.base36(T.fnv1a(F.coalesce(company, F.lit("")))))).otherwise(joined)
    return F.rpad(F.substring(base, 1, 3), 3, "X")


def archive_id(company: Column, number: Column, at: Column, existing: Column) -> Column:
    """A well-formed id stays; else APP-<New York year>-<code>-<number>."""
    old = F.upper(F.trim(F.coalesce(existing, F.lit(""))))
    year = F.year(F.from_utc_timestamp(at, "America/New_York")).cast("string")
    return F.when(old.rlike(r"^APP-\d{4}-[A-Z0-9]{3,12}-\d{3,}$"), old).otherwise(F.concat_ws("-", F.lit("APP"), year, company_code(company), T.zero_filled(number, 4)))


def archive_path(ident: Column) -> Column:
    return F.concat_ws("/", F.lit("applications"), F.regexp_extract(ident, r"^APP-(\d{4})-", 1), ident)


def initial_class(c: Column) -> Column:
    """Six classes to four."""
    return (
        F.when(c.isin("Direct", "Credential Direct", "Coursework Match"), "Direct")
        .when(c == "Strong Transferable", "Transferable")
        .when(c.isin("Adjacent", "Credential Status Gap"), "Adjacent")
        .otherwise("Unsupported")
    )


def distinct_url(url: Column, *identity: Column) -> Column:
    """K8: another URL for a posting that shares its own with a different one."""
    mark = T.base36(T.fnv1a(F.concat_ws("::", *[F.coalesce(c, F.lit("")) for c in identity])))
    return F.concat(F.regexp_replace(url, "#.*$", ""), F.lit("#posting-"), mark)


def capture_id(company: Column, title: Column, location: Column, url: Column, description: Column) -> Column:
    """An id from the content of a page that names no posting: the application's short id, and 64 bits more, since short ids of 32 bits collide from some ten thousand pages on."""
    parts = F.concat_ws("::", T.identity_text(company), T.identity_text(title), T.location_key(location), U.canonical_url(url, U.IDENTITY), T.squeeze(description))
    return F.concat(F.lit("capture-1-"), T.base36(T.fnv1a(parts)), F.lit("-"), F.substring(F.sha2(parts.cast("binary"), 256), 1, 16))


def requirement_numbers(df: DataFrame, order: Sequence[Column], prefix: str = "JD-R") -> DataFrame:
    """Stable numbers of one request's requirements."""
    n = F.row_number().over(W.orderBy(*order))  # the requirements of one text
    return df.withColumn("requirement_id", F.concat(F.lit(prefix), F.lpad(n.cast("string"), 3, "0")))


def scan_accounting(scans: DataFrame) -> DataFrame:
    """A5: per source and query, whether scanned = matched + the sum of the rejection counters.

    scans: source, query, scanned, matched, rejected map<string,bigint>.
    """
    per = F.aggregate(F.map_values("rejected"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = scans.select("source", "query", "scanned", "matched", F.coalesce(per, F.lit(0)).alias("rejected_total"))
    total = rows.groupBy("source", "query").agg(*[F.sum(c).alias(c) for c in ("scanned", "matched", "rejected_total")])
    return total.withColumn("accounted_for", F.col("scanned") == F.col("matched") + F.col("rejected_total"))


def roll_up(results: DataFrame, status: str = "status", sums: Sequence[str] = ("jobs_discovered", "jobs_eligible")) -> DataFrame:
    """One row over sources: completed, partial or failed."""
    done = count_if(F.coalesce(F.col(status) == "completed", F.lit(False)))
    a = results.agg(done.alias("sources_completed"), (F.count("*") - done).alias("sources_failed"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
    state = F.when(F.col("sources_failed") == 0, "completed").when(F.col("sources_completed") > 0, "partial").otherwise("failed")
    return a.select(state.alias("status"), *a.columns)


def platform_validation(scans: DataFrame, minimum: int) -> DataFrame:
    """Totals per source, whether every scan of it was limited, and whether the minimum is reached over all."""
    a = scans.groupBy("source").agg(
        F.sum("scanned").alias("scanned"), F.sum("valid").alias("valid"), F.sum("matched").alias("matched"),
        F.every(F.col("source_status").isin(*LIMITED_STATUS)).alias("limited"), F.every("accounted_for").alias("reconciled"),
    )
    whole = a.agg((F.sum("matched") >= minimum).alias("enough"), F.every("limited").alias("all_limited"), (F.max("valid") > 0).alias("usable"))
    return a.crossJoin(F.broadcast(whole))  # one row


def registry_rows(rows: DataFrame, company: str, sample: str, ordinal: str) -> DataFrame:
    """A10: per company the first non-empty sample and the number of rows."""
    first = F.min_by(sample, F.when(F.coalesce(F.col(sample), F.lit("")) != "", F.col(ordinal)))
    return rows.groupBy(company).agg(F.coalesce(first, F.lit("")).alias("sample"), F.count("*").alias("n"))


def raw_count(rows: DataFrame, key: str) -> DataFrame:
    """Distinct keys plus the rows without one."""
    k = F.coalesce(F.col(key), F.lit(""))
    return rows.agg((F.count_distinct(F.when(k != "", k)) + count_if(k == "")).alias("n"))


def quality_board(checks: DataFrame, issues: str = "issue_keys") -> DataFrame:
    """Jobs per issue."""
    return checks.select(F.explode(F.array_distinct(issues)).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def all_companies(pool: DataFrame, jobs: DataFrame, key: str, order: str) -> DataFrame:
    """The pool and the companies seen in jobs alone, the first row of each."""
    only = jobs.join(pool.select(key).distinct(), key, "left_anti")
    rest = [c for c in jobs.columns if c != key]
    first = only.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
    return pool.unionByName(first, allowMissingColumns=True)


def apply_rules(rows: DataFrame, rules: DataFrame, title: str, text: str, score: str) -> DataFrame:
    """approved rules as substrings: includes add up to 15 points, an excluding title blocks the row.

    rules: kind (include or exclude), term, boost; a small configuration table that becomes literal arrays.
    """
    found = rules.groupBy("kind").agg(F.collect_list(F.struct(F.lower("term").alias("term"), F.col("boost").cast("int").alias("boost"))).alias("terms")).collect()
    terms = {r["kind"]: r["terms"] for r in found}
    t, head = F.lower(F.coalesce(F.col(text), F.lit(""))), F.lower(F.coalesce(F.col(title), F.lit("")))
    boost = sum((F.when(t.contains(x["term"]) | head.contains(x["term"]), x["boost"]).otherwise(0) for x in terms.get("include", [])), F.lit(0))
    blocked = F.lit(False)
    for x in terms.get("exclude", []):
        blocked = blocked | head.contains(x["term"])
    return rows.withColumns({score: F.least(F.lit(100), F.col(score) + F.least(F.lit(15), boost)), "blocked": blocked})


def relations(relation: DataFrame, pairs: DataFrame) -> DataFrame:
    """Confidence of the direct relation of each (src, dst) pair, else of its best two-hop path; none if excluded.

    relation: src, dst, type. A direct relation of any type decides; two hops avoid related_only and excluded.
    """
    table = F.create_map(*[F.lit(x) for kv in RELATION_CONFIDENCE.items() for x in kv])
    direct = relation.groupBy("src", "dst").agg(F.min("type").alias("type"))
    r = relation.where(~F.col("type").isin("related_only", "excluded"))
    a, b = r.alias("a"), r.alias("b")
    hops = a.join(b, F.col("a.dst") == F.col("b.src")).groupBy(F.col("a.src").alias("src"), F.col("b.dst").alias("dst")).agg(
        F.max(F.when((F.col("a.type") == "transferable_to") | (F.col("b.type") == "transferable_to"), 0.7).otherwise(0.86)).alias("two")
    )
    j = pairs.join(direct, ["src", "dst"], "left").join(hops, ["src", "dst"], "left")
    best = F.when(F.col("src") == F.col("dst"), 1.0).when(F.col("type").isNotNull(), F.element_at(table, F.col("type"))).otherwise(F.coalesce("two", F.lit(0.0)))
    return j.select("src", "dst", best.alias("confidence"))


def term_overlap(terms: Column, other: Column) -> Column:
    """1 if one of the terms is a phrase of the other text or holds it, else the Ochiai similarity of their tokens."""
    hit = T.once(phrase_form(other), lambda o: F.exists(F.transform(terms, phrase_form), lambda t: form_contains(o, t) | form_contains(t, o)))
    return F.when(hit, 1.0).otherwise(ochiai(F.flatten(F.transform(terms, tokens)), tokens(other)))


def flagged_groups(requirement: Column, guardrail: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Whether a guardrail names the same group of terms as the requirement; R9 with one group per scope."""
    any_of = lambda text, terms: sum((F.when(contains_phrase(text, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0)) > 0
    out = F.lit(False)
    for g in groups:
        out = out | (any_of(requirement, g) & any_of(guardrail, g))
    return out


def best_evidence(candidates: DataFrame, most: int = 6) -> DataFrame:
    """Per requirement the best candidate of each fact, by class and score, at most six.

    candidates: requirement_id, fact_id, classification, score. Tasks get about EVIDENCE_ROWS rows each, in large inputs
    up to EVIDENCE_MOST; the candidates of one requirement are dealt to 16 parts first, each of which hands on its own
    best: what is among the best of all is among those of its part.
    """
    n = candidates.count()
    tasks = max(1, min(UNSORTED, math.ceil(n / EVIDENCE_ROWS)), math.ceil(n / EVIDENCE_MOST))
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in EVIDENCE_RANK.items() for x in kv]), F.col("classification")), F.lit(0))
    rows = candidates.select("requirement_id", "fact_id", F.struct(rank.alias("rank"), "score", "classification").alias("b"))
    rows = rows.withColumn("__deal", F.pmod(F.xxhash64("fact_id", "b"), F.lit(16)).cast("int"))
    for keys in (["requirement_id", "__deal"], ["requirement_id"]):
        best = rows.repartition(tasks, *keys).groupBy(*keys, "fact_id").agg(F.max("b").alias("b"))
        order = W.partitionBy(*keys).orderBy(F.desc("b.rank"), F.desc("b.score"), "fact_id")
        rows = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return rows.select("requirement_id", "fact_id", "b.classification", "b.score", "place")


def template_cover(matches: DataFrame, most: int = 4, enough: float = 0.78) -> DataFrame:
    """Per requirement its four best template snippets and whether one covers it.

    matches: requirement_id, snippet_id, concept, confidence, n_facts.
    """
    one = matches.groupBy("requirement_id", "snippet_id", "concept").agg(F.max(F.struct("confidence", (F.col("n_facts") > 0).alias("facts"))).alias("m"))
    order = W.partitionBy("requirement_id").orderBy(F.desc("m.confidence"), F.desc("m.facts"), "snippet_id", "concept")
    top = one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return top.groupBy("requirement_id").agg(F.max(F.col("m.confidence") >= enough).alias("covered"), F.count("*").alias("n"))


def gap_status(covered: Column, supported: Column, adjacent: Column) -> Column:
    """The four states of a requirement."""
    return F.when(covered, "covered").when(supported, "supported_gap").when(adjacent, "adjacent_gap").otherwise("unsupported_gap")


def packet(requirement: Sequence[str]) -> Column:
    """The columns as one JSON text, in the given order."""
    return F.to_json(F.struct(*requirement))
