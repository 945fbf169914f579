"""The verification of a posting on its official page: ladder, evidence and summary (C7, A8), with the verifier's own rules of P7, P25 and F15."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import once, squeeze
from siltstone.functions.urls import host
from siltstone.names import fresh

# What a page of a closed posting says.
CLOSED_SIGNALS = (
    "job is no longer available",
    "position is no longer available",
    "this job has expired",
    "job posting has expired",
    "position has been filled",
    "no longer accepting applications",
    "job not found",
)
# Refusal and support of sponsorship, in the order in which they are looked for.
SPONSORSHIP_BLOCK_PATTERNS = (
    r"(?:will not|does not|do not|unable to|not eligible to).{0,80}(?:sponsor|sponsorship)",
    r"(?:sponsorship|visa sponsorship).{0,80}(?:not available|not provided|unavailable)",
    r"must be (?:a )?u\.?s\.? citizen",
)
SPONSORSHIP_SUPPORT_PATTERNS = (
    r"(?:visa|h-?1b).{0,80}(?:sponsor|sponsorship)",
    r"sponsorship (?:is )?available",
    r"eligible for (?:employment|visa) sponsorship",
)
# Application ids in a URL and a page's text, and what is none.
APPLICATION_ID_PATTERNS = (
    r"(?:[?&]|\b)(?:jobId|job_id|jobReq|gh_jid)=([A-Za-z0-9._-]{2,80})",
    r"/jobs?/([A-Za-z]{0,12}\d[A-Za-z0-9_-]{2,63})(?:/|\s|$)",
    r"\b(?:requisition|req(?:uisition)? id|job id)\s*[:#]?\s*([A-Z]{0,4}\d[A-Z0-9-]{2,63})",
)
APPLICATION_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{1,79}$"
TITLE_IGNORED = ("the", "and", "or", "of", "for", "a", "an", "i", "ii", "iii")
# Statuses, labels and notes.
OPEN, CLOSED, MANUAL = "开放", "已关闭", "待官网核验"
BLOCKED, SUPPORTED, UNCLEAR = "明确不支持", "可能支持", "JD 未明确"
NOT_FOUND = "未自动定位到可审计的公司官网或官方 ATS 页面。"
IS_CLOSED = "公司页面显示岗位已关闭或不再接受申请。"
IS_OPEN = "已在公司官网或官方 ATS 找到完整且仍开放的具体 JD。"
UNPROVEN = "已定位公司页面，但未取得足够证据确认具体 JD 仍开放。"
LEAST_TITLE, LEAST_DESCRIPTION, MOST_DESCRIPTION, TITLE_PART = 0.55, 300, 120_000, 1500


def title_share(expected: Column, actual: Column) -> Column:
    """the share of the expected title's words, small words aside, that the other text has; 0 without any."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*TITLE_IGNORED)))
    want = words(expected)
    return F.when(F.size(want) > 0, F.size(F.array_intersect(want, words(actual))) / F.size(want)).otherwise(0.0)


def sponsorship(text: Column) -> Column:
    """P25: struct<visa, proof>: the label and the words that gave it; refusals are looked for first."""
    return once(F.coalesce(text, F.lit("")), _sponsorship_of)


def _sponsorship_of(t: Column) -> Column:
    out = None
    for label, patterns in ((BLOCKED, SPONSORSHIP_BLOCK_PATTERNS), (SUPPORTED, SPONSORSHIP_SUPPORT_PATTERNS)):
        for p in patterns:
            found = F.struct(F.lit(label).alias("visa"), squeeze(F.regexp_extract(t, f"(?i){p}", 0)).alias("proof"))
            out = F.when(t.rlike(f"(?i){p}"), found) if out is None else out.when(t.rlike(f"(?i){p}"), found)
    return out.otherwise(F.struct(F.lit(UNCLEAR).alias("visa"), F.lit("").alias("proof")))


def normal_id(c: Column) -> Column:
    return once(squeeze(c), lambda t: F.when(t.rlike(APPLICATION_ID), t).otherwise(""))


def page_application_id(url: Column, text: Column, identifier: Column) -> Column:
    """The page's own identifier, else what the first form finds in URL and text that is well-formed; empty if there is none."""
    some = lambda c: once(normal_id(c), lambda t: F.nullif(t, F.lit("")))
    found = lambda both: F.coalesce(*[some(F.regexp_extract(both, f"(?i){p}", 1)) for p in APPLICATION_ID_PATTERNS], F.lit(""))
    return F.coalesce(some(identifier), once(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(text, F.lit(""))), found))


def verify(rows: DataFrame) -> DataFrame:
    """Rows with status, note, description, application_id, visa, proof, canonical_url, source and evidence.

    rows: title, application_id; official_url (empty if none was found) and what was fetched there: final_url, status_code (null: no
    connection), page_text, and the posting found in it: posting_title, posting_description, posting_id (all null without one).
    404 and 410 close a posting, other failures leave it to be verified by hand, and so does a page that does not prove it: open is one with
    a posting of at least 300 characters whose title shares 0.55 of the words. Columns of the results' names are replaced, all others stay.
    """
    code = F.col("status_code")
    # Working columns: what several results read is computed once.
    read_as = {k: fresh(rows, f"__{k}") for k in ("page", "description", "closed", "open", "visa", "ident")}
    page, description, closed, is_open, visa, ident = (F.col(n) for n in read_as.values())
    text = F.coalesce(F.col("page_text"), F.lit(""))
    found = F.coalesce(F.col("official_url"), F.lit("")) != ""
    gone, read = F.coalesce(code.isin(404, 410), F.lit(False)), F.coalesce(code == 200, F.lit(False)) & (text != "")
    has = F.col("posting_title").isNotNull() | F.col("posting_description").isNotNull()
    rows = rows.withColumn(read_as["page"], squeeze(text))
    rows = rows.withColumn(read_as["description"], F.when(has, squeeze(F.col("posting_description"))).otherwise(page))
    own = F.nullif(squeeze(F.col("posting_title")), F.lit(""))
    titled = title_share(squeeze(F.col("title")), F.coalesce(own, F.substring(page, 1, TITLE_PART))) >= LEAST_TITLE
    signal = once(F.lower(page), lambda t: F.exists(F.array(*[F.lit(s) for s in CLOSED_SIGNALS]), lambda s: t.contains(s)))
    pick = lambda *cases: F.when(~found, cases[0]).when(gone, cases[1]).when(~read, cases[2]).when(closed, cases[3]).when(is_open, cases[4]).otherwise(cases[5])
    failed = F.concat(F.lit("公司页面暂时无法自动读取（HTTP "), F.coalesce(F.nullif(code, F.lit(0)).cast("string"), F.lit("连接失败")), F.lit("）。"))
    judged = found & ~gone & read
    url = F.col("final_url")
    rows = rows.withColumns(
        {
            read_as["closed"]: judged & signal,
            read_as["open"]: judged & has & (F.length(description) >= LEAST_DESCRIPTION) & titled,
            read_as["visa"]: F.when(judged, sponsorship(F.when(description != "", description).otherwise(page))),
            read_as["ident"]: F.when(judged, F.coalesce(F.nullif(page_application_id(url, page, F.col("posting_id")), F.lit("")), normal_id(F.col("application_id")))),
        }
    )
    out = rows.withColumns(
        {
            "status": pick(F.lit(MANUAL), F.lit(CLOSED), F.lit(MANUAL), F.lit(CLOSED), F.lit(OPEN), F.lit(MANUAL)),
            "note": pick(F.lit(NOT_FOUND), F.concat(F.lit("公司页面返回 HTTP "), code.cast("string"), F.lit("。")), failed, F.lit(IS_CLOSED), F.lit(IS_OPEN), F.lit(UNPROVEN)),
            "description": F.when(judged, F.substring(description, 1, MOST_DESCRIPTION)).otherwise(""),
            "visa": F.when(judged, visa["visa"]),
            "proof": F.when(judged, visa["proof"]).otherwise(""),
            "canonical_url": F.when(judged, url),
            "source": F.when(judged, F.concat(F.lit("官网核验 · "), host(url))),
            "application_id": F.when(judged, ident).otherwise(F.col("application_id")),
        }
    )
    parts = [F.col("note"), F.concat(F.lit("官网："), url), F.concat(F.lit("岗位编号："), F.coalesce(F.nullif("application_id", F.lit("")), F.lit("未提取"))), F.concat(F.lit("Sponsorship："), F.col("visa"))]
    proof = F.when(F.col("proof") != "", F.concat(F.lit("原文证据："), F.col("proof")))
    return out.withColumn("evidence", F.when(judged, F.concat_ws("；", *parts, proof))).drop(*read_as.values())


def summary(verified: DataFrame) -> DataFrame:
    """One row of counts of verified rows: received, open_verified, closed, needs_manual, urls_found, ids_found, sponsorship_explicit."""
    some = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    return verified.agg(
        F.count("*").alias("received"), F.count_if(F.col("status") == OPEN).alias("open_verified"), F.count_if(F.col("status") == CLOSED).alias("closed"), F.count_if(F.col("status") == MANUAL).alias("needs_manual"),
        some("official_url").alias("urls_found"), some("application_id").alias("ids_found"), F.count_if(F.col("visa").isin(BLOCKED, SUPPORTED)).alias("sponsorship_explicit"),
    )
