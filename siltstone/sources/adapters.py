"""Adapters from raw source rows to the canonical posting row (five of P19; P20, P21), and boards of applicant systems.

Each adapter is one `select` over staged rows. The canonical row: job_key, company, title, location, region,
track, score, visa, skills, job_url, canonical_url, application_id, source, status, description.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import rules as R
from siltstone.functions import screening as S
from siltstone.functions import text as T
from siltstone.functions import urls as U
from siltstone.operators import joins

CANONICAL = ("job_key", "company", "title", "location", "region", "track", "score", "visa", "skills", "job_url", "canonical_url", "application_id", "source", "status", "description")
US, CHINA = "美国", "中国"
TO_VERIFY, TO_CHECK, CAPTURED, OPEN = "待官网核验", "待核验", "已捕获完整JD", "开放"
LEAST_SCORE = 55

# Skills, tracks and places of the adapters.
SKILLS = (
    ("R", r"(?i)(?:^|\W)r(?:\W|$)|\brstudio\b"), ("Python", r"(?i)\bpython\b"), ("SQL", r"(?i)\bsql\b"), ("SAS", r"(?i)\bsas\b"), ("Statistics", r"(?i)\bstatistic"),
    ("Biostatistics", r"(?i)\bbiostat"), ("Causal inference", r"(?i)causal inference|propensity score|inverse probability|target trial"), ("Experimentation", r"(?i)experimental design|a/b test|randomized experiment"),
    ("Machine learning", r"(?i)machine learning|statistical learning|predictive model"), ("Clinical trials", r"(?i)clinical trial|randomized controlled trial|estimand"),
    ("Longitudinal data", r"(?i)longitudinal|repeated measures|mixed.effects|survival analysis"), ("Model validation", r"(?i)external validation|calibration|generaliz|fairness|bias analysis|model evaluation"),
    ("Medical imaging", r"(?i)medical imaging|neuroimaging|multimodal imaging|digital biomarker"), ("RWE / HEOR", r"(?i)real.world evidence|\brwe\b|\bheor\b|health economics|pharmacoepidemi"),
)
CLOUD_SKILLS = (("R", r"(?i)(?:^|[^a-z0-9_])R(?:[^a-z0-9_]|$)"), ("Python", r"(?i)\bPython\b"), ("SAS", r"(?i)\bSAS\b"), ("SQL", r"(?i)\bSQL\b"), ("Biostatistics", r"(?i)biostat"), ("Clinical trials", r"(?i)clinical trial"))
LOCAL_SKILLS = (
    ("Python", r"(?i)\bpython\b"), ("R", r"(?:^|[^A-Za-z0-9_])R(?:[^A-Za-z0-9_]|$)"), ("SQL", r"(?i)\bsql\b"), ("SAS", r"(?i)\bsas\b"), ("Biostatistics", r"(?i)biostat|生物统计"), ("Clinical trials", r"(?i)clinical trial|临床试验"),
    ("Machine learning", r"(?i)machine learning|机器学习"), ("Causal inference", r"(?i)causal inference|因果推断"), ("Longitudinal data", r"(?i)longitudinal|survival analysis|纵向|生存分析"),
    ("RWE / HEOR", r"(?i)real.world|真实世界|\bheor\b|health economics|卫生经济"),
)
SCAN_TRACKS = (("Quant", "quantitative researcher|quantitative analyst|systematic"), ("Pharma", "biostat|statistical scientist|clinical trial|epidemiol|health economics|outcomes research"), ("Healthcare AI", "health|clinical ai|medical|imaging"), ("Medical Device", "device|diagnostic|algorithm validation"))
SERVER_SKILLS = (
    ("Python", r"(?i)\bpython\b"), ("R", r"(?:^|\W)R(?:\W|$)"), ("SQL", r"(?i)\bsql\b"), ("SAS", r"(?i)\bsas\b"), ("Statistics", r"(?i)\bstatistic"), ("Biostatistics", r"(?i)\bbiostat"),
    ("Causal inference", r"(?i)causal inference|propensity score|inverse probability|target trial"), ("Experimentation", r"(?i)experiment(?:al)? design|a\/b test|randomized experiment"),
    ("Machine learning", r"(?i)machine learning|statistical learning|predictive model"), ("Clinical trials", r"(?i)clinical trial|randomized controlled trial|estimand"),
    ("Longitudinal data", r"(?i)longitudinal|repeated measures|mixed.effects|survival analysis"), ("Model validation", r"(?i)external validation|calibration|generaliz|fairness|bias analysis|model evaluation"),
    ("Medical imaging", r"(?i)medical imaging|neuroimaging|multimodal imaging|digital biomarker"), ("RWE / HEOR", r"(?i)real.world evidence|\brwe\b|\bheor\b|health economics|pharmacoepidemi"),
)
SERVER_TRACKS = (
    ("Quant", "quantitative researcher|quantitative analyst|systematic|量化研究|定量研究|量化分析"), ("Pharma", "biostat|statistical scientist|clinical trial|epidemiol|health economics|outcomes research|生物统计|临床统计|医学统计|流行病|卫生经济|健康经济|真实世界"),
    ("Healthcare Consulting", "healthcare consultant|life sciences consultant|医疗咨询|医药咨询|生命科学咨询"), ("Healthcare AI", "health|clinical ai|medical|imaging"), ("Medical Device", "device|diagnostic|algorithm validation"),
)
AGGREGATOR_TRACKS = (("Quant", "(?i)quantitative"), ("Pharma", "(?i)biostat|statistical|epidemiol|health econom|outcomes|clinical statistic|medical statistic"))
LOCAL_TRACKS = (
    ("Quant", "量化研究|量化分析|quantitative|systematic"), ("Consulting", "医疗咨询|医药咨询|生命科学咨询|healthcare consultant|life sciences consultant"), ("Pharma", "生物统计|临床统计|医学统计|biostat|clinical trial|流行病|卫生经济|真实世界"),
    ("Healthcare AI", "医学影像|medical imaging|neuroimaging|医疗|healthcare"),
)
AGGREGATOR_TITLE = r"(?i)\b(?:biostatistician|statistical scientist|data scientist|applied scientist|research scientist|decision scientist|quantitative researcher|quantitative analyst|epidemiologist|health economist|health economics|outcomes researcher|outcomes research|clinical statistician|medical statistician)\b"
AGGREGATOR_EXCLUDED = r"(?i)\b(?:intern|internship|postdoc|postdoctoral|senior|sr\.?|principal|staff|director|manager|lead|head|vice president|vp|software engineer|data engineer|machine learning engineer|nlp|generative ai|large language model|llm)\b"
CLOUD_TITLE = r"(?i)biostatistic|statistical scientist|data scientist|applied scientist|research scientist|quantitative researcher|quantitative analyst|epidemiolog|health economics|outcomes research|decision scientist"
CLOUD_EXCLUDED = r"(?i)intern|postdoc|postdoctoral|senior|principal|staff|director|vice president|manager|lead|head of|software engineer|data engineer|machine learning engineer|generative ai|large language model|\bllm\b|\bnlp\b"
CLOUD_RELEVANT = r"(?i)ph\.?d|doctorate|doctoral|biostat|statistics|quantitative"
CHINA_PLACE = r"(?i)(?:中国|北京|上海|深圳|广州|杭州|南京|苏州|成都|武汉|西安|天津|重庆|\bchina\b|\bbeijing\b|\bshanghai\b|\bshenzhen\b|\bguangzhou\b|\bhangzhou\b)"
US_PLACE = r"(?i)\b(?:united states|usa|u\.s\.|remote(?:\s*[-–—]\s*us)?|california|massachusetts|new jersey|new york|north carolina|pennsylvania|texas|washington)\b"


def job_key(identity: Column) -> Column:
    return T.sha_key(identity)


def _text(name: str, df: DataFrame) -> Column:
    return T.squeeze(F.col(name)) if name in df.columns else F.lit("")


def _rows(df: DataFrame, keep: Column, **values: Column | str) -> DataFrame:
    columns = {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
    return df.where(keep).select(*[c for c in ("source_id",) if c in df.columns], *[columns[c].alias(c) for c in CANONICAL])


def from_scraper(df: DataFrame) -> DataFrame:
    """Rows of a scraper frame: title, description, company, job_url_direct, job_url, location, city, state, country, site.

    Kept: wanted titles that are not excluded, eligible, with a doctorate named and at least 55 points. Rows
    without title, company or URL are dropped; of one company and title (or id) the key is the same.
    """
    t, d, c = _text("title", df), _text("description", df), _text("company", df)
    url = T.first_nonempty(_text("job_url_direct", df), _text("job_url", df))
    years, visa = S.required_years(d, "scan"), S.sponsorship(d, "scan")
    score, ident = S.score(t, d, years, visa, S.RUBRIC_SCAN), S.application_id(url, "scan")
    keep = (t != "") & (c != "") & (url != "") & S.wanted_title(t) & ~S.excluded_title(t)
    keep = keep & S.eligible(t, d, years, visa, S.RUBRIC_SCAN) & F.lower(d).rlike(S.PHD) & (score >= LEAST_SCORE)
    named = F.concat_ws("::", F.regexp_replace(F.lower(c), r"[^a-z0-9_]+", ""), F.coalesce(F.nullif(ident, F.lit("")), F.trim(F.regexp_replace(F.lower(t), r"[^a-z0-9_]+", " "))))
    return _rows(
        df, keep, job_key=job_key(named), company=c, title=t, location=T.first_nonempty(_text("location", df), T.join_distinct(*[_text(x, df) for x in ("city", "state", "country")])), region=US,
        track=R.first_match(F.lower(F.concat_ws(" ", t, d)), SCAN_TRACKS, "Technology"), score=score, visa=visa, skills=R.all_matches(d, SKILLS, 7), job_url=url, canonical_url=U.canonical_url(url, U.MERGE),
        application_id=ident, source=F.concat(F.lit("JobSpy · "), T.first_nonempty(_text("site", df), F.lit("JobSpy"))), status=TO_VERIFY, description=d,
    )


def from_aggregator(df: DataFrame) -> DataFrame:
    """Rows of a job-board aggregator: title, company, location, url, skill_level, ats. Only known regions and no senior levels are kept."""
    t, c, place, url = (_text(x, df) for x in ("title", "company", "location", "url"))
    level = F.lower(_text("skill_level", df))
    region = F.when(place.rlike(CHINA_PLACE), CHINA).when(place.rlike(US_PLACE), US).otherwise("")
    keep = (t != "") & (c != "") & (url != "") & t.rlike(AGGREGATOR_TITLE) & ~t.rlike(AGGREGATOR_EXCLUDED) & (region != "") & ~level.isin("senior", "executive")
    base, cap, points = S.SHORT_RUBRICS["aggregator"]
    score = F.least(F.lit(cap), base + R.points(t, points) + F.when(level.isin("entry", "junior"), 8).otherwise(0))
    return _rows(
        df, keep, job_key=job_key(F.lower(url)), company=c, title=t, location=place, region=region, track=R.first_match(t, AGGREGATOR_TRACKS, "Technology"), score=score, visa=F.when(region == CHINA, "不适用").otherwise(S.UNCLEAR),
        skills=F.array().cast("array<string>"), job_url=url, canonical_url=url, application_id="", source=F.concat(F.lit("Job Board Aggregator · "), T.first_nonempty(_text("ats", df), F.lit("ATS"))), status=TO_VERIFY, description="",
    )


def from_cloud(df: DataFrame, source: str) -> DataFrame:
    """Rows of a public API under any of its field names. Kept: target titles with a doctorate, statistics or the like in title or description."""
    pick = lambda *names: T.first_nonempty(*[_text(n, df) for n in names])
    t, c, url = pick("position", "title", "jobTitle", "name"), pick("company", "company_name", "companyName"), pick("url", "job_url", "jobUrl", "apply_url")
    d = T.strip_html(pick("description", "jobDescription", "content"))
    both = F.concat_ws(" ", t, d)
    place = T.first_nonempty(pick("location", "candidate_required_location", "jobGeo"), F.lit("Remote"))
    keep = (t != "") & (c != "") & (url != "") & t.rlike(CLOUD_TITLE) & ~t.rlike(CLOUD_EXCLUDED) & both.rlike(CLOUD_RELEVANT)
    return _rows(
        df, keep, job_key=job_key(F.concat_ws("::", F.lower(c), F.lower(t), F.lower(place))), company=c, title=t, location=place, region=US, track=F.when(both.rlike("(?i)biostat|clinical|pharma|health"), "Pharma").otherwise("Technology"),
        score=S.short_score(both, "cloud"), visa=S.UNCLEAR, skills=R.all_matches(both, CLOUD_SKILLS, 7), job_url=url, canonical_url=url, application_id=pick("id", "job_id", "slug"), source=source, status=TO_VERIFY,
        description=F.substring(d, 1, 120_000),
    )


# Titles that the scan of company portals looks for and leaves out.
PORTAL_TITLE = (
    r"(?i)(?:biostatistic|statistical scientist|clinical statistic|medical statistic|data scientist|applied scientist|research scientist|decision scientist|quantitative researcher|quantitative analyst|quant researcher"
    r"|epidemiolog|health econom|outcomes research|real.world evidence|healthcare consultant|life sciences consultant|clinical data scientist"
    r"|生物统计|临床统计|医学统计|统计科学|统计分析|统计建模|统计师|统计|数据科学|应用科学|量化研究|定量研究|量化分析|流行病|卫生经济|健康经济|结局研究|真实世界|医药咨询|医疗咨询|生命科学咨询|算法科学|医学数据|医学影像)"
)
PORTAL_EXCLUDED = (
    r"(?i)(?:\bintern(?:ship)?\b|postdoc|postdoctoral|\bsenior\b|\bsr\.?\b|\bprincipal\b|\bstaff\b|\bdirector\b|\bmanager\b|\blead\b|\bhead\b|vice president|\bvp\b|software engineer|data engineer"
    r"|machine learning engineer|generative ai|large language model|\bllm\b|\bnlp\b|实习|博士后|高级|资深|总监|经理|负责人)"
)


def portal_url(url: Column, system: Column, portal: Column) -> Column:
    """A board's URL made absolute: below the portal's host, for Workday below its site; empty without a portal."""
    root = F.regexp_extract(portal, "^([a-z]+://[^/?#]+)", 1)
    site = F.regexp_extract(portal, "^[a-z]+://[^/?#]+/([^/?#]+)", 1)
    below = F.when(system == "workday", F.concat(root, F.lit("/"), site, url)).otherwise(F.concat(root, url))
    return F.when(~url.startswith("/"), url).when(root == "", "").otherwise(below)


def from_portal(df: DataFrame) -> DataFrame:
    """Rows of a company portal's API: company, region, system, portal, title, location, url, description, salary, id.

    Kept: target titles whose place fits the region (a blank one does); in China what F5 accepts, elsewhere titles
    that are not excluded.
    """
    t, c, place, d = (_text(x, df) for x in ("title", "company", "location", "description"))
    system, region, china = _text("system", df), _text("region", df), F.col("region") == CHINA
    url = portal_url(_text("url", df), system, _text("portal", df))
    keep = t.rlike(PORTAL_TITLE) & F.when(china, S.china_eligible(t, F.concat_ws(" ", t, d, _text("salary", df)))).otherwise(~t.rlike(PORTAL_EXCLUDED))
    keep = keep & ((place == "") | F.when(china, place.rlike(CHINA_PLACE)).otherwise(place.rlike(US_PLACE)))
    both = F.concat_ws(" ", t, d)
    return _rows(
        df, keep, job_key=job_key(T.first_nonempty(url, F.concat_ws("::", F.lower(c), F.lower(t), F.lower(place)))), company=c, title=t, location=T.first_nonempty(place, F.when(china, CHINA).otherwise("Location not listed")), region=region,
        track=R.first_match(t, AGGREGATOR_TRACKS, "Technology"), score=S.short_score(both, "portal"), visa=F.when(china, "不适用").otherwise(S.UNCLEAR), skills=R.all_matches(d, SKILLS, 7), job_url=url, canonical_url=url,
        application_id=_text("id", df), source=F.concat(F.lit("Company portal · "), system), status=OPEN, description=F.substring(T.squeeze(F.regexp_replace(d, "<[^>]+>", " ")), 1, 120_000),
    )


# Names of the same field in exported snapshots.
SNAPSHOT_KEYS = {
    "title": ("title", "jobTitle", "job_title", "jobName", "job_name", "positionName", "position_name", "position"),
    "company": ("company", "companyName", "company_name", "employer", "hiringOrganization"),
    "url": ("job_url", "jobUrl", "detailUrl", "detail_url", "url", "link", "href"),
    "description": ("full_description", "description", "jobDescription", "job_description", "content", "text", "jd"),
    "location": ("location", "city", "cityName", "city_name", "address", "workplace"),
    "id": ("id", "jobId", "job_id"),
}


def from_snapshot(df: DataFrame, source: str) -> DataFrame:
    """Rows of an exported snapshot under any of SNAPSHOT_KEYS. Excluded titles are dropped; unknown companies and places get their placeholders."""
    v = {k: T.first_nonempty(*[_text(n, df) for n in names]) for k, names in SNAPSHOT_KEYS.items()}
    df, v = df.select(*[c for c in ("source_id",) if c in df.columns], *[c.alias(k) for k, c in v.items()]), {k: F.col(k) for k in v}
    company, place, url = T.first_nonempty(v["company"], F.lit(S.UNKNOWN_COMPANY)), T.first_nonempty(v["location"], F.lit(CHINA)), U.snapshot_url(v["url"])
    both = F.concat_ws(" ", v["title"], v["description"])
    # Columns of their own: what several results read is computed once.
    df = df.withColumns({"page": url, "degree": both.rlike(r"(?i)博士|ph\.?d\.?|doctorate|doctoral"), "skills": R.all_matches(both, LOCAL_SKILLS)})
    url, degree, skills = F.col("page"), F.col("degree"), F.col("skills")
    score = F.least(F.lit(100), 45 + F.when(degree, 15).otherwise(0) + F.when(v["description"] != "", 10).otherwise(0) + F.least(F.lit(20), F.size(skills) * 3))
    named = F.concat_ws("::", F.lower(company), F.lower(v["title"]), F.lower(place))
    keep = (v["title"] != "") & ~F.lower(v["title"]).rlike(S.CHINA_EXCLUDED_TITLE) & ~F.lower(v["title"]).rlike(S.CHINA_IRRELEVANT)
    return _rows(
        df, keep, job_key=job_key(T.first_nonempty(url, named)), company=company, title=v["title"], location=place, region=CHINA, track=R.first_match(F.lower(both), LOCAL_TRACKS, "Technology"), score=score, visa="不适用",
        skills=skills, job_url=url, canonical_url=url, application_id=v["id"], source=source, status=F.when((v["description"] != "") & degree, CAPTURED).otherwise(TO_CHECK), description=v["description"],
    )


# Titles that the local collector looks for.
LOCAL_TITLE = (
    r"(?i)生物统计|临床统计|医学统计|统计科学家|统计分析|统计建模|统计师|统计|数据科学|数据科学家|应用科学家|研究科学家|算法研究员|算法科学家|创新算法|科学计算|计算科学家|计算生物|量化研究|量化分析|医疗咨询|医药咨询|生命科学咨询"
    r"|真实世界|流行病|卫生经济|健康经济|结局研究|医学影像|biostat|statistical scientist|data scientist|applied scientist|research scientist|quantitative research|quantitative analyst|healthcare consultant|life sciences consultant|epidemiolog|health economics"
)


def from_collector(listing: DataFrame, details: DataFrame, row_key: str, seen: str) -> DataFrame:
    """P20: listing rows with their last detail row. listing: row_key, title, company, salary_source, boss_name, company_link, job_link, location, skills; details: row_key, company, jd, skill_tags, `seen`.

    A name of the listing's contact is the company only where the row comes from the API with a company link. Of one key one row stays.
    """
    last = details.groupBy(row_key).agg(F.max_by(F.struct(F.col("company").alias("d_company"), "jd", F.col("skill_tags").alias("d_tags")), seen).alias("d"))
    one = listing.where(F.coalesce(F.col(row_key), F.lit("")) != "").groupBy(row_key).agg(F.max_by(F.struct(*[c for c in listing.columns if c != row_key]), seen).alias("l"))
    rows = one.join(last, row_key, "left").select(F.col(row_key).alias("source_id"), "l.*", "d.*")
    t, jd = T.squeeze(F.col("title")), T.squeeze(F.col("jd"))
    trusted = F.when(F.lower(T.squeeze(F.col("salary_source"))).startswith("api") & (T.squeeze(F.col("company_link")) != ""), F.col("boss_name"))
    company, url = T.first_nonempty(F.col("d_company"), F.col("company"), trusted), T.squeeze(F.col("job_link"))
    tags = F.concat(T.split_tags(F.col("skills")), T.split_tags(F.col("d_tags")))
    content = F.concat_ws(" ", t, jd, F.array_join(tags, " "))
    years, found = S.required_years(content, "collector"), R.all_matches(content, LOCAL_SKILLS)
    low = F.lower(t)
    keep = t.rlike(LOCAL_TITLE) & ~low.rlike(S.CHINA_EXCLUDED_TITLE) & ~low.rlike(S.CHINA_IRRELEVANT) & (company != "") & (url != "")
    keep = keep & (years.isNull() | (years <= S.MOST_YEARS)) & ~F.lower(content).rlike(S.CHINA_EXCLUDED_CORE)
    score = F.least(F.lit(92), 68 + F.least(F.lit(18), F.size(found) * 3) + F.when(jd != "", 5).otherwise(0))
    return _rows(
        rows, keep, job_key=job_key(F.col("source_id")), company=company, title=t, location=T.squeeze(F.col("location")), region=CHINA, track=R.first_match(F.lower(content), LOCAL_TRACKS, "Technology"), score=score, visa="不适用",
        skills=F.slice(F.array_distinct(F.concat(found, tags)), 1, 12), job_url=url, canonical_url=url, application_id=F.col("source_id"), source="local collector", status=TO_VERIFY, description=jd,
    )


def storable(candidates: DataFrame, ignored: DataFrame) -> DataFrame:
    """Candidates (company, title, location, content, job_url, application_id, source) that a scan of boards stores, as canonical rows.

    Kept: wanted titles that are not excluded, not ignored by company and title, eligible, with a doctorate named
    and at least 55 points. `merge.upsert_fields` or `upsert_latest` stores them.
    """
    c = candidates.withColumn("__k", T.pair_fingerprint(F.col("company"), F.col("title")))
    c = c.join(joins.small(ignored.select(F.col("fingerprint").alias("__k")).distinct()), "__k", "left_anti")
    t, d, url = T.squeeze(F.col("title")), T.squeeze(F.col("content")), T.squeeze(F.col("job_url"))
    region = F.when(F.coalesce(F.col("location"), F.lit("")).rlike(CHINA_PLACE), CHINA).otherwise(US)
    years, visa = S.required_years(d, "server"), S.sponsorship(d, "server")
    asked = F.when(region == US, visa)
    score = S.score(t, d, years, asked, S.RUBRIC_US)
    keep = (t != "") & (url != "") & S.wanted_title(t, "server") & ~S.excluded_title(t) & S.eligible(t, d, years, asked, S.RUBRIC_US) & F.lower(d).rlike(S.RUBRIC_US.phd) & (score >= LEAST_SCORE)
    return _rows(
        c, keep, job_key=job_key(F.col("__k")), company=F.col("company"), title=t, location=F.col("location"), region=region, track=R.first_match(F.lower(F.concat_ws(" ", t, d)), SERVER_TRACKS, "Technology"), score=score, visa=visa,
        skills=R.all_matches(d, SERVER_SKILLS, 7), job_url=url, canonical_url=U.canonical_url(url, U.IDENTITY), application_id=S.application_id(url, "server", F.col("application_id")), source=F.col("source"), status=OPEN, description=d,
    )


# The addresses of boards, by system; {tenant}, {host} and {site} come from the portal.
BOARDS = {
    "greenhouse": "https://boards-api.greenhouse.io/v1/boards/{tenant}/jobs?content=true",
    "lever": "https://api.lever.co/v0/postings/{tenant}?mode=json",
    "ashby": "https://api.ashbyhq.com/posting-api/job-board/{tenant}",
    "smartrecruiters": "https://api.smartrecruiters.com/v1/companies/{tenant}/postings?limit=100",
    "recruitee": "https://{tenant}.recruitee.com/api/offers",
    "workable": "https://apply.workable.com/{tenant}/jobs.md",
    "bamboohr": "https://{tenant}.bamboohr.com/careers/list",
    "breezy": "https://{tenant}.breezy.hr/json",
    "pinpoint": "https://{host}/postings.json",
    "rippling": "https://api.rippling.com/platform/api/ats/v1/board/{tenant}/jobs",
    "personio": "https://{host}/xml",
    "teamtailor": "https://{host}/jobs.rss",
    "jibeapply": "https://{host}/api/jobs",
    "workday": "https://{tenant}/wday/cxs/{first}/{site}/jobs",
}
# Where a board's payload has its rows, and the fields of a row: title, URL, place, id.
BOARD_ROWS = {
    "greenhouse": ("$.jobs", ("$.title", "$.absolute_url", "$.location.name", "$.id")),
    "lever": ("$", ("$.text", "$.hostedUrl", "$.categories.location", "$.id")),
    "ashby": ("$.jobs", ("$.title", "$.jobUrl", "$.location", "$.id")),
    "smartrecruiters": ("$.content", ("$.name", "$.ref", "$.location.city", "$.id")),
    "recruitee": ("$.offers", ("$.title", "$.careers_url", "$.location", "$.id")),
    "bamboohr": ("$.result", ("$.jobOpeningName", "$.jobOpeningShareUrl", "$.location.city", "$.id")),
    "breezy": ("$", ("$.name", "$.url", "$.location.name", "$.id")),
    "workday": ("$.jobPostings", ("$.title", "$.externalPath", "$.locationsText", "$.bulletFields[0]")),
}


def board_address(system: Column, tenant: Column, portal: Column) -> Column:
    """The address of a tenant's board; null for an unknown system or a missing tenant. A tenant's second part is its site."""
    form = F.element_at(F.create_map(*[F.lit(x) for kv in BOARDS.items() for x in kv]), system)
    part = lambda i: F.coalesce(F.get(F.split(F.coalesce(tenant, F.lit("")), "/"), F.lit(i)), F.lit(""))
    filled = form
    for name, value in (("{tenant}", part(0)), ("{first}", F.substring_index(part(0), ".", 1)), ("{site}", part(1)), ("{host}", F.lower(F.regexp_extract(portal, "^[a-z]+://([^/?#]+)", 1)))):
        filled = F.replace(filled, F.lit(name), value)
    return F.when(~form.contains("{tenant}") | (part(0) != ""), filled)


def board_rows(payloads: DataFrame, system: str = "system", payload: str = "payload") -> DataFrame:
    """Rows of staged board payloads: system, title, url, location, ident, ordinal; one per URL (or id), the first of a payload.

    A payload that is no JSON, or lacks its system's rows, gives none. All other columns stay.
    """
    v = F.try_parse_json(F.col(payload))
    rows, fields = F.lit(None).cast("array<variant>"), {}
    for name, (path, paths) in BOARD_ROWS.items():
        rows = F.when(F.col(system) == name, F.try_variant_get(v, path, "array<variant>")).otherwise(rows)
        for out, p in zip(("title", "url", "location", "ident"), paths):
            fields[out] = F.when(F.col(system) == name, F.try_variant_get(F.col("__v"), p, "string")).otherwise(fields.get(out, F.lit(None).cast("string")))
    keep = [c for c in payloads.columns if c != payload]
    spread = payloads.withColumn("__rows", rows).select(*keep, F.posexplode("__rows").alias("ordinal", "__v"))
    found = spread.select(*keep, "ordinal", *[T.squeeze(e).alias(c) for c, e in fields.items()]).where("title <> ''")
    rest = [c for c in found.columns if c not in (*keep, "__u")]
    return found.withColumn("__u", T.first_nonempty(F.col("url"), F.col("ident"))).groupBy(*keep, "__u").agg(F.min_by(F.struct(*rest), "ordinal").alias("r")).select(*keep, "r.*")
