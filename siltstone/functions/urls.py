"""URL canonicalization (P2a-P2g), stable posting ids (P6), host labels (P32), URL filters (F4, F13) and title overlap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import squeeze

# Query keys that each flavour drops.
MERGE_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gh_src", "source", "ref")
AGGREGATOR_KEYS = (*MERGE_KEYS, "gh_jid", "trk", "refid")
CHINA_KEYS = ("from", "ka", "ref", "referrer", "source", "src", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
IDENTITY_KEYS = (
    "source", "src", "ref", "referrer", "gh_src", "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term",
    "trk", "trackingid", "from", "fromsearch",
)
ID_KEYS = (
    "gh_jid", "jobid", "job_id", "jid", "currentjobid", "postingid", "posting_id", "positionid", "position_id",
    "requisitionid", "requisition_id", "reqid", "req_id", "vacancyid", "vacancy_id", "openingid", "opening_id",
)
# Fixed value: a fragment that holds a posting's id.
JOB_FRAGMENT = r"(?i)(?:job|position|posting|opening|vacancy|requisition|req|jid|id)[=/:_-]"
# Words that are no id, and the form of a long id.
PLAIN_WORD = "^(?:jobs?|careers?|search|apply|details?|view|openings?)$"
UUID = "^[0-9a-f]{8}-[0-9a-f-]{20,}$"
# Path forms that hold a posting's id, in the order in which they are tried.
ID_PATHS = (
    r"(?i)/(?:jobs?|positions?|postings?|openings?|vacancies?)/(?:[^/?#]+/)*([a-z]*\d[a-z0-9_-]{2,}|[0-9a-f]{8}-[0-9a-f-]{20,})/?$",
    r"(?i)/view/([a-z]*\d[a-z0-9_-]{2,})/?$",
    r"(?i)/([0-9a-f]{8}-[0-9a-f-]{20,})/?$",
    r"(?i)/(R-?\d{3,}|REQ-?[a-z0-9_-]{3,}|JR-?\d{3,})/?$",
)
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


@dataclass(frozen=True)
class Flavour:
    drop: tuple[str, ...]
    keep_query: bool = True
    job_fragment: bool = False


MERGE = Flavour(MERGE_KEYS)
AGGREGATOR = Flavour(AGGREGATOR_KEYS)
METRICS = Flavour((), keep_query=False)
IDENTITY = Flavour(IDENTITY_KEYS, job_fragment=True)
CHINA = Flavour(CHINA_KEYS)
SYNTHETIC_FRAGMENT = r"(?i)#posting-.*$"  # what `operators.postings.distinct_url` appends


def host(url: Column) -> Column:
    """Lower-case host without `www.`; empty if the text is no URL."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _PARTS, 2)), r"^www\.", "")


def query_pairs(url: Column) -> Column:
    """The query's non-empty `key=value` texts."""
    return F.filter(F.split(F.substring(F.regexp_extract(url, _PARTS, 4), F.lit(2), F.length(url)), "&"), lambda x: x != "")


def canonical_url(url: Column, flavour: Flavour = MERGE) -> Column:
    """Scheme and host in lower case, no `www.`, no tracking keys, sorted query, no trailing slash, no fragment.

    Text that is no URL comes back squeezed. The identity flavour keeps a fragment that looks like a posting's id.
    """
    u = squeeze(url)
    pairs = F.filter(query_pairs(u), lambda x: ~F.lower(F.substring_index(x, "=", 1)).isin(*flavour.drop)) if flavour.drop else query_pairs(u)
    query = F.array_join(F.array_sort(pairs), "&") if flavour.keep_query else F.lit("")
    path = F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(u, _PARTS, 3), "/+$", ""), F.lit("")), F.lit("/"))
    out = F.concat(F.lower(F.regexp_extract(u, _PARTS, 1)), F.lit("://"), host(u), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    if flavour.job_fragment:
        fragment = F.regexp_extract(u, _PARTS, 5)
        out = F.concat(out, F.when(fragment.rlike(JOB_FRAGMENT), fragment).otherwise(""))
    return F.when(u.rlike(_PARTS), out).otherwise(u)


def snapshot_url(url: Column) -> Column:
    """P2d: the China flavour; an empty value stays empty, other text that is no URL comes back squeezed."""
    return F.when(squeeze(url) == "", F.lit("")).otherwise(canonical_url(url, CHINA))


def base_page_url(url: Column) -> Column:
    """P2g: the identity flavour without a fragment that the engine itself appended."""
    return canonical_url(F.regexp_replace(url, SYNTHETIC_FRAGMENT, ""), IDENTITY)


def identifier(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9_-]+", "")


def looks_stable(c: Column) -> Column:
    return F.length(c).between(3, 160) & ~c.rlike(PLAIN_WORD) & (c.rlike("[0-9]") | c.rlike(UUID))


def stable_id(url: Column, supplied: Column | None = None) -> Column:
    """A supplied id, else one from a query key, the path or the fragment; empty if there is none."""
    u = F.trim(F.coalesce(url, F.lit("")))
    web = u.rlike("(?i)^https?://")
    at = host(u)
    choices = []
    if supplied is not None:
        given = identifier(supplied)
        choices.append(F.when(looks_stable(given), F.concat(F.lit("explicit:"), given)))
    key_of = lambda x: F.regexp_replace(F.lower(F.substring_index(x, "=", 1)), "[^a-z0-9_]", "")
    value_of = lambda x: identifier(F.try_url_decode(F.substring_index(x, "=", -1)))
    hits = F.filter(query_pairs(u), lambda x: x.contains("=") & key_of(x).isin(*ID_KEYS) & F.coalesce(looks_stable(value_of(x)), F.lit(False)))
    first = F.get(hits, F.lit(0))
    choices.append(F.when(web & first.isNotNull(), F.concat(at, F.lit(":query:"), key_of(first), F.lit(":"), value_of(first))))
    path = F.coalesce(F.try_url_decode(F.regexp_extract(u, _PARTS, 3)), F.regexp_extract(u, _PARTS, 3))
    for form in ID_PATHS:
        value = identifier(F.regexp_extract(path, form, 1))
        choices.append(F.when(web & looks_stable(value), F.concat(at, F.lit(":path:"), value)))
    fragment = F.regexp_replace(F.regexp_extract(u, _PARTS, 5), "^#", "")
    value = identifier(F.element_at(F.split(fragment, "[=/:]"), -1))
    choices.append(F.when(web & fragment.rlike(JOB_FRAGMENT) & looks_stable(value), F.concat(at, F.lit(":hash:"), value)))
    return F.coalesce(*choices, F.lit(""))


def suffix_label(url: Column, rules: dict[str, str], default: str = "other") -> Column:
    """The label of the first host suffix that fits."""
    h, out = host(url), F.lit(None).cast("string")
    for suffix, label in rules.items():
        out = F.coalesce(out, F.when((h == suffix) | h.endswith(f".{suffix}"), F.lit(label)))
    return F.coalesce(out, F.lit(default))


def url_contract(url: Column, hosts: dict[str, str]) -> Column:
    """the reason why a URL is refused (host or path), null if it is accepted. hosts: suffix to path pattern."""
    h, path = host(url), F.regexp_extract(url, _PARTS, 3)
    known, fits = F.lit(False), F.lit(False)
    for suffix, pattern in hosts.items():
        here = (h == suffix) | h.endswith(f".{suffix}")
        known, fits = known | here, fits | (here & path.rlike(pattern))
    return F.when(~known, "wrong_host").when(~fits, "wrong_path")


def is_safe_url(url: Column) -> Column:
    """http(s) to a public host name: no literal addresses, local names, user parts or odd ports."""
    authority = F.lower(F.regexp_extract(url, _PARTS, 2))
    local = authority.rlike(r"^(?:localhost|[^.]+|.*\.(?:local|internal|localhost))$|^[0-9.]+$|^\[|@|:(?!80$|443$)\d+$")
    return F.coalesce(url.rlike("(?i)^https?://") & (authority != "") & ~local, F.lit(False))


def token_overlap(title: Column, expected: Column) -> Column:
    """the share of the expected title's distinct words that the title has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    want = words(expected)
    return F.when(F.size(want) > 0, F.size(F.array_intersect(words(title), want)) / F.size(want)).otherwise(0.0)
