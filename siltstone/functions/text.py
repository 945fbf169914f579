"""Text normalization and extraction as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Titles that name no posting, and their forms.
PLACEHOLDER_TITLES = (
    "", "job", "jobs", "career", "careers", "job details", "job detail", "open positions", "current openings",
    "campus talent", "campus recruiting", "campus recruitment", "join us", "待补充职位名称", "职位详情", "招聘职位",
    "校园招聘", "社会招聘", "人才招聘", "招聘官网", "招聘平台", "加入我们",
)
_PLACEHOLDER_FORMS = (
    r"^(?:jobs?|careers?|open positions?|current openings?)(?:\s*[|·-].*)?$",
    r"^(?:[\p{L}\p{N}·&（）()\s]{1,40})?(?:校园招聘|校招|社会招聘|人才招聘|招聘官网|招聘平台|招聘中心|加入我们)$",
    r"^(?:[\p{L}\p{N}·&()\s]{1,40}\s*[|·-]\s*)?(?:campus talent|campus recruiting|campus recruitment|careers?|join us)$",
)
FNV_BASIS, FNV_PRIME, MASK32 = 2166136261, 16777619, 4294967295


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once a row: Spark computes an expression again wherever it stands in a condition or lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, ends are trimmed, null is empty."""
    return F.trim(F.regexp_replace(_text(c), r"\s+", " "))


def identity_text(c: Column) -> Column:
    """Lower case, `&` read as `and`, only a-z, 0-9 and CJK kept. Compatibility forms: see `nfkc`."""
    return F.regexp_replace(F.replace(F.lower(_text(c)), F.lit("&"), F.lit("and")), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "")


def location_key(c: Column) -> Column:
    """Identity text without the country's names and without `remote`."""
    return F.regexp_replace(F.regexp_replace(identity_text(c), "unitedstatesofamerica|unitedstates|usa", ""), "remote", "")


def is_placeholder_title(c: Column) -> Column:
    """P5."""
    t = F.lower(F.trim(_text(c)))
    found = t.isin(*PLACEHOLDER_TITLES)
    for form in _PLACEHOLDER_FORMS:
        found = found | t.rlike(form)
    return found


def company_key(c: Column) -> Column:
    """Lower case without parentheses, legal suffixes and everything but letters and digits."""
    t = F.regexp_replace(F.lower(_text(c)), r"\([^)]*\)|（[^）]*）", " ")
    t = F.regexp_replace(t, r"(^|[^a-z0-9])(?:incorporated|inc|corporation|corp|company|co|limited|ltd|llc|plc|gmbh|ag|group|holdings?)(?=$|[^a-z0-9])", "$1")
    return F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")


def company_match_keys(c: Column) -> Column:
    """P8, several keys: the plain key, the key without its suffixes, the key of the part before a parenthesis or slash."""
    plain = F.regexp_replace(F.lower(_text(c)), r"[^\p{L}\p{N}]+", "")
    head = company_key(F.regexp_extract(_text(c), r"^([^(（/]*)", 1))
    return F.filter(F.array_distinct(F.array(plain, company_key(c), head)), lambda k: k != "")


def pair_fingerprint(company: Column, title: Column) -> Column:
    """P9."""
    return F.concat_ws("::", F.lower(squeeze(company)), F.lower(squeeze(title)))


def sha_key(c: Column) -> Column:
    """P10: the first 24 hex digits of SHA-256."""
    return F.substring(F.sha2(_text(c).cast("binary"), 256), 1, 24)


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over code points."""
    step = lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("bigint")) * FNV_PRIME).bitwiseAND(F.lit(MASK32))
    return F.when(F.length(c) == 0, F.lit(FNV_BASIS)).otherwise(F.aggregate(F.split(c, ""), F.lit(FNV_BASIS).cast("bigint"), step))


def base36(c: Column) -> Column:
    return F.lower(F.conv(c.cast("string"), 10, 36))


def record_fingerprint(*columns: str) -> Column:
    """SHA-256 of the JSON of the columns in name order; nulls count as empty."""
    return F.sha2(F.to_json(F.struct(*[_text(F.col(c)).alias(c) for c in sorted(columns)])).cast("binary"), 256)


def strip_html(c: Column) -> Column:
    """Scripts, styles and tags out, `&nbsp;` and `&amp;` decoded, white space squeezed."""
    t = F.regexp_replace(_text(c), r"(?is)<script\b[^>]*>.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style\b[^>]*>.*?</style>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    return squeeze(F.regexp_replace(F.regexp_replace(t, "(?i)&nbsp;", " "), "(?i)&amp;", "&"))


def html_title(c: Column) -> Column:
    """The first h1, else the title, without a site's name behind ` | ` or ` - `."""
    h1 = strip_html(F.regexp_extract(_text(c), r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))
    title = strip_html(F.regexp_extract(_text(c), r"(?is)<title\b[^>]*>(.*?)</title>", 1))
    return F.regexp_replace(F.coalesce(F.nullif(h1, F.lit("")), title), r"\s+[|-]\s+[^|-]+$", "")


def html_links(c: Column) -> Column:
    """Distinct href values in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(_text(c), F.lit(r"""(?i)<a\b[^>]*?\bhref=["']([^"'#]+)["']"""), 1))


def first_nonempty(*columns: Column) -> Column:
    """P16."""
    return F.coalesce(*[F.nullif(squeeze(c), F.lit("")) for c in columns], F.lit(""))


def join_distinct(*columns: Column, sep: str = ", ") -> Column:
    """Distinct non-empty values, in order."""
    return F.array_join(F.array_distinct(F.filter(F.array(*[squeeze(c) for c in columns]), lambda x: x != "")), sep)


def section(c: Column, start: str, stop: str, longest: int = 5000) -> Column:
    """What follows the first `start` up to `stop`, else the next `longest` characters.

    The first `start` is fixed before `stop` is looked for: without one, each later start would be tried to the text's end.
    """
    first = f"(?is)^(?>.*?(?={start})){start}"
    ended = lambda t: F.regexp_extract(t, f"{first}(.*?)(?:{stop})", 1)
    open_end = lambda t: F.regexp_extract(t, f"{first}(.{{0,{longest}}})", 1)
    return once(_text(c), lambda t: F.when(t.rlike(f"{first}.*?(?:{stop})"), ended(t)).otherwise(open_end(t)))


def split_tags(c: Column) -> Column:
    """P34."""
    return F.filter(F.transform(F.split(_text(c), r"[|,，;/]"), lambda x: F.trim(x)), lambda x: x != "")


def archive_id(number: Column, prefix: str = "APP-", width: int = 6) -> Column:
    """A stable id with leading zeros."""
    return F.concat(F.lit(prefix), zero_filled(number, width))


def zero_filled(number: Column, width: int) -> Column:
    """Leading zeros up to the width; longer numbers stay whole."""
    n = number.cast("string")
    return F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n)


def latex_to_text(c: Column) -> Column:
    """Commands with an argument keep it, the others go, escapes and braces are resolved."""
    t = F.regexp_replace(_text(c), r"(?m)(?<!\\)%.*$", "")
    t = F.regexp_replace(t, r"\\href\{[^{}]*\}\{([^{}]*)\}", "$1")
    t = F.regexp_replace(t, r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", "$1")
    t = F.regexp_replace(t, r"\\([%&_#$])", "$1")
    t = F.regexp_replace(t, r"\\[a-zA-Z]+\*?", " ")
    t = F.regexp_replace(F.regexp_replace(t, "---?", "-"), r"[{}~]", " ")
    return squeeze(t)


def year_month(c: Column) -> Column:
    """`YYYY-MM` from year-first forms or from an English month's name; empty if there is none."""
    t = F.lower(_text(c))
    first = F.regexp_extract(t, r"((?:19|20)\d{2})[-/.年](\d{1,2})", 1)
    month = F.lpad(F.regexp_extract(t, r"((?:19|20)\d{2})[-/.年](\d{1,2})", 2), 2, "0")
    name = F.regexp_extract(t, r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+((?:19|20)\d{2})", 1)
    year = F.regexp_extract(t, r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+((?:19|20)\d{2})", 2)
    number = F.lpad(((F.position(name, F.lit("jan feb mar apr may jun jul aug sep oct nov dec")) + 3) / 4).cast("int").cast("string"), 2, "0")
    return F.when(first != "", F.concat_ws("-", first, month)).when(name != "", F.concat_ws("-", year, number)).otherwise("")


@F.pandas_udf(StringType())
def nfkc(s):
    """Compatibility forms, which Spark lacks; put it before P3 and R1 where full-width input is expected."""
    import unicodedata

    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def html_unescape(s):
    import html

    return s.map(lambda x: x if x is None else html.unescape(x))
