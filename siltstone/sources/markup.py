"""Web sources: HTML, embedded JSON, JSON-LD, Markdown, XML and LaTeX.

What a regular expression can find stays in the JVM; recursive JSON and real HTML parsing run as Arrow
table functions.
"""

from __future__ import annotations

import html
import json
import re
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import parse_qs, unquote, urljoin, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siltstone.names import column

CONTAINERS = ("jobs", "data", "results", "items", "list", "postings")
_TITLE_KEYS = ("title", "jobTitle", "JobTitle", "jobName", "name", "positionName")
_URL_KEYS = ("jobUrl", "url", "absolute_url", "applyUrl", "hostedUrl", "link")
_ID_KEYS = ("jobId", "JobId", "id", "requisitionId")
ROW = "title string, url string, location string, ident string"


def _first(row: dict, keys) -> str:
    return next((str(row[k]).strip() for k in keys if row.get(k) not in (None, "", [], {})), "")


def _place(value) -> str:
    """Nested location values, flattened, distinct, in order."""
    out: list[str] = []
    stack = [value]
    while stack:
        v = stack.pop(0)
        if isinstance(v, dict):
            stack[:0] = [v[k] for k in ("name", "LocationName", "city", "City", "state", "State", "addressLocality", "addressRegion", "country", "Country") if v.get(k)]
        elif isinstance(v, list):
            stack[:0] = v
        elif v not in (None, "") and str(v).strip() not in out:
            out.append(str(v).strip())
    return ", ".join(out)


def job_row(row: dict, base: str = "") -> tuple[str, str, str, str] | None:
    """A posting-like object as title, absolute URL, location, id; None if it has no title, or neither URL nor id."""
    title, url, ident = _first(row, _TITLE_KEYS), _first(row, _URL_KEYS), _first(row, _ID_KEYS)
    if not title or not (url or ident):
        return None
    place = _place([row.get(k) for k in ("location", "locations", "jobLocation", "JobLocation", "LocationName", "cityName") if row.get(k)])
    return title, urljoin(base, url) if url else "", place, ident


def harvest(payload, base: str = "", depth: int | None = None):
    """All posting rows in any JSON value, depth first; a row's own children are not searched."""
    stack = [(payload, 0)]
    while stack:
        value, level = stack.pop()
        if depth is not None and level > depth:
            continue
        if isinstance(value, dict):
            row = job_row(value, base)
            if row:
                yield row
                continue
            stack.extend((v, level + 1) for v in reversed(list(value.values())))
        elif isinstance(value, list):
            stack.extend((v, level + 1) for v in reversed(value))


def _json_from(text: str):
    at = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if at < 0:
        return None
    try:
        return json.JSONDecoder().raw_decode(text[at:])[0]
    except ValueError:
        return None


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.links: list[list[str]] = []
        self.scripts: list[tuple[str, str]] = []
        self._in: list[str] = []
        self._kind = ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self._in.append(tag)
            self._kind = (a.get("type") or "").lower()
            if tag == "script":
                self.scripts.append((self._kind, ""))
        elif tag == "a" and a.get("href"):
            self.links.append([a["href"], ""])

    def handle_endtag(self, tag):
        if self._in and tag == self._in[-1]:
            self._in.pop()

    def handle_data(self, data):
        if self._in:
            if self._in[-1] == "script":
                self.scripts[-1] = (self._kind, self.scripts[-1][1] + data)
            return
        if data.strip():
            self.text.append(data.strip())
            if self.links:
                self.links[-1][1] = (self.links[-1][1] + " " + data.strip()).strip()


_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


def _ended_only(body: str) -> str:
    """The page with an escaped ampersand wherever no whole character reference with its semicolon begins."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], body)


def parse_page(body: str | None, base: str = "", ended: bool = False) -> dict:
    """Text, absolute links, and posting rows from JSON-LD and embedded JSON, one per URL (the last wins).

    ended: character references count with their semicolon alone; otherwise `&amp` is read as browsers do.
    """
    page = _Page()
    page.feed(_ended_only(body or "") if ended else body or "")
    page.close()  # else text behind the last tag may be held back
    rows: dict[str, tuple] = {}
    for kind, script in page.scripts:
        found = _json_from(html.unescape(script))
        if found is None:
            continue
        if "ld+json" in kind:
            graph = found.get("@graph", [found]) if isinstance(found, dict) else found
            found = [x for x in graph if isinstance(x, dict) and x.get("@type") == "JobPosting"]
        for row in harvest(found, base):
            rows[row[1] or row[3]] = row
    links = [(urljoin(base, h), t) for h, t in page.links if not h.startswith(("#", "javascript:", "mailto:"))]
    return {"text": " ".join(" ".join(page.text).split()), "links": links, "rows": list(rows.values())}


def scan_pages(pages: DataFrame, ident: str = "page_id", url: str = "url", body: str = "html", ended: bool = False) -> DataFrame:
    """One row per page: ident, text, links array<struct<url, label>>, rows array<struct<...>>. Null bodies are empty pages; `ended` as in `parse_page`."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = [parse_page(b, u or "", ended) for b, u in zip(pdf["__b"], pdf["__u"])]
            yield pd.DataFrame({ident: pdf[ident], "text": [x["text"] for x in out], "links": [[{"url": a, "label": b} for a, b in x["links"]] for x in out], "rows": [[dict(zip(("title", "url", "location", "ident"), r)) for r in x["rows"]] for x in out]})

    kind = dict(pages.dtypes)[ident]
    schema = f"{ident} {kind}, text string, links array<struct<url:string,label:string>>, rows array<struct<title:string,url:string,location:string,ident:string>>"
    return pages.select(ident, F.col(url).alias("__u"), F.col(body).alias("__b")).mapInPandas(run, schema)


_PLACE_FIELDS = ("name", "LocationName", "city", "City", "state", "State", "addressLocality", "addressRegion", "country", "Country")
_PLACE_KEYS = ("location", "locations", "jobLocation", "JobLocation", "LocationName", "cityName")
PLACE_DEPTH = 3


def _scalar(v: Column, path: str = "$") -> Column:
    """The text of a value under a path, trimmed; null for a missing, null or empty one, an object and a list."""
    text = F.trim(F.try_variant_get(v, path, "string"))
    return F.when((text != "") & F.try_variant_get(v, path, "map<string,variant>").isNull() & F.try_variant_get(v, path, "array<variant>").isNull(), text)


def place_parts(v: Column, depth: int = PLACE_DEPTH) -> Column:
    """The names in a nested place, in order, down to PLACE_DEPTH lists and objects."""
    one = _scalar(v)
    none = F.array().cast("array<string>")
    out = F.when(one.isNotNull(), F.array(one)).otherwise(none)
    if depth:
        deeper = lambda x: place_parts(x, depth - 1)
        items = F.try_variant_get(v, "$", "array<variant>")
        fields = F.filter(F.array(*[F.try_variant_get(v, f"$.{k}", "variant") for k in _PLACE_FIELDS]), lambda x: x.isNotNull())
        out = F.when(items.isNotNull(), F.flatten(F.transform(items, deeper))).when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), F.flatten(F.transform(fields, deeper))).otherwise(out)
    return out


def _first_of(v: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[_scalar(v, f"$.{k}") for k in keys], F.lit(""))


def is_posting(v: Column) -> Column:
    """Whether a value is an object with a title, and a URL or an id."""
    return (_first_of(v, _TITLE_KEYS) != "") & (_first_of(v, (*_URL_KEYS, *_ID_KEYS)) != "")


def posting_of(v: Column) -> Column:
    """P18 in the JVM: struct<title, url, location, ident> of a posting-like object."""
    parts = F.flatten(F.array(*[F.coalesce(place_parts(F.try_variant_get(v, f"$.{k}", "variant")), F.array().cast("array<string>")) for k in _PLACE_KEYS]))
    first = {"title": _TITLE_KEYS, "url": _URL_KEYS, "ident": _ID_KEYS}
    return F.struct(*[_first_of(v, keys).alias(name) for name, keys in first.items()], F.array_join(F.array_distinct(parts), ", ").alias("location"))


def harvest_json(df: DataFrame, ident: str, payload: str, depth: int = 8) -> DataFrame:
    """S7, S8 over JSON texts, in the JVM: `ident` plus title, url, location and ident of the posting rows at any level down to `depth`.

    A level is one lateral `variant_explode` of what is no posting yet; a posting's own children are not searched. Null texts and
    texts that are no JSON give nothing; rows that occur twice are given twice. Other columns are not read.
    """
    spark = df.sparkSession
    nodes = df.select(column(ident).alias("id"), F.try_parse_json(column(payload)).alias("v")).where("v is not null").select("id", "v", F.lit(False).alias("found"))
    for level in range(depth + 1):
        nodes = nodes.withColumn("found", F.col("found") | is_posting(F.col("v")))
        if level < depth:
            children = spark.tvf.variant_explode_outer(F.when(~F.col("found"), F.col("v")).outer())  # a posting stays as one row without a child
            nodes = nodes.lateralJoin(children).select("id", F.when(F.col("found"), F.col("v")).otherwise(F.col("value")).alias("v"), "found").where("v is not null")
    rows = nodes.where("found").select(F.col("id").alias(ident), posting_of(F.col("v")).alias("row"))
    return rows.select(ident, *[F.col(f"row.{c}").alias(c) for c in ("title", "url", "location", "ident") if c != ident])


def json_ld(body: str):
    """S12 in the JVM: array<variant> of the JSON-LD objects of a page, members of @graph one by one."""
    scripts = F.regexp_extract_all(F.col(body), F.lit(r"""(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"""), 1)
    one = lambda s: F.coalesce(F.try_variant_get(F.try_parse_json(s), "$['@graph']", "array<variant>"), F.try_variant_get(F.try_parse_json(s), "$", "array<variant>"), F.array(F.try_parse_json(s)))
    return F.filter(F.flatten(F.transform(scripts, one)), lambda v: v.isNotNull())


def markdown_links(text: str):
    """array<struct<label, url>> of Markdown links."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"\[[^\]\n]+\]\(https?://[^)\s]+\)"), 0)
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^\[([^\]]+)\]", 1).alias("label"), F.regexp_extract(x, r"\((https?://[^)]+)\)$", 1).alias("url")))


def xml_items(text: str, item: str, fields: tuple[str, ...]):
    """array<struct<fields>> of the items of an XML feed; a field that an item lacks is empty."""
    bodies = F.regexp_extract_all(F.col(text), F.lit(rf"(?is)<{item}\b[^>]*>(.*?)</{item}>"), 1)
    field = lambda b, f: F.trim(F.regexp_replace(F.regexp_extract(b, rf"(?is)<{f}\b[^>]*>(.*?)</{f}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
    return F.transform(bodies, lambda b: F.struct(*[field(b, f).alias(f.replace(":", "_")) for f in fields]))


@F.pandas_udf(StringType())
def redirect_target(s):
    """The target of a search engine's redirect link, else the link itself."""

    def one(u):
        if not u:
            return u
        q = parse_qs(urlsplit(u).query)
        for k in ("uddg", "u", "url", "q"):
            if q.get(k, [""])[0].startswith("http"):
                return q[k][0]
        return unquote(u.split("/RU=", 1)[1].split("/", 1)[0]) if "/RU=" in u else u

    return s.map(one)


def _behind_first(parts):
    return F.filter(parts, lambda x, i: i > 0)


def latex_sections(text: str):
    """array<struct<name, body>> of the sections of a LaTeX text; bullets are split by `latex_items`."""
    parts = _behind_first(F.split(F.col(text), r"\\section\*?\{"))
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "}", 1).alias("name"), F.regexp_replace(p, r"(?s)^[^}]*\}", "").alias("body")))


def latex_items(body):
    return F.filter(F.transform(_behind_first(F.split(body, r"\\item\b")), lambda x: F.trim(F.regexp_replace(x, r"(?s)\\end\{itemize\}.*", ""))), lambda x: x != "")
