"""Ordered fold-merge, upserts, snapshot comparison, retention and enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.rules import Rule, all_matches
from siltstone.functions.text import identity_text, is_placeholder_title, section
from siltstone.functions.urls import base_page_url
from siltstone.names import column, fresh
from siltstone.store import Table


def fold_records(df: DataFrame, keys: Sequence[str], order: Sequence[str], quality: Sequence[str], maxima: Sequence[str] = (), salts: int = 16) -> DataFrame:
    """The rows of each key that become the base of the fold of D3: keys, order. No row holds a key's history.

    The merged row's own quality is what a row has to beat. Of a quality column in `maxima` that is the running
    maximum of all rows. Any other is the base's value, filled from the first row that has one while it is zero; so it is a
    running maximum among the rows that equal the merged row in all columns before it, which starts anew where a
    row is better in one of those and has a value.

    Bases are among the rows that are better than all rows before them in any subset of a key's rows. So a key's rows are
    first dealt to `salts` subsets, and only such rows go on, with those that first fill a column or raise a maximum.
    Both passes are windows, which spill.
    """
    lean = df.select(*keys, *order, *[F.coalesce(F.col(q).cast("double"), F.lit(0.0)).alias(f"q{i}") for i, q in enumerate(quality)]).distinct()
    cols = [f"q{i}" for i in range(len(quality))]
    rising = [c for c, q in zip(cols, quality) if q in maxima]
    filled = [c for c in cols if c not in rising]

    def before(w):
        return w.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)

    salted = lean.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    part = before(W.partitionBy(*keys, "salt"))
    best = F.max(F.struct(*cols)).over(part)
    useful = best.isNull() | (F.struct(*cols) > best)
    for c in rising:
        useful = useful | (F.col(c) > F.max(c).over(part))
    for c in filled:
        useful = useful | ((F.col(c) > 0) & (F.max(c).over(part) <= 0))
    few = salted.withColumn("useful", useful).where("useful").select(*keys, *order, *cols)

    w = before(W.partitionBy(*keys))
    upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    first = F.count("*").over(w) == 0
    few = few.withColumns({"better": first, "equal": ~first})  # by the columns so far: than the merged row before, or as it
    for c in cols:
        if c in rising:
            few = few.withColumn("now", F.max(c).over(w))
        else:
            anew = (F.col(c) > 0) & (F.col("better") | (F.coalesce(F.max(c).over(w), F.lit(0.0)) <= 0))
            few = few.withColumn("turn", F.sum(anew.cast("long")).over(upto))
            given = F.when(anew | F.col("equal"), F.col(c)).otherwise(0.0)
            few = few.withColumn("now", F.coalesce(F.max(F.struct("turn", given.alias("v"))).over(w)["v"], F.lit(0.0)))
        few = few.withColumn("better", F.col("better") | (F.col("equal") & (F.col(c) > F.col("now")))).withColumn("equal", F.col("equal") & (F.col(c) == F.col("now")))
    return few.where("better").select(*keys, *order)


def fold_merge(df: DataFrame, keys: Sequence[str], ordinal: str, quality: Sequence[str], overlay: Sequence[str], unions: Sequence[str] = (), maxima: Sequence[str] = ()) -> DataFrame:
    """D3: fold the rows of a key in order. The row of the strictly better quality tuple is the base of the
    result, its empty fields are filled from the other; `unions` (arrays) keep first-seen order; `maxima` take the larger.

    quality: numeric columns, zero and null being empty; the merged row's own quality takes part in the next step
    (see fold_records). A field's value is that of the last base that has one, else that of the first row that has one:
    two aggregates that are combined before the shuffle, so a key may be as large as it likes. Rows of equal
    ordinals are taken in the order of a hash of their columns; rows with a null key are one key, null ordinals come first.
    A key of one row keeps its arrays as they are. Also returns n_merged, the rows of the key.
    """
    fields = list(dict.fromkeys([*quality, *overlay, *unions, *maxima]))
    # Hashes stand for keys of any type, null too; a row is known by its key, its ordinal and its hash.
    rows = df.select(*keys, F.xxhash64(*keys).alias("key_hash"), F.col(ordinal).alias("at"), F.xxhash64(*keys, ordinal, *fields).alias("row_hash"), *fields)
    order = ["at", "row_hash"]
    kinds = dict(df.dtypes)

    def given(c: str) -> Column:
        if kinds[c] == "string":
            return F.coalesce(F.col(c) != "", F.lit(False))
        if kinds[c].startswith("array"):
            return F.coalesce(F.size(c) > 0, F.lit(False))
        return F.coalesce(F.col(c) != 0, F.lit(False)) if c in quality else F.col(c).isNotNull()

    place = F.struct(*order)
    plain = [c for c in fields if c not in unions and c not in maxima]
    marks = fold_records(rows, ["key_hash"], order, quality, maxima).withColumn("base", F.lit(True)).withColumnsRenamed({"key_hash": "m_key", "at": "m_at", "row_hash": "m_row"})
    same = (F.col("key_hash") == F.col("m_key")) & F.col("at").eqNullSafe(F.col("m_at")) & (F.col("row_hash") == F.col("m_row"))
    marked = rows.join(marks, same, "left").drop("m_key", "m_at", "m_row")
    held = [F.max_by(c, F.when(F.col("base") & given(c), place)).alias(f"l_{c}") for c in plain] + [F.min_by(c, F.when(given(c), place)).alias(f"f_{c}") for c in plain]
    # Where no row has a value, that of the last base stays: null, empty or zero.
    none = [F.max_by(c, F.when(F.col("base"), place)).alias(f"n_{c}") for c in plain]
    only = [F.max_by(c, place).alias(f"o_{c}") for c in unions]
    out = marked.groupBy("key_hash").agg(*[F.first(k).alias(k) for k in keys], *held, *none, *only, *[F.max(c).alias(c) for c in maxima], F.count("*").cast("int").alias("n_merged"))
    for c in unions:
        each = rows.select("key_hash", "at", "row_hash", F.posexplode(c).alias("pos", "item"))
        seen = each.groupBy("key_hash", "item").agg(F.min(F.struct("at", "row_hash", "pos")).alias("seen"))
        lists = seen.groupBy(F.col("key_hash").alias("u_key")).agg(F.transform(F.sort_array(F.collect_list(F.struct("seen", "item"))), lambda x: x["item"]).alias(f"u_{c}"))
        out = out.join(lists, F.col("key_hash") == F.col("u_key"), "left").drop("u_key")
    none_of = lambda c: F.array().cast(kinds[c])
    value = {c: F.coalesce(f"l_{c}", f"f_{c}", f"n_{c}") for c in plain} | {c: F.when(F.col("n_merged") == 1, F.col(f"o_{c}")).otherwise(F.coalesce(f"u_{c}", none_of(c))) for c in unions} | {c: F.col(c) for c in maxima}
    return out.select(*keys, *[value[c].alias(c) for c in fields], "n_merged")


def upsert_latest(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K5: rows of `new` replace those of `old` with the same key; the last of equals in `new` wins by its ordinal `__ord` if present."""
    if "__ord" in new.columns:
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("__ord")))
        new = new.withColumn("__r", rank).where("__r = 1").drop("__r", "__ord")
    return new.unionByName(old.join(new.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


# Field policies of K6: what a stored value and an incoming value become.
POLICIES = {
    "longest": lambda a, b: F.when(F.length(F.coalesce(b, F.lit(""))) > F.length(F.coalesce(a, F.lit(""))), b).otherwise(a),
    "nonempty": lambda a, b: F.coalesce(F.nullif(b, F.lit("")), a),
    "max": lambda a, b: F.greatest(a, b),
    "preserve": lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b),
    "replace": lambda a, b: b,
}


def upsert_fields(old: DataFrame, new: DataFrame, key: str, policy: dict[str, str]) -> DataFrame:
    """K6: full outer join on a unique key, each field by its policy; `change` tells inserted, updated and kept rows."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    only_new, only_old = F.col(f"a.{key}").isNull(), F.col(f"b.{key}").isNull()
    value = lambda c: F.when(only_new, F.col(f"b.{c}")).when(only_old, F.col(f"a.{c}")).otherwise(POLICIES[policy[c]](F.col(f"a.{c}"), F.col(f"b.{c}")))
    change = F.when(only_new, "inserted").when(only_old, "kept").otherwise("updated")
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[value(c).alias(c) for c in policy], change.alias("change"))


def snapshot_diff(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Each key as new, kept or missing."""
    p = previous.select(F.col(key).alias("__p")).distinct()
    c = current.select(F.col(key).alias("__c")).distinct()
    state = F.when(F.col("__p").isNull(), "new").when(F.col("__c").isNull(), "missing").otherwise("kept")
    return p.join(c, F.col("__p") == F.col("__c"), "full_outer").select(F.coalesce("__c", "__p").alias(key), state.alias("state"))


def retain_missing(previous: DataFrame, current: DataFrame, key: str, seen: str, now: Column, days: int) -> DataFrame:
    """Previous rows that are missing now but were seen within `days`."""
    gone = previous.join(current.select(key).distinct(), key, "left_anti")
    kept = gone.where(F.col(seen) >= now - F.make_interval(days=F.lit(days)))
    return kept.withColumn("retained_until", F.col(seen) + F.make_interval(days=F.lit(days)))


# What counts as evidence of a degree or of experience, and hosts of shortened links.
DEGREE = r"ph\.?d|doctorate|doctoral|master'?s|bachelor'?s|博士|硕士|本科"
EXPERIENCE = r"(^|[^a-z0-9])[0-9]+\+?\s*(years?|yrs?)([^a-z0-9]|$)|年.{0,8}经验"
SHORTENERS = r"bit\.ly|tinyurl|forms\.gle|goo\.gl"


REQUIRED_SKILLS = r"(?:required|minimum|basic)\s+(?:skills|qualifications|requirements)"
PREFERRED_SKILLS = r"(?:preferred|desired|nice.to.have)\s+(?:skills|qualifications|requirements)"
AFTER_SKILLS = r"(?:responsibilities|benefits|compensation|about us)"


def enrich(df: DataFrame, description: str, url: str, status: str, score: str, open_status: Sequence[str], repost: Column, skills: Sequence[Rule] = ()) -> DataFrame:
    """Missing evidence costs 4 points each from the score before it; legitimacy is 100 less 18 per flag.

    Required and preferred skills are what the skill rules find in the two sections of the description.
    """
    tagged = lambda start, stop: all_matches(section(F.col(description), start, stop), skills) if skills else F.array().cast("array<string>")
    d = F.lower(F.coalesce(F.col(description), F.lit("")))
    missing = F.filter(
        F.array(
            F.when(~d.rlike(DEGREE), F.lit("degree")),
            F.when(~d.rlike(EXPERIENCE), F.lit("experience")),
        ),
        lambda x: x.isNotNull(),
    )
    flags = F.filter(
        F.array(
            F.when(~F.coalesce(F.col(url).startswith("https://"), F.lit(False)), F.lit("non_https_or_missing_url")),
            F.when(F.col(url).rlike(f"^https?://[^/]*(?:{SHORTENERS})"), F.lit("suspicious_shortener_or_form")),
            F.when(F.trim(d) == "", F.lit("missing_full_description")),
            F.when(~F.coalesce(F.col(status).isin(*open_status), F.lit(False)), F.lit("open_status_not_confirmed")),
            F.when(repost, F.lit("possible_repost_new_url")),
        ),
        lambda x: x.isNotNull(),
    )
    found = {"required_skills": tagged(REQUIRED_SKILLS, PREFERRED_SKILLS), "preferred_skills": tagged(PREFERRED_SKILLS, AFTER_SKILLS)}
    return df.withColumns({"evidence_missing": missing, "legitimacy_flags": flags, **found}).withColumns(
        {
            "score_after": F.greatest(F.lit(0), F.col(score) - 4 * F.size("evidence_missing")),
            "legitimacy_score": F.greatest(F.lit(0), 100 - 18 * F.size("legitimacy_flags")),
        }
    )


BLOCK = 100_000  # consecutive rows that one task of the batch splitter walks through


def _walk(most_rows: int, most_bytes: int, size: int, mark: bool):
    """Within a block of consecutive rows (block, own, entry, base, row, sum): where the walk from each possible entry leaves it, and after
    how many batches; or, if `mark`, the batch of every row from the entry that is known. Behind its own rows a block has the first ones of the next."""
    import numpy as np
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("row")
        row, total = t.column("row").to_numpy(), t.column("sum").to_numpy()
        start = total - t.column("bytes").to_numpy() - 1  # bytes and commas before each row
        after = np.minimum(np.arange(len(row)) + most_rows, np.searchsorted(total, start + most_bytes - 1, side="right"))
        own = int(t.column("own").to_numpy().sum())
        block = t.column("block")[0].as_py()
        if mark:
            at, starts = int(t.column("entry")[0].as_py() - row[0]), []
            while at < own:
                starts.append(at)
                at = int(after[at])
            batch = np.searchsorted(starts, np.arange(own), side="right") - 1 + t.column("base")[0].as_py()
            return pa.table({"row": pa.array(row[:own]), "batch": pa.array(batch.astype(np.int64))})
        leave, count = np.arange(len(row) + 1), np.zeros(len(row) + 1, dtype=np.int64)
        for i in range(own - 1, -1, -1):
            leave[i], count[i] = leave[after[i]], count[after[i]] + 1
        n = min(own, most_rows)
        return pa.table({"block": pa.array(np.full(n, block)), "entry": pa.array(row[:n]), "next": pa.array(row[0] + leave[:n]), "many": pa.array(count[:n])})

    return run


def split_batches(df: DataFrame, ordinal: str, payload: str, most_rows: int, most_bytes: int, block: int = BLOCK) -> DataFrame:
    """K4: df with `batch`, numbered from 0 in order; each batch is bounded by rows and by encoded bytes (brackets and commas count). Raises on a row that is too large.

    Greedy filling: where a batch ends depends on where it began. Prefix sums of the bytes, made by ranges of
    the order, tell for any row where a batch from it would end. Blocks of consecutive rows are walked through apart,
    from each row at which a batch can enter them; the ways through blocks are then joined by
    pointer jumping from the first row, and each block is walked once more from its true entry. So no
    task sees all rows. Rows of equal ordinals are taken in the order of their payloads, null ordinals come first; a null
    payload has no bytes; equal rows are rows of their own. A column `batch` of the input is replaced; an empty table gives no rows.
    """
    from siltstone.operators.scans import numbered

    size = max(block, most_rows)
    names = {k: fresh(df, k) for k in ("row", "sum", "bytes")}
    bytes_ = F.coalesce(F.octet_length(column(payload).cast("string")), F.lit(0)).cast("long")
    whole = F.when(bytes_ + 2 > most_bytes, F.raise_error(F.concat(F.lit("a row of "), bytes_, F.lit(f" bytes exceeds a batch of {most_bytes}")))).otherwise(bytes_)
    rest = df.drop("batch").withColumn(names["bytes"], whole.cast("long"))
    rows = numbered(rest, [column(ordinal).asc_nulls_first(), column(payload).asc_nulls_first()], names["row"], {names["sum"]: F.col(names["bytes"]) + 1})
    lean = rows.df.select(*[F.col(v).alias(k) for k, v in names.items()]).withColumn("block", F.floor((F.col("row") - 1) / size))
    ahead = lean.where((F.col("block") > 0) & ((F.col("row") - 1) % size < most_rows)).withColumn("block", F.col("block") - 1)
    dealt = lean.withColumn("own", F.lit(1)).unionByName(ahead.withColumn("own", F.lit(0)))
    ways = Table(dealt.groupBy("block").applyInArrow(_walk(most_rows, most_bytes, size, False), "block long, entry long, next long, many long"), "batch-ways")
    blocks = ways.df.agg(F.max("block")).first()[0]
    # Entries of blocks 0 to 2^k - 1 are known after k rounds; `leap` crosses 2^k blocks.
    known = Table(df.sparkSession.createDataFrame([(0, 1, 0)], "block long, entry long, base long"), "batch-entries")
    leap, step = ways, 1
    while step <= (blocks or 0):
        ahead = known.df.join(leap.df, ["block", "entry"]).select((F.col("block") + step).alias("block"), F.col("next").alias("entry"), (F.col("base") + F.col("many")).alias("base"))
        known = Table(known.df.unionByName(ahead.where(F.col("block") <= blocks)), "batch-entries")
        far = leap.df.alias("a").join(leap.df.alias("b"), (F.col("a.block") + step == F.col("b.block")) & (F.col("a.next") == F.col("b.entry")))
        leap, step = Table(far.select("a.block", "a.entry", "b.next", (F.col("a.many") + F.col("b.many")).alias("many")), "batch-ways"), 2 * step
    entered = dealt.join(known.df, "block").groupBy("block").applyInArrow(_walk(most_rows, most_bytes, size, True), "row long, batch long")
    entered = entered.withColumnRenamed("row", "of_row")
    return rows.df.join(entered, F.col(names["row"]) == F.col("of_row")).drop("of_row", *names.values())


# How a captured page is stored.
CAPTURED_SOURCE, CAPTURED_STATUS, CAPTURED_SCORE = "bookmark_capture", "已捕获完整JD", 100
UNKNOWN_COMPANY, NO_VISA, UNCLEAR_VISA, CHINA = "待补充公司", "不适用", "JD 未明确", "中国"


def capture_upsert(stored: DataFrame, captured: DataFrame, key: str = "job_url") -> DataFrame:
    """K7: a captured page over its stored posting. Both have key, company, title, location, region, visa, score, description, skills (array), application_id.

    A placeholder company or title keeps the stored one, a shorter description too, and so do an empty location,
    empty skills and an empty id; the score is 100 at least. `change` tells inserted, updated and kept rows.
    """
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    text = lambda c: F.coalesce(c, F.lit(""))
    only_new, only_old = a(key).isNull(), b(key).isNull()
    keep = {
        "company": b("company") == UNKNOWN_COMPANY,
        "title": is_placeholder_title(b("title")),
        "location": text(b("location")) == "",
        "description": F.length(text(b("description"))) < F.length(text(a("description"))),
        "skills": F.size(F.coalesce(b("skills"), F.array().cast("array<string>"))) == 0,
        "application_id": text(b("application_id")) == "",
    }
    merged = [F.when(only_old | (~only_new & F.coalesce(test, F.lit(False))), a(c)).otherwise(b(c)).alias(c) for c, test in keep.items()]
    visa = F.when(b("region") == CHINA, NO_VISA).otherwise(F.coalesce(F.nullif(a("visa"), F.lit("")), F.lit(UNCLEAR_VISA)))
    score = F.when(only_old, a("score")).otherwise(F.greatest(F.coalesce(a("score"), F.lit(0)), F.lit(CAPTURED_SCORE)))
    change = F.when(only_new, "inserted").when(only_old, "kept").otherwise("updated")
    joined = stored.alias("a").join(captured.alias("b"), a(key) == b(key), "full_outer")
    return joined.select(F.coalesce(a(key), b(key)).alias(key), *merged, F.coalesce(b("region"), a("region")).alias("region"), F.when(only_old, a("visa")).otherwise(visa).alias("visa"), score.alias("score"), change.alias("change"))


def compare_and_set(rows: DataFrame, requests: DataFrame, key: str, state: str, expected: str, new: str) -> DataFrame:
    """K9: rows that a request names and whose state is the expected one change it; `changed` tells which. Of several requests for a row one counts."""
    asked = requests.select(key).distinct().withColumn("__asked", F.lit(True))
    changed = F.coalesce(F.col("__asked"), F.lit(False)) & F.coalesce(F.col(state) == expected, F.lit(False))
    return rows.join(asked, key, "left").withColumn("changed", changed).withColumn(state, F.when(F.col("changed"), new).otherwise(F.col(state))).drop("__asked")


# Statuses that count as verified, and how many skills are kept.
VERIFIED = ("开放", "已核验", "已捕获完整JD", "open")
MOST_SKILLS = 12


def china_merge(df: DataFrame, ordinal: str) -> DataFrame:
    """`fold_merge` by the URL, else the job key, else company, title and location; quality is verified, description length, score.

    df: canonical_url, job_url, job_key, company, title, location, description, status, score, source, skills.
    `sources` is sorted, `skills` keep their first-seen order, twelve at most.
    """
    text = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    named = F.concat_ws("::", *[F.coalesce(F.col(c), F.lit("")) for c in ("company", "title", "location")])
    keyed = df.withColumns(
        {
            "identity": F.lower(F.trim(F.coalesce(text("canonical_url"), text("job_url"), text("job_key"), named))),
            "verified": F.coalesce(F.col("status").isin(*VERIFIED), F.lit(False)).cast("int"),
            "described": F.length(F.coalesce(F.col("description"), F.lit(""))),
            "rank_score": F.coalesce(F.col("score"), F.lit(0)),
            "sources": F.filter(F.array(F.trim(F.coalesce(F.col("source"), F.lit("")))), lambda x: x != ""),
        }
    )
    out = fold_merge(keyed, ["identity"], ordinal, ["verified", "described", "rank_score"], ["company", "title", "location", "description", "status"], ["sources", "skills"], ["score", "rank_score"])
    skills = F.filter(F.transform("skills", lambda x: F.trim(x)), lambda x: x != "")
    return out.select("identity", "company", "title", "location", "description", "status", "score", F.sort_array("sources").alias("sources"), F.slice(F.array_distinct(skills), 1, MOST_SKILLS).alias("skills"), "n_merged")


def adopt_legacy(stored: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Incoming rows with an id and a placeholder title, and the stored row without an id that they take over; the first in `order`.

    Both: id, company, title, job_url, application_id. A row is adopted if company, title and page agree.
    """
    keys = lambda df: (identity_text(F.col("company")), identity_text(F.col("title")), base_page_url(F.col("job_url")))
    old = stored.where(F.coalesce(F.col("application_id"), F.lit("")) == "").select(*[k.alias(f"__k{i}") for i, k in enumerate(keys(stored))], F.col("id").alias("adopted"), F.col(order).alias("__o"))
    old = old.groupBy("__k0", "__k1", "__k2").agg(F.min_by("adopted", "__o").alias("adopted"))
    new = incoming.where((F.coalesce(F.col("application_id"), F.lit("")) != "") & is_placeholder_title(F.col("title")))
    new = new.select("id", "application_id", *[k.alias(f"__k{i}") for i, k in enumerate(keys(incoming))])
    return new.join(old, ["__k0", "__k1", "__k2"]).select("id", "application_id", "adopted")
