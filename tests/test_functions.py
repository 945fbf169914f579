import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import rules as R
from siltstone.functions import text as T
from siltstone.functions import urls as U


def one(spark, make, *values):
    """The expression over each value, as a list."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_canonical_urls(spark):
    got = one(spark, U.canonical_url, "https://www.Example.com/jobs/1/?utm_source=x&ref=abc", "HTTP://A.b/?z=1&a=2#f", "not a url ", None)
    assert got == ["https://example.com/jobs/1", "http://a.b/?a=2&z=1", "not a url", ""]
    got = one(spark, lambda c: U.canonical_url(c, U.IDENTITY), "https://a.b/x#job=77", "https://a.b/x#top", "https://a.b/x?gh_jid=5&from=q")
    assert got == ["https://a.b/x#job=77", "https://a.b/x", "https://a.b/x?gh_jid=5"]
    assert one(spark, lambda c: U.canonical_url(c, U.AGGREGATOR), "https://a.b/x?gh_jid=5") == ["https://a.b/x"]
    assert one(spark, lambda c: U.canonical_url(c, U.METRICS), "https://a.b/x?q=5") == ["https://a.b/x"]


def test_stable_ids(spark):
    want = {
        "https://www.a.com/jobs/req/12345/": "a.com:path:12345",
        "https://a.com/x?JobId=AB-9": "a.com:query:jobid:ab-9",
        "https://a.com/view/x999": "a.com:path:x999",
        "https://a.com/R-12345": "a.com:path:r-12345",
        "https://a.com/#/job/778": "a.com:hash:778",
        "https://a.com/jobs/search": "",
        "ftp://a.com/jobs/12345": "",
        "https://a.com/0a1b2c3d-1111-2222-3333-444455556666": "a.com:path:0a1b2c3d-1111-2222-3333-444455556666",
    }
    assert one(spark, U.stable_id, *want) == list(want.values())
    assert one(spark, lambda c: U.stable_id(F.lit("https://a.com"), c), "REQ 77", "apply", None) == ["explicit:req77", "", ""]


def test_text_projections(spark):
    assert one(spark, T.squeeze, " a \n b\t", None) == ["a b", ""]
    assert one(spark, T.identity_text, "R&D, Ünit 数据", None) == ["randdnit数据", ""]
    assert one(spark, T.location_key, "Remote, USA", "Boston, United States") == ["", "boston"]
    assert one(spark, T.is_placeholder_title, "Careers", "Jobs - all", "Engineer", "某公司校园招聘", "") == [True, True, False, True, True]
    assert one(spark, T.fnv1a, "abc", "") == [440920331, 2166136261]
    assert one(spark, T.strip_html, "<p>a&nbsp;<b>b</b></p><script>x</script> &amp; c") == ["a b & c"]
    assert one(spark, T.html_title, "<title>T | Site</title>", "<h1>H <i>x</i></h1><title>T</title>") == ["T", "H x"]
    assert one(spark, T.latex_to_text, r"\textbf{A} \& \emph{b} % note", r"\href{u}{L} --- x") == ["A & b", "L - x"]
    assert one(spark, T.split_tags, "a|b，c; ;d") == [["a", "b", "c", "d"]]
    assert one(spark, T.year_month, "2023-4", "Sept 2021", "x", "2020年12月") == ["2023-04", "2021-09", "", "2020-12"]
    assert one(spark, T.nfkc, "ＡＢ１", None) == ["AB1", None]
    assert one(spark, lambda c: T.section(c, "required:", "preferred:"), "x Required: a b Preferred: c", "required: tail", "none") == [" a b ", " tail", ""]
    assert one(spark, T.company_match_keys, "Acme Inc. (US)") == [["acmeincus", "acme"]]
    r = spark.sql("select ' San Francisco ' a, 'USA' b, 'USA' c, '' d").select(T.join_distinct(*map(F.col, "abcd")).alias("x"), T.first_nonempty(F.col("d"), F.col("b")).alias("y")).first()
    assert (r.x, r.y) == ("San Francisco, USA", "USA")


def test_rules(spark):
    got = one(spark, R.monthly_floor, "1-1.5万", "9千-1万", "300元/天", "薪资8550", "面议")
    assert [None if x is None else round(x, 3) for x in got] == [10, 9, 6.525, 8.55, None]
    assert one(spark, lambda c: R.largest_number(c, r"([0-9]+)\+?\s*years"), "3 years or 5+ years", "none") == [5, None]
    d = datetime.date
    got = one(spark, R.deadline, "Deadline: 2024-02-30", "Apply by March 5th, 2024", "截止 2024年3月9日", "closing date 12/31/2023", "on 2024-01-01")
    assert got == [None, d(2024, 3, 5), d(2024, 3, 9), d(2023, 12, 31), None]
    assert one(spark, lambda c: R.all_matches(c, [("R", R.word("r")), ("SAS", "sas"), ("SQL", "sql")], 2), "r sql sas", "x") == [["R", "SAS"], []]
    assert one(spark, lambda c: R.blocked_or_supported(c, "no visa", "visa"), "no visa", "visa", "-") == ["blocked", "supported", "unknown"]
    assert one(spark, lambda c: R.round_half_up(c.cast("double")), "2.5", "2.4") == [3, 2]
    assert one(spark, U.is_safe_url, "https://a.com/x", "http://127.0.0.1/", "http://localhost", "https://u@a.com", "file:///etc", "http://[::1]/") == [True, False, False, False, False, False]
    assert one(spark, lambda c: U.token_overlap(c, F.lit("senior data analyst role")), "Data analyst", "x") == [0.5, 0.0]
    r = spark.range(1).select(R.display_rank(F.lit(True), F.lit(False), F.lit(True), F.lit('["R"]'), F.lit(80)).alias("x")).first()
    assert r.x == 100 + 10 + 5 + 8


@pytest.mark.parametrize("flavour", [U.MERGE, U.IDENTITY, U.METRICS])
def test_canonical_form_is_idempotent(spark, flavour):
    part = st.text("aB1-_/.?&=#%", max_size=12)
    urls: list[str] = []

    @settings(max_examples=60, database=None)
    @given(part, part)
    def gather(a, b):
        urls.append(f"https://www.x{a.strip('/?#')}.com/{b}")

    gather()
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.canonical_url(F.col("u"), flavour).alias("c"))
    bad = df.select("u", "c", U.canonical_url(F.col("c"), flavour).alias("cc")).where("c <> cc").collect()
    assert not [r for r in bad if not r.c.startswith("https://www.")]
