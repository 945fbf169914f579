"""The verification ladder on odd rows."""

from siltstone.operators import verification as V

SCHEMA = "k string, title string, application_id string, official_url string, final_url string, status_code int, page_text string, posting_title string, posting_description string, posting_id string"
LONG = "clinical statistics in R " * 20


def test_every_rung_and_nulls(spark):
    rows = [
        ("none", None, None, None, None, None, None, None, None, None),
        ("gone", "Lead", "A-1", "https://a.io", "https://a.io", 410, "x", None, None, None),
        ("down", "Lead", "A-1", "https://a.io", "https://a.io", None, "x", None, None, None),
        ("blank", "Lead", "A-1", "https://a.io", "https://a.io", 200, "", None, None, None),
        ("closed", "Lead", "A-1", "https://a.io", "https://a.io/jobs/x777", 200, "Position\n has   been filled", "Lead", LONG, None),
        ("open", "Lead of the Lab", "bad id!", "https://a.io", "https://www.a.io/p", 200, "page", "Lab lead II", LONG + "We do not sponsor.", " R-9 "),
        ("short", "Lead", "A-1", "https://a.io", "https://a.io/p", 200, "page", "Lead", "short", None),
        ("other", "Lead", "bad id!", "https://a.io", "https://a.io/p", 200, "page", "Plumber", LONG, None),
        ("text", "Lead", "A-1", "https://a.io", "https://a.io/p", 200, "Lead. H1B sponsorship is possible", None, None, None),
    ]
    out = V.verify(spark.createDataFrame(rows, SCHEMA))
    got = {r.k: r for r in out.collect()}
    assert {k: r.status for k, r in got.items()} == {"none": V.MANUAL, "gone": V.CLOSED, "down": V.MANUAL, "blank": V.MANUAL, "closed": V.CLOSED, "open": V.OPEN, "short": V.MANUAL, "other": V.MANUAL, "text": V.MANUAL}
    assert (got["open"].application_id, got["closed"].application_id, got["other"].application_id, got["gone"].application_id) == ("R-9", "x777", "", "A-1")
    assert (got["open"].visa, got["open"].proof, got["text"].visa, got["text"].proof, got["gone"].visa) == (V.BLOCKED, "do not sponsor", V.SUPPORTED, "H1B sponsor", None)
    assert "HTTP 410" in got["gone"].note and "连接失败" in got["down"].note and got["open"].source == "官网核验 · a.io" and "R-9" in got["open"].evidence
    assert tuple(V.summary(out).first()) == (9, 1, 2, 6, 8, 7, 2)
    assert tuple(V.summary(out.where("false")).first()) == (0,) * 7
