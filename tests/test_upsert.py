"""The identity-aware upsert against rows taken one by one."""

import random

from siltstone.operators import upsert

SCHEMA = "company string, title string, location string, job_url string, canonical_url string, application_id string, score int, visa string, evidence string, description string, skills array<string>, source string, status string, discovered_at string"


def merged(old, row):
    """One incoming row over a posting, as dictionaries."""
    out = dict(row)
    out["company"] = old["company"] if row["company"] == upsert.UNKNOWN_COMPANY else row["company"]
    for c in ("location", "evidence", "description", "skills", "canonical_url", "application_id"):
        out[c] = row[c] or old[c]
    out["score"] = max(row["score"], old["score"])
    out["visa"] = old["visa"] if row["visa"] == upsert.UNCLEAR_VISA else row["visa"]
    out["source"] = row["source"] if row["description"] or not old["source"] else old["source"]
    out["status"] = old["status"] if row["status"] == upsert.TO_VERIFY and old["status"] == upsert.OPEN else row["status"]
    return {**out, "job_url": old["job_url"], "discovered_at": old["discovered_at"]}


def posting(rng, k):
    pick = rng.choice
    return (
        pick(["Acme", "Beta"]), f"Role {k}", pick(["", "Bonn"]), f"https://x.io/{pick(['a', 'b'])}/role-{k}-x", "", pick(["", f"REQ-{1000 + k}"]), rng.randrange(100), pick([upsert.UNCLEAR_VISA, "v1", "v2"]),
        pick(["", "e1", "e2"]), pick(["", "d1", "d2"]), pick([[], ["R"], ["SQL"]]), pick(["s1", "s2", "s3"]), pick([upsert.TO_VERIFY, upsert.OPEN, "gone"]), str(rng.randrange(100)),
    )


def test_fields_are_merged_in_order(spark):
    rng = random.Random(5)
    names = SCHEMA.replace(" string", "").replace(" int", "").replace(" array<>", "").replace(" array<string>", "").split(", ")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    stored = [(k, *posting(rng, k)) for k in range(30)]
    incoming = [(i, "", *posting(rng, rng.randrange(60))) for i in range(300)]
    s = spark.createDataFrame(stored, f"id long, {SCHEMA}")
    i = spark.createDataFrame(incoming, f"seq long, original_url string, {SCHEMA}").repartition(5)
    claims = {r.seq: (r.target, r.head) for r in upsert.assign(s, i).collect()}
    assert len(claims) == 300
    state = {(r[0], None): (dict(zip(names, r[1:])), 0) for r in stored}
    for r in incoming:
        row, key = dict(zip(names, r[2:])), claims[r[0]]
        state[key] = (merged(state[key][0], row), state[key][1] + 1) if key in state else (row, 1)
    got = {(r.id, r["head"]): r for r in upsert.identity_upsert(s, i).collect()}
    assert set(got) == set(state)
    for k, (want, n) in state.items():
        assert {c: got[k][c] for c in names} == want and got[k].n_merged == n, k
    assert {r.change for r in got.values()} == {"inserted", "updated", "kept"} or len(got) > 30


def test_assignment(spark):
    tail = (50, upsert.UNCLEAR_VISA, "", "", [], "s", upsert.OPEN, "1")
    stored = [(7, "Acme", "Analyst", "", "https://a.io/one", "", "", *tail), (3, "Acme", "Analyst", "", "https://a.io/two", "", "", *tail), (9, "Beta", "Lead", "", "https://b.io/x", "", "REQ-900", *tail)]
    incoming = [
        (1, "", "Acme", "Analyst", "", "https://a.io/new", "", "", *tail),  # two stored rows fit: the smaller id
        (2, "", "Other", "Boss", "", "https://c.io/y", "", "REQ-555", *tail),  # new
        (3, "", "Other", "Boss II", "", "https://c.io/z", "", "REQ-555", *tail),  # the same id: goes with 2
        (4, "", "Beta", "Chief", "", "https://b.io/q", "", "REQ-900", *tail),  # the stored id
        (5, "https://b.io/x", "Beta", "Lead", "", "https://b.io/moved", "", "", *tail),  # found by its original URL or its role
        (6, "", "Gamma", "Jobs", "", "https://g.io/", "", "", *tail), (7, "", "Gamma", "Jobs", "", "https://g.io/", "", "", *tail),  # no posting is named: two rows
    ]
    s, i = spark.createDataFrame(stored, f"id long, {SCHEMA}"), spark.createDataFrame(incoming, f"seq long, original_url string, {SCHEMA}")
    got = {r.seq: (r.target, r["head"]) for r in upsert.assign(s, i).collect()}
    assert got[1] == (3, None) and got[2] == got[3] == (None, 2) and got[4] == (9, None) and got[6] == (None, 6) and got[7] == (None, 7)
    assert upsert.identity_upsert(s, i.where("false")).where("change <> 'kept'").count() == 0
    assert upsert.identity_upsert(s.where("false"), i).where("change = 'inserted'").count() == upsert.identity_upsert(s.where("false"), i).count()
