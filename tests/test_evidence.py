"""R20 against a loop over all candidates."""

import random

from siltstone.operators import postings as P

LABELS = (*P.EVIDENCE_RANK, "Other", None)


def _expected(rows, most):
    best = {}
    for requirement, fact, label, score in rows:
        row = (P.EVIDENCE_RANK.get(label, 0), score is not None, score or 0.0, label or "", (label, score))
        facts = best.setdefault(requirement, {})
        facts[fact] = max(facts.get(fact, row), row, key=lambda x: x[:4])
    out = set()
    for requirement, facts in best.items():
        ordered = sorted(facts.items(), key=lambda x: ([-int(v) if isinstance(v, bool) else -v for v in x[1][:3]], x[0]))
        out |= {(requirement, fact, *v[4], i + 1) for i, (fact, v) in enumerate(ordered[:most])}
    return out


def test_many_candidates_make_more_tasks_not_larger_ones(spark, monkeypatch):
    monkeypatch.setattr(P, "EVIDENCE_ROWS", 200, raising=False)
    r = random.Random(3)
    rows = [(r.choice((1, 1, 1, None, r.randrange(900))), r.randrange(40), r.choice(LABELS), r.choice((None, 0.5, 1.0, float(r.randrange(9))))) for _ in range(6000)]
    c = spark.createDataFrame(rows, "requirement_id long, fact_id long, classification string, score double")
    keep = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = P.best_evidence(c)
        assert out.rdd.getNumPartitions() == 30
        assert {tuple(x) for x in out.collect()} == _expected(rows, 6)
        assert {tuple(x) for x in P.best_evidence(c, 2).collect()} == _expected(rows, 2)
        assert P.best_evidence(c.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", keep)
