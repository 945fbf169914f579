"""Posting rows of nested JSON in the JVM against the walk that page scans use."""

import json
import random

from siltstone.sources import markup


def test_harvest_equals_a_walk(spark):
    rng = random.Random(7)

    def value(depth):
        pick = rng.random()
        if depth > 10 or pick < 0.15:
            return rng.choice([None, "", "x", 5, 2.5, True, [], {}])
        if pick < 0.4:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        out = {k: value(depth + 1) for k in rng.sample(["a", "jobs", "list", "b c", "location"], rng.randrange(3))}
        if rng.random() < 0.5:
            out[rng.choice(["title", "jobName", "name"])] = rng.choice(["Analyst", " Lead ", "", None, 7])
            out[rng.choice(["url", "jobId", "link"])] = rng.choice(["https://x.io/1", 12, "", None])
            out["location"] = rng.choice(["Bonn", ["Bonn", {"city": "Ulm", "country": "DE"}], {"name": "A", "address": 1, "city": ["B", "A"]}, None, {}])
        return out

    texts = [(i, json.dumps(value(0))) for i in range(400)] + [(900, "{broken"), (901, None), (902, ""), (903, "5"), (904, '[{"title": "A", "id": 1}, {"title": "A", "id": 1}]')]
    want = sorted((i, *r) for i, t in texts for r in ([] if t in (None, "", "{broken") else markup.harvest(json.loads(t), depth=8)))
    df = spark.createDataFrame([(*x, 1, 2) for x in texts], "k int, p string, v int, found int")
    got = sorted(tuple(r) for r in markup.harvest_json(df, "k", "p").collect())
    assert len(want) > 100 and got == want
    plan = markup.harvest_json(df, "k", "p")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
