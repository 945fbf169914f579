from test_tokens import ROWS, SCHEMA

from siltstone.llm import packing
from siltstone.llm.packing import PackingParams, pack


def test_places_do_not_depend_on_the_number_of_queues(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()
    p = PackingParams(length=512, quantum=64)
    for mixture in (None, {"a": 0.5, "b": 0.3, "": 0.2}):
        monkeypatch.setattr(packing, "MAX_QUEUES", 4096)
        want = sorted(map(tuple, pack(df, mixture=mixture, params=p).collect()))
        monkeypatch.setattr(packing, "MAX_QUEUES", 2)
        assert sorted(map(tuple, pack(df, mixture=mixture, params=p).collect())) == want


def test_over_4096_sources_keep_their_weights(spark):
    many = 4200
    rows = [(i, "word " * 200, "abc"[i % 3], "") for i in range(600)]
    rows += [(1000 + i, "word", f"s{i}", "") for i in range(many)]
    name = {i: s for i, _, s, _ in rows}
    got = pack(spark.createDataFrame(rows, SCHEMA).repartition(7), mixture={"a": 0.5, "b": 0.3, "c": 0.2}, params=PackingParams(length=1024, quantum=32)).collect()
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in {r.doc_id: r for r in got}.values())
    per = {}
    for r in got:
        per.setdefault(r.sequence_id, {}).setdefault(name[r.doc_id], []).append(r.length)
    full = [s for s in sorted(per) if set(per[s]) == set("abc")][:60]
    assert len(full) == 60
    for s in full[:-2]:
        for q, share in {"a": 0.5, "b": 0.3, "c": 0.2}.items():
            assert abs(sum(per[s][q]) - share * 1024) <= 2 * 32
