import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm.order import FeistelPermutation, OrderParams, materialise, read_slots
from siltstone.llm.packing import PackingParams, integer_weights, pack
from siltstone.llm.tokens import encoder

REFERENCE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*REFERENCE.encode(text or "", add_special_tokens=False).ids, 1]


def test_cached_ids_equal_the_tokenizer():
    rng = random.Random(5)
    letters = [*"ab  \n\t é世😀<|>'s1.,!\x0b\x1c ", "<|endoftext|>", " the", "'ll"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 16))) for _ in range(3000)]
    for text, got in zip(texts, encoder().encode_many(texts)):
        assert np.frombuffer(got, "<u2").tolist() == ids_of(text)[:-1], repr(text)


ROWS = [
    *[(i, f"Some text number {i} " * (i % 37), ("a", "b", None, "c", "a")[i % 5], "clash") for i in range(150)],
    (150, None, "a", ""),
    (151, "", "zz", ""),
    (152, "long text " * 9000, "a", ""),
    (200, "again", "b", ""),
    (200, "again", "b", ""),
]
SCHEMA = "doc_id long, text string, source string, queue string"


def test_packing_is_gapless_and_whole(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    p = PackingParams(length=512, quantum=64)
    rows = pack(df, params=p).collect()
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    for s, parts in seqs.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 512 or (s == len(seqs) - 1 and 0 < at <= 512)
    want = {i: ids_of(t) for i, t, _, _ in ROWS}
    docs = {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert set(docs) == set(want)
    for i, parts in docs.items():
        ids, copies = want[i], sum(x[0] == i for x in ROWS)
        assert sum(x[1] for x in parts) == copies * len(ids) and {x[3] for x in parts} == {len(ids)}
        for start, length, crc, _ in parts:
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())


def test_windows_hold_the_target_mixture(spark):
    rows = [(i, "word " * 200, "abc"[i % 3], "") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    p = PackingParams(length=1024, quantum=32)
    got = pack(df, mixture={"a": 0.5, "b": 0.3, "c": 0.2}, params=p)
    name = {i: s for i, _, s, _ in rows}
    per = {}
    for r in got.collect():
        per.setdefault(r.sequence_id, {}).setdefault(name[r.doc_id], []).append(r.length)
    full = [s for s, x in per.items() if len(x) == 3][:60]
    assert len(full) == 60
    for s in full[:-2]:
        for q, share in {"a": 0.5, "b": 0.3, "c": 0.2}.items():
            assert abs(sum(per[s][q]) - share * 1024) <= 2 * 32
    assert integer_weights({"x": 0}, None) == {"x": 1}
    assert pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000, 4097])
def test_feistel_is_a_bijection(n):
    f = FeistelPermutation(n, 7)
    slots = f.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert f.sequence(slots).tolist() == list(range(n))


def test_shards_round_trip_and_resume(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(6)
    p = OrderParams(length=64, per_shard=50)
    made = materialise(df, params=p)
    rows = sorted(read_slots(spark, made).collect(), key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in rows] == list(range(made.n_slots))
    assert sorted(r.slot for r in rows) == list(range(made.n_slots))
    assert [r.slot for r in rows[:40]] != sorted(r.slot for r in rows[:40])
    stream = np.frombuffer(b"".join(bytes(r.ids) for r in rows), "<u2").tolist()
    ends = [i + 1 for i, x in enumerate(stream) if x == 1]
    got = sorted(tuple(stream[a:b]) for a, b in zip([0, *ends], ends))
    assert got == sorted(tuple(ids_of(t)) for _, t, _, _ in ROWS)
    again = {r.slot: bytes(r.ids) for r in read_slots(spark, made, 60, 121).collect()}
    assert again == {r.slot: bytes(r.ids) for r in rows if 60 <= r.slot < 121}
    assert made.shards.agg(F.sum("n_slots")).first()[0] == made.n_slots


def test_empty_input_gives_no_slots(spark):
    assert read_slots(spark, materialise(spark.createDataFrame([], SCHEMA))).count() == 0


def test_a_damaged_shard_raises(spark):
    import pytest

    df = spark.createDataFrame([(i, f"text number {i} of some", "s") for i in range(400)], "doc_id long, text string, source string")
    made = materialise(df, params=OrderParams(length=16, per_shard=40, checked=7, tasks=2))
    slots = {r.slot for r in read_slots(spark, made).collect()}
    assert slots == set(range(made.n_slots)) and made.shards.count() > 2
    path = sorted(__import__("pathlib").Path(made.folder.removeprefix("file:")).glob("shard-*.bin"))[1]
    data = bytearray(path.read_bytes())
    data[33] ^= 1
    path.write_bytes(bytes(data))
    assert {r.slot for r in read_slots(spark, made, 80, 90).collect()} == set(range(80, 90))
    with pytest.raises(Exception, match="check sum"):
        read_slots(spark, made).collect()


def test_windows_hold_a_given_mixture_while_sources_last(spark):
    from siltstone.llm.packing import pack

    rows = [(i, "word " * 300, "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {i: s for i, _, s in rows}
    got = {}
    for r in pack(df, mixture={"a": 0.75, "b": 0.25}).collect():
        got.setdefault(r.sequence_id, {}).setdefault(source[r.doc_id], []).append(r.length)
    first = [got[k] for k in range(len(got) // 2)]
    assert all(abs(sum(x["a"]) / 2048 - 0.75) <= 256 / 2048 for x in first)


def test_tempered_shares_fill_the_windows_of_both_ways_to_place(spark, monkeypatch):
    from siltstone.llm import packing

    rows = [(i, "word " * 300, "abc"[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {i: s for i, _, s in rows}
    share = {"a": 0.7**0.5, "b": 0.2**0.5, "c": 0.1**0.5}
    found = []
    for queues in (4096, 1):
        monkeypatch.setattr(packing, "MAX_QUEUES", queues)
        pieces = packing.pack(df, temper=0.5).collect()
        found.append(sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in pieces))
        got = {}
        for r in pieces:
            got.setdefault(r.sequence_id, {}).setdefault(source[r.doc_id], []).append(r.length)
        for s, x in share.items():
            served = 0
            for k in range(20):  # the smallest source lasts that long; what a window falls short of is carried on
                served += sum(got[k].get(s, [0]))
                assert abs(served - (k + 1) * 2048 * x / sum(share.values())) <= 2 * 256
    assert found[0] == found[1]
