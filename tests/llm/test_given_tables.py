"""op2, op3, op8 and op9 on the given tables against plain versions of their contracts."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from siltstone.llm.queries import QUERIES

AT = "/root/testdata/sf0.001"


def rows(spark, name):
    return spark.read.parquet(f"{AT}/{name}.parquet").collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_conversations(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    turns = {-1: [("user", said), ("assistant", said)]}
    for r in sorted(rows(spark, "conversations"), key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    want = {}
    for k, t in turns.items():
        loss = "".join(x for role, x in t if role == "assistant")
        want[k] = (len(t), sha("".join(f"{role}\n{x}\n" for role, x in t)), len(loss), sha(loss))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op2_chat_format"](spark, AT).collect()}
    assert got == want


def test_vectors(spark):
    data = rows(spark, "embeddings")
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = {r.vec_id: np.array(r.embedding, dtype=np.float64) / np.linalg.norm(np.array(r.embedding, dtype=np.float64)) for r in data if ok(r.embedding)}
    ids = sorted(unit)
    links = {i: {j for j in ids if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9} for i in ids}
    root = {r.vec_id: r.vec_id for r in data}
    moved = True
    while moved:
        moved = False
        for i in ids:
            low = min([root[i], *(root[j] for j in links[i])])
            moved, root[i] = moved or low < root[i], low
    got = {r.vec_id: r for r in QUERIES["op3_embedding_near_dedup"](spark, AT).collect()}
    assert set(got) == {r.vec_id for r in data}
    assert all(got[i].n_links == len(links.get(i, ())) and got[i].component_id == root[i] and got[i].kept == (root[i] == i) for i in got)


def encoded(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for r in rows(spark, "documents")}


def test_pieces(spark):
    ids = encoded(spark)
    pieces = QUERIES["op8_packing"](spark, AT).collect()
    at, used = {i: 0 for i in ids}, {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == at[r.doc_id] and r.length == len(part) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        at[r.doc_id] += r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {i: len(x) for i, x in ids.items()}
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(used) == -(-sum(map(len, ids.values())) // 2048)


def test_training_order(spark):
    ids = encoded(spark)
    read = QUERIES["op9_training_order"](spark, AT).collect()
    n = -(-sum(map(len, ids.values())) // 2048)
    assert sorted(r.slot for r in read) == sorted(r.sequence_id for r in read) == list(range(n))
    assert sum(r.n_tokens for r in read) == sum(map(len, ids.values()))
    assert all(r.n_tokens == 2048 for r in read if r.sequence_id < n - 1) and [r.slot for r in sorted(read, key=lambda r: r.sequence_id)] != list(range(n))
