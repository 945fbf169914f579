"""Token ids of documents, made once and kept as a table in the shared folder.

Encoding runs in Arrow batches. A text is cut where a non-space is followed by one space and a
non-space: the tokenizer's own pattern always starts a piece there, so the pieces can be encoded apart
and their ids kept in a bounded cache.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.store import Table

EOS = 1
TOKENIZER = "byte_bpe_50k"
_CACHE_ENTRIES = 600_000
_UNSAFE = re.compile(r"\s[ ]|[ ]\s|^[ ]|[ ]$")
_CUT = re.compile(r"(?<=\S)(?=[ ])")
_WORD = re.compile(r"[ ][^\s][^ ]*\Z")
_encoders: dict[str, "CachedEncoder"] = {}


class CachedEncoder:
    """Little-endian unsigned 16-bit ids of a text, equal to the tokenizer's own; ids stay below 65,536."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        path = name if os.path.isabs(name) else public_tokenizers.path(f"{name}.tiktoken")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if len(ranks) >= 1 << 16:
            raise ValueError(f"{name} has {len(ranks)} tokens: ids of 16 bits hold 65,535 and the end of a text")
        self.encoding = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)}
        )
        self.cache: dict[str, bytes] = {}
        opens = [False] * (len(ranks) + 1)
        for token, i in ranks.items():
            opens[i] = token[:1] == b" "
        self.opens = np.array(opens)

    def whole(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u2").tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Words that the cache lacks are encoded in one call, each behind its space."""
        split = [self._items(t) for t in texts]
        if len(self.cache) > _CACHE_ENTRIES:
            self.cache.clear()
        cache, new = self.cache, set()
        for items in split:
            new.update(x for x in items if x.__class__ is str)
        new = list(new.difference(cache))
        if new:
            ids = self.encoding.encode_to_numpy(" " + " ".join(new), allowed_special="all")
            starts = np.flatnonzero(self.opens[ids]) * 2
            data, at = ids.astype("<u2").tobytes(), [*starts.tolist(), 2 * len(ids)]
            cache.update((w, data[a:b]) for w, a, b in zip(new, at[:-1], at[1:], strict=True))
        return [b"".join([cache[x] if x.__class__ is str else x for x in items]) for items in split]

    def _items(self, text: str) -> list[str | bytes]:
        """Words that stand behind one space, as strings; the ids of everything else."""
        if not _UNSAFE.search(text):
            first, *rest = text.split(" ")
            return [self.whole(first), *rest] if first else rest
        parts = _CUT.split(text)
        return [p[1:] if _WORD.match(p) else self.whole(p) for p in parts]


def encoder(name: str = TOKENIZER) -> CachedEncoder:
    if name not in _encoders:
        _encoders[name] = CachedEncoder(name)
    return _encoders[name]


_SCHEMA = "doc_id long, queue string, block int, queue_pos long, block_pos long, n long, ids binary"


def _encode_blocks(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, block, at = encoder(name), TaskContext.get().partitionId(), 0
        queues: dict[str | None, int] = {}
        eos = EOS.to_bytes(2, "little")
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            ids = [x + eos for x in enc.encode_many(texts)]
            names, n = batch.column(1).to_pylist(), [len(x) // 2 for x in ids]
            queue_pos, block_pos = [], []
            for q, k in zip(names, n):
                queue_pos.append(queues.get(q, 0))
                block_pos.append(at)
                queues[q] = queue_pos[-1] + k
                at += k
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([block] * len(n), pa.int32()),
                    pa.array(queue_pos, pa.int64()),
                    pa.array(block_pos, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["doc_id", "queue", "block", "queue_pos", "block_pos", "n", "ids"],
            )

    return run


class TokenTable(Table):
    """doc_id, queue, block (the task that made it), queue_pos and block_pos (tokens before it there), n, ids."""

    def __init__(self, df: DataFrame):
        super().__init__(df, "tokens")


def token_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER) -> TokenTable:
    """Encode each whole text, append EOS and write the table. A null text is empty and gives EOS alone.

    A queue is a source (null: the empty name).
    """
    queue = F.coalesce(F.col(source).cast("string"), F.lit(""))
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), queue.alias("queue"), F.col(text).cast("string").alias("text"))
    made = picked.mapInArrow(_encode_blocks(tokenizer), _SCHEMA)
    return TokenTable(made)


def with_base(table: DataFrame, keys: list[str], limit: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Add `base`: tokens of earlier blocks, per queue if keys are (queue, block); and the totals `t` of each queue.

    The sums of blocks are small rows; they are broadcast up to `limit` of them and joined by shuffle beyond.
    """
    sums = table.groupBy(*keys).agg(F.sum("n").alias("t"))
    by = [k for k in keys if k != "block"]
    before = W.partitionBy(*by).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = Table(sums.withColumn("base", F.coalesce(F.sum("t").over(before), F.lit(0))), "token-sums").df
    totals = sums.groupBy(*by).agg(F.sum("t").alias("t"))
    small = sums.select(*keys, "base")
    return table.join(F.broadcast(small) if small.count() <= limit else small, keys), totals
