"""Words of many texts at once: 64-bit hashes from one pass over the bytes."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x2545F4914F6CDD1D | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if n <= 1 << 22:
            _powers[name] = table
    return table[:n]


def hash_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without space, tab to carriage return), and the number of words of each text."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    sums = np.empty(len(buf) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((buf + np.uint64(1)) * _power_table("up", _BASE, len(buf)), out=sums[1:])
    value = (sums[end] - sums[start]) * _power_table("down", _INVERSE, len(buf))[start]
    hashes = mix(value ^ (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return hashes, np.diff(np.searchsorted(start, bounds + 1))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, across the ends of texts too: filter by position."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    key = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for i in range(n):
        key = key * np.uint64(0xD6E8FEB86659FD93) + hashes[i : len(hashes) - n + 1 + i]
    return mix(key)


def chunks(texts: list[str | None], size: int = 1 << 21):
    """Index ranges of texts that together have at most `size` characters, or one text each."""
    a = total = 0
    for b, t in enumerate(texts):
        k = len(t or "")
        if b > a and total + k > size:
            yield a, b
            a, total = b, 0
        total += k
    if a < len(texts):
        yield a, len(texts)
