"""Brute force for the decontamination tests: every diagonal of every document against every item."""

import re


def _words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def leaked(docs, items, window=13, substitutions=3):
    index, item_words = {}, {i: _words(t) for i, t in items.items()}
    for i, w in item_words.items():
        for k, x in enumerate(w):
            index.setdefault(x, []).append((i, k))
    found = set()
    for d, text in docs.items():
        w, count = _words(text), {}
        for p, x in enumerate(w):
            for i, k in index.get(x, ()):
                count[i, p - k] = count.get((i, p - k), 0) + 1
        for (i, diag), n in count.items():
            it = item_words[i]
            width = min(window, len(it))
            allowed = width * substitutions // window
            if n < width - allowed:
                continue
            same = [it[j] == w[j + diag] for j in range(max(0, -diag), min(len(it), len(w) - diag))]
            if any(sum(same[a : a + width]) >= width - allowed for a in range(len(same) - width + 1)):
                found.add((d, i))
    return found
