"""Plain versions of the operators, one document or pair at a time."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")

#: null, empty, blank, short, repeated rows, a repeated id, long, wide characters
EDGE_TEXTS = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n ", None, None),
    (4, "one", "en", None),
    (5, "a b c d e f", "en", "a"),
    (5, "a b c d e f", "en", "a"),
    (6, "A B c d e f", "en", "b"),
    (None, "no id here at all", "en", "b"),
    (7, "é ß   wide　char 'tis it's", "fr", "b"),
    (8, ("word " * 30 + "\n") * 40, "en", "a"),
    (9, " ".join(f"w{i % 977}x" for i in range(30_000)), "en", "a"),
]
EDGE_SCHEMA = "doc_id long, text string, lang string, source string"


def edge_docs(spark):
    """The edge texts with columns whose names clash with the operators' own."""
    rows = [(*r, 1, "x", 2.0, [1]) for r in EDGE_TEXTS]
    extra = ", n long, block string, score double, ids array<int>"
    return spark.createDataFrame(rows, EDGE_SCHEMA + extra)


def no_docs(spark):
    return edge_docs(spark).limit(0)


def find(up, x):
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def counts(text):
    words = WORD.findall(text or "")
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(tri)
    covered = {i + k for i, t in enumerate(tri) if times[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def shingle_set(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def near_groups(docs):
    """doc position -> smallest position reachable, from [(id, text)]."""
    sets = [shingle_set(t) for _, t in docs]
    up = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = find(up, i), find(up, j)
                up[max(x, y)] = min(x, y)
    return [find(up, i) for i in range(len(docs))]


def base_scores(docs):
    """(n_tokens, n_known, N, base) per (id, text), as the contract states."""
    tokens = [[*(t or "").encode().lower().split(), b"\n"] for _, t in docs]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in docs]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [
        (h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        for t, h in zip(tokens, held, strict=True)
    ]


def base_spans(text):
    """Spans of the three fixed kinds, by hand-written scans."""
    text = text or ""
    out = []
    key = re.compile("(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    out += [(m.start(), 0, m.end(), "assign") for m in key.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, e, k in sorted(out)]
