"""Small hostile tables, and plain versions of what the operators compute."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = ["key", "tag", "label", "start", "anchor", "node", "tokens", "rest", "unit", "n"]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def hostile(spark):
    """Null ids and texts, empty, blank, very long, repeated, odd characters; columns that clash with names used inside."""
    line = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"z{i % 9973}q{i // 9973}" for i in range(60_000))
    rows = [(1, line + " tail one"), (2, "head " + line), (2, "head " + line), (3, None), (4, ""), (5, " \t\n "), (None, "no id " + line), (6, long), (7, line + " " + line), (8, "\u0085a b c d"), (9, "a b c d"), (10, "A B C D"), (None, None), (11, "x\n" * 60)]
    data = [(i, t, *(["junk"] * len(EXTRA))) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in EXTRA))


def repeats(rows: list[tuple], k: int) -> dict:
    """(doc_id, text) -> (n_words, n_removed, kept text), by a table of all windows."""
    split = [(i, t, words(t)) for i, t in rows]
    seen = Counter(tuple(w[a : a + k]) for _, _, w in split for a in range(len(w) - k + 1))
    out = {}
    for i, t, w in split:
        gone = set()
        for a in range(len(w) - k + 1):
            if seen[tuple(w[a : a + k])] > 1:
                gone.update(range(a, a + k))
        out[i, t] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def shingles(text: str | None, k: int = 5) -> frozenset:
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows: list[tuple], percent: int) -> dict:
    """doc_id -> smallest id that can be reached, from all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    posts = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            posts[x].append(i)
    pairs = {(a, b) for p in posts.values() for n, a in enumerate(p) for b in p[n + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}
