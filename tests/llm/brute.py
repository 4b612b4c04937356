"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text: str | None, k: int = 5) -> frozenset:
    words = WORDS.findall(lowered(text))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def union_find(n: int, links) -> list[int]:
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def jaccard_components(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows, over all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    holders: dict = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = {(a, b) for h in holders.values() if len(h) > 1 for a in h for b in h if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = union_find(len(rows), links)
    lowest: dict = {}
    for (doc, _), c in zip(rows, comp, strict=True):
        if doc is not None:
            lowest[c] = min(doc, lowest.get(c, doc))
    return [(doc, len(s), lowest.get(c) if s else doc) for (doc, _), s, c in zip(rows, sets, comp, strict=True)]
