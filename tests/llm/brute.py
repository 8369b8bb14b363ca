"""Plain definitions of the problems, for small tables."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations

WORD = re.compile(r"[^\W_]+")


def triples(text):
    w = WORD.findall((text or "").lower())
    if len(w) < 3:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def near_pairs(rows, threshold):
    sets = {r: triples(t) for r, t in rows if r and triples(t)}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def overlaps(rows, part, threshold):
    sets = {r: triples(t) for r, t in rows if triples(t)}
    return {
        (a, b) for a in sets if part.get(a) in ("dev", "test") for b in sets
        if part.get(b) == "train" and a != b and len(sets[a] & sets[b]) >= threshold * len(sets[a]) - 1e-9
    }


def spans(rows, length):
    rows = {r: t for r, t in rows if t and t.strip()}
    seen = defaultdict(set)
    for r, t in rows.items():
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]].add(r)
    out = []
    for r, t in rows.items():
        covered = [False] * len(t)
        for i in range(len(t) - length + 1):
            if len(seen[t[i : i + length]]) > 1:
                covered[i : i + length] = [True] * length
        start = None
        for i, c in enumerate([*covered, False]):
            if c and start is None:
                start = i
            elif not c and start is not None:
                out.append((r, start, i))
                start = None
    return sorted(out)


def groups(rows, entities):
    """rows of (id, meta) -> {id: least related id} of related records."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r, meta in rows:
        find(("r", r))
        for kind, keys in entities.items():
            for k in keys:
                value = "".join(c for c in ((meta or {}).get(k) or "").lower() if c.isalnum())
                if any(c.isdigit() for c in value):
                    parent[find((kind, value))] = find(("r", r))
    members = defaultdict(set)
    for r, _ in rows:
        members[find(("r", r))].add(r)
    return {r: min(m) for m in members.values() if len(m) > 1 for r in m}
