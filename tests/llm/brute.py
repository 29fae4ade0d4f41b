"""Plain Python versions of the operators, over lists of (doc_id, text)."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def rules(text: str | None) -> tuple:
    w, seen, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    five = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = [False] * len(w)
    for i in range(len(w) - 4):
        if five[tuple(w[i : i + 5])] > 1:
            hit[i : i + 5] = [True] * 5
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, sum(hit), len(w) < 10 or 100 * sum(hit) > 20 * len(w)


def repeats(rows: list, unit: str, window: int) -> dict:
    """Per id: sorted (units, removed, stretches, sha256 of what is left)."""
    units = [(d, (t or "").encode().split() if unit == "word" else (t or "").encode()) for d, t in rows]
    key = (lambda u, i: tuple(u[i : i + window])) if unit == "word" else (lambda u, i: u[i : i + window])
    first: dict = {}
    for d, u in units:
        if d is not None:
            for i in range(len(u) - window + 1):
                first[key(u, i)] = min(first.get(key(u, i), d), d)
    out = collections.defaultdict(list)
    for d, u in units:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1) if d is not None else ():
            if first[key(u, i)] < d:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(u, gone, strict=True) if not g]
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d].append((len(u), sum(gone), spans, hashlib.sha256(b" ".join(kept) if unit == "word" else bytes(kept)).hexdigest()))
    return {d: sorted(v) for d, v in out.items()}


def shingles(text: str | None, k: int) -> frozenset:
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def linked(rows: list, k: int, percent: int) -> dict:
    """Component of each id; rows that share an id are one document."""
    sets = [(d, shingles(t, k)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in parent}


def links(rows: list, k: int, percent: int) -> list:
    """Pairs of similar sets, each by the smallest id that has it."""
    first: dict = {}
    for d, t in rows:
        if d is not None and (s := shingles(t, k)):
            first[s] = min(first.get(s, d), d)
    return sorted({(min(a, b), max(a, b)) for s, a in first.items() for t, b in first.items() if a != b and 100 * len(s & t) >= percent * len(s | t)})
