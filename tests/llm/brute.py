"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, size=5):
    found = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(found) < size:
        return {tuple(found)} if found else set()
    return {tuple(found[k : k + size]) for k in range(len(found) - size + 1)}


def components(sets, percent=80):
    """Component of every row by all pairs; ``sets`` is a list of (doc_id, set)."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            least[find(i)].append(doc_id)
    return [min(least[find(i)], default=None) for i in range(len(sets))]


def window_dedup(rows, size):
    held = [(d, words(t)) for d, t in rows]
    seen = Counter(tuple(w[k : k + size]) for _, w in held for k in range(len(w) - size + 1))
    out = []
    for d, w in held:
        gone = {j for k in range(len(w) - size + 1) if seen[tuple(w[k : k + size])] > 1 for j in range(k, k + size)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def substring_dedup(rows, size):
    """Rows in order of doc_id, no two with one id."""
    seen, out = set(), []
    for d, t in rows:
        text = (t or "").encode()
        gone = [False] * len(text)
        for k in range(len(text) - size + 1):
            part = text[k : k + size]
            if part in seen:
                gone[k : k + size] = [True] * size
            seen.add(part)
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def base_rules(text, size=5):
    text = text or ""
    found = words(text)
    at = defaultdict(list)
    for k in range(len(found) - size + 1):
        at[tuple(found[k : k + size])].append(k)
    covered = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + size)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def edits_within(item, text):
    """Fewest edits between ``item`` and any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)
