"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

WORD = r"[^\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def suffix_dedup(rows, window=50):
    """rows: (doc_id, text) with distinct ids."""
    first = {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for j in range(len(b) - window + 1):
            first.setdefault(b[j : j + window], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - window + 1):
            if first[b[j : j + window]] < i:
                gone[j : j + window] = b"\1" * window
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


def substring_dedup(rows, window=35):
    times, words = Counter(), []
    for i, t in rows:
        w = re.findall(WORD, t or "")
        words.append((i, w))
        times.update(tuple(w[j : j + window]) for j in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if times[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        kept = " ".join(x for x, y in zip(w, gone, strict=True) if not y)
        out.append((i, len(w), sum(gone), sha(kept.encode())))
    return out


def near_duplicates(rows, size, percent):
    """rows: (doc_id, text) with distinct ids; {doc_id: (n_shingles, component_id, kept)}."""
    sets = {}
    for i, t in rows:
        w = re.findall(WORD, lower(t))
        sets[i] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
