"""Plain Python versions that the operators are held against."""

import collections
import hashlib
import re

import xxhash


def simhash(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), seed=42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if ones[i] * 2 > len(grams))


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def repeats(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(x[k : k + length] for _, x in raw for k in range(len(x) - length + 1))
    out = {}
    for i, x in raw:
        hit = [False] * len(x)
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                hit[k : k + length] = [True] * length
        kept = bytes(v for v, f in zip(x, hit) if not f)
        spans = sum(1 for k, f in enumerate(hit) if f and (k == 0 or not hit[k - 1]))
        out[i] = (len(x), sum(hit), spans, hashlib.sha256(kept).hexdigest())
    return out


def edits(a, b, most):
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]
