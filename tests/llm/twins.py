"""Plain versions of the operators' results, for comparison on small tables."""

import collections
import hashlib
import itertools
import re

import numpy as np
import xxhash


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingles(text, width=5):
    words = tuple(re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))
    return {words[i : i + width] for i in range(max(1, len(words) - width + 1))}


def repeats(texts, length):
    """Per text: the removed runs, by comparing all strings of ``length`` bytes."""
    data = [(t or "").encode() for t in texts]
    at = collections.defaultdict(list)
    for d, x in enumerate(data):
        for i in range(len(x) - length + 1):
            at[x[i : i + length]].append((d, i))
    gone = [np.zeros(len(x), bool) for x in data]
    for places in at.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = True
    out = []
    for x, g in zip(data, gone, strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], g.astype(int), [0]))))
        kept = bytes(np.frombuffer(x, np.uint8)[~g])
        out.append((len(x), int(g.sum()), [list(map(int, e)) for e in edges.reshape(-1, 2)], hashlib.sha256(kept).hexdigest()))
    return out


def spans(text, rules):
    """``rules``: (kind, pattern, test of the match) in the order of kinds; kind:start:end by start, then by kind."""
    found = [(m.start(), i, m.end(), kind) for i, (kind, pattern, ok) in enumerate(rules) for m in re.finditer(pattern, text or "") if ok(m)]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m[0])


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
]
SECRET = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def edits(pattern, text):
    """Least edits between the pattern and any substring of the text."""
    row = np.zeros(len(text) + 1, np.int64)
    codes = np.array([ord(c) for c in text], np.int64)
    lanes = np.arange(len(text) + 1)
    for i, c in enumerate(pattern, 1):
        take = np.concatenate(([i], row[:-1] + (codes != ord(c))))
        take = np.minimum(take, row + 1)
        row = np.minimum.accumulate(take - lanes) + lanes
    return int(row.min())


def water_fill(sizes, weights, budget, epochs):
    """One round after the other: share, clamp, share the rest among those that aren't full."""
    left, targets, open_ = budget * sum(sizes.values()), {}, dict(weights)
    while open_:
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * level >= sizes[s] * epochs]
        if not full:
            return targets | {s: w * level for s, w in open_.items()}
        for s in full:
            targets[s] = sizes[s] * epochs
            left -= targets[s]
            del open_[s]
    return targets


def cosine_links(vectors, least=0.9):
    fit = [k for k, v in vectors.items() if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(vectors[k], float) / np.linalg.norm(np.array(vectors[k], float)) for k in fit}
    return [(a, b) for a, b in itertools.combinations(fit, 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]
