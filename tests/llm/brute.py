"""Plain Python versions of the operators, for small fixtures."""

import collections
import hashlib
import re

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def components(rows):
    """rows: (doc_id, text) with distinct ids -> {doc_id: (set size, smallest linked id)}."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def repeats(rows, length=50):
    """rows: (doc_id, bytes) -> [(doc_id, n_bytes, n_removed, n_spans, sha256 of the rest)]."""
    first = {}
    big = 1 << 62
    for d, t in sorted(rows, key=lambda r: big if r[0] is None else r[0]):
        for i in range(len(t) - length + 1):
            first.setdefault(t[i : i + length], big if d is None else d)
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < (big if d is None else d):
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def base_spans(text):
    """Contract spans: (start, kind number, end)."""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def smith_waterman(a, b, match=2, mismatch=-1, gap=-1):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), h[i - 1][j] + gap, h[i][j - 1] + gap)
            best = max(best, h[i][j])
    return best


def itemsets(rows, label, min_support, min_confidence):
    """Association rules antecedent -> label by enumeration: {frozenset: (support, confidence)}."""
    from itertools import combinations

    n = len(rows)
    sets = collections.Counter()
    for row in rows:
        items = sorted(set(row) - {label})
        for size in range(1, len(items) + 1):
            for c in combinations(items, size):
                sets[frozenset(c), False] += 1
                if label in row:
                    sets[frozenset(c), True] += 1
    least = -(-min_support * n // 1)
    return {k: (v / n, v / sets[k, False]) for (k, bad), v in sets.items() if bad and v >= least and v / sets[k, False] >= min_confidence}
