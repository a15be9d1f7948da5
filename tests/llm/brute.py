"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import itertools
import math
import re
import struct

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n=5):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)])


class Groups:
    def __init__(self, keys):
        self.up = {k: k for k in keys}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        p, q = self.find(a), self.find(b)
        self.up[max(p, q)] = min(p, q)


def jaccard_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    groups, ids = Groups(sets), sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                groups.join(a, b)
    return {i: (len(sets[i]), groups.find(i)) for i in ids}


def earlier_strings(rows, length=50):
    """{id: (bytes, removed, spans, kept)}; ids are unique."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone, new = bytearray(len(raw)), []
        for at in range(len(raw) - length + 1):
            part = raw[at:at + length]
            if part in seen:
                gone[at:at + length] = b"\1" * length
            else:
                new.append(part)
        seen.update(new)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(b for b, g in zip(raw, gone) if not g))
    return out


def repeated_windows(texts, width=35):
    """[(words, removed, kept)] in the order of the texts."""
    lists = [words(t) for t in texts]
    seen = collections.Counter(tuple(w[i:i + width]) for w in lists for i in range(len(w) - width + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone[i:i + width] = [True] * width
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def base_counts(text):
    w, t = words(text), text or ""
    seen = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))


def plain_runs(w, least=12):
    """(start, length, period) of every run of a list, by start, then period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s >= q and i - s + q >= least:
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_audit(rows, labels):
    """{(part, order, step): (kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)} by removing filter after filter."""
    good, toxic = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    parts = collections.defaultdict(list)
    for i, t, source in rows:
        t = t or ""
        w = words(t)
        fails = {f for f, hit in {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": re.search(r"[#$%&*|]", t), "E": i is not None and i > first[t]}.items() if hit}
        parts[source or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        share = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                lost = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                share[f] += len(lost)
                failing = sum(f in d[0] for d in docs)
                out[part, "".join(order), step] = [len(left), len(lost), failing - len(lost), sum(d[0] == {f} for d in docs),
                                                   sum(d[1] for d in lost), sum(d[2] for d in lost)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(share[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def _hash(data, seed=42):
    return xxhash.xxh64(data, seed=seed).intdigest()


def _grams(text, buckets):
    h = [_hash(w.encode()) for w in words(text)]
    pairs = [_hash(struct.pack("<Q", y), _hash(struct.pack("<Q", x))) for x, y in itertools.pairwise(h)]
    return [x % buckets for x in h + pairs]


def plain_quality(rows, trusted, buckets=1 << 14, prior=16 << 14, firm=1, low=0.005, steps=10_000):
    """(threshold, {id: (ratio, kept)}) of the log-likelihood ratio of hashed n-grams.

    ``rows``: (id, text); ``trusted``: ids.  A trusted document's own ratio leaves out the trusted
    documents of its tenth.
    """
    grams = {i: _grams(t, buckets) for i, t in rows}
    tenth = {}
    for i, t in rows:
        h = 42 if t is None else _hash(t.encode())
        tenth[i] = (h - (1 << 64) if h >> 63 else h) % 10
    every, good = collections.Counter(), [collections.Counter() for _ in range(10)]
    for i, g in grams.items():
        every.update(g)
        if i in trusted:
            good[tenth[i]].update(g)
    n_every, n_good = sum(every.values()), [sum(c.values()) for c in good]

    def ratio(g, without=None):
        left = [k for k in range(10) if k != without]
        n = sum(n_good[k] for k in left) + prior
        total = 0.0
        for b in g:
            share = (every[b] + 1) / (n_every + buckets)
            total += math.log(sum(good[k][b] for k in left) + prior * share) - math.log(n) - math.log(share)
        return total / len(g) if g else 0.0

    bins = sorted(math.floor(ratio(grams[i], tenth[i]) * steps) for i in grams if i in trusted and len(grams[i]) >= 99)
    at = next((b for k, b in enumerate(bins, 1) if k > low * len(bins)), 0) / steps
    nothing = math.log(prior / (sum(n_good) + prior))
    threshold = (len(bins) * at + firm * nothing) / (len(bins) + firm) - 1e-9
    out = {}
    for i, t in rows:
        n, *_, repeated = base_counts(t)
        r = ratio(grams[i])
        out[i] = r, n >= 50 and 100 * repeated <= 50 * n and r >= threshold
    return threshold, out
