"""Plain Python versions of the text operators, one document at a time, for comparison."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(doc_id, n, k):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % n == k


def spaced_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(FOLD)) if w]


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def exact(rows):
    """(doc_id, keep_id, group_size, sha256) of (doc_id, text) rows."""
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = collections.defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    return sorted((i, min(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)


def windows(text, width=10):
    w = alnum_words(text)
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def contaminated(rows, items):
    """doc_id -> (words, words hit, item ids as strings) ."""
    by = collections.defaultdict(set)
    for item, text in items:
        for win in windows(text):
            by[win].add(str(item))
    sizes = {len(w) for w in by}
    out = {}
    for i, text in rows:
        w, hit, found = alnum_words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                names = by.get(tuple(w[k:k + n]))
                if names:
                    hit.update(range(k, k + n))
                    found |= names
        out[i] = (len(w), len(hit), sorted(found))
    return out


def components(rows, percent=75):
    """doc_id -> (set size, component id)."""
    sets = {}
    for i, text in rows:
        w = spaced_words(text)
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def katz(rows, discounts, level, epsilon):
    """doc_id -> (tokens, known, base, score); discounts: counts of counts -> d(0..level)."""
    docs = [(i, spaced_words(t) + [None], held(i, 7, 2)) for i, t in rows]
    uni, bi, start = collections.Counter(), collections.Counter(), collections.Counter()
    for _, t, out in docs:
        if not out:
            uni.update(t)
            for v, w in zip(["\n"] + t, t):
                bi[v, w] += 1
                start[v] += 1
    total, kinds = sum(uni.values()), len(uni)

    def cut(counter):
        n = [0] * (level + 2)
        for c in counter.values():
            if c <= level + 1:
                n[c] += 1
        d = discounts(n)
        return lambda c: (d[c] if c <= level else 1 - epsilon) * c

    cu, cb = cut(uni), cut(bi)
    unknown = 1 - sum(map(cu, uni.values())) / total if total else 1.0
    p = lambda w: cu(uni[w]) / total if uni[w] else unknown
    after = collections.defaultdict(list)
    for (v, w), c in bi.items():
        after[v].append((w, c))
    weight = {v: (1 - sum(cb(c) for _, c in f) / start[v]) / (1 - sum(p(w) for w, _ in f)) for v, f in after.items()}
    q = lambda v, w: cb(bi[v, w]) / start[v] if bi[v, w] else weight.get(v, 1.0) * p(w)
    return {i: (len(t), sum(uni[w] > 0 for w in t), sum(math.log10((uni[w] + 1) / (total + kinds + 1)) for w in t),
                sum(math.log10(q(v, w)) for v, w in zip(["\n"] + t, t))) for i, t, _ in docs}, (uni, start, q)


SECRETS = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
           ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def base_spans(text):
    order = {k: i for i, (k, _, _) in enumerate(SECRETS)}
    found = [(m.start(), k, m.end()) for k, p, ok in SECRETS for m in p.finditer(text or "") if ok(m)]
    return [f"{k}:{s}:{e}" for s, k, e in sorted(found, key=lambda x: (x[0], order[x[1]]))]


def spaced_words_as_is(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
