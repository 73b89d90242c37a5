"""Plain-Python versions of the training-data operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b) -> str:
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def lines(rows, min_docs):
    """rows: (doc_id, text); id -> (n_lines, n_dropped, kept)."""
    seen = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(SPACE).translate(LOWER)
            if key:
                seen[key].add(i if i is not None else ("text", t))
    common = {k for k, ids in seen.items() if len(ids) >= min_docs}
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if x.strip(SPACE).translate(LOWER) not in common]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return out


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_groups(rows, share=75):
    sets = defaultdict(list)
    for i, t in rows:
        sets[i].append(shingle_set(t))
    links = []
    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= share * len(x | y) for x in sets[a] for y in sets[b]):
                links.append((a, b))
    top = roots(sets, links)
    return [(i, len(shingle_set(t)), top[i], top[i] == i) for i, t in rows]


def repeats(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p:p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = [True] * length
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def leaks(docs, items, share=75, k=5):
    """Best similarity of any item-sized window that shares a shingle, at or over the threshold."""
    out = {}
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for item, it in items:
            x = WORD.findall((it or "").lower())
            if not x:
                continue
            kk = min(k, len(x))
            own = Counter(tuple(x[i:i + kk]) for i in range(len(x) - kk + 1))
            held = [tuple(w[i:i + kk]) in own for i in range(len(w) - kk + 1)]
            if not any(held):
                continue
            for start in range(-len(x) + 1, len(w)):
                if not any(held[max(0, start):start + len(x)]):
                    continue  # no shingle in common
                win = w[max(0, start):start + len(x)]
                if len(win) < kk or min(k, len(win)) != kk:
                    continue
                c = Counter(tuple(win[i:i + kk]) for i in range(len(win) - kk + 1))
                m = sum((c & own).values())
                s = m / sum((c | own).values())
                if m and 100 * m >= share * sum((c | own).values()):
                    out[(d, item)] = max(s, out.get((d, item), 0))
    return out


def targets(sizes, weights=(3, 1, 2), total=1.5, cap=2.0):
    """sizes: source -> words; the share as the contract words it, round by round."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = total * sum(sizes.values()), set(order), {}
    while open_:
        all_w = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / all_w > cap * sizes[s]]
        if not over:
            return out | {s: left * w[s] / all_w for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            open_.discard(s)
        left = total * sum(sizes.values()) - sum(out.values())
    return out


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence(rows, min_docs=3, top=200):
    """rows: (text, lang, source); every row of the audit, term by term."""
    docs = [(TERM.findall((t or "").translate(LOWER)), lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        held = Counter(t for words, _, _ in own for t in set(words))
        kept = [t for t in held if held[t] >= min_docs]
        count = {s: Counter(t for words, _, x in own if x == s for t in words if held[t] >= min_docs) for s in {d[2] for d in own}}
        whole = sum(count.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept))

        def f(a, b, t):
            return (p(a, t) - p(b, t)) ** 2 // p(b, t)
        for s, c in count.items():
            pairs = [(-sum(f(c, count[o], t) for t in kept), o.encode(), o) for o in count if o != s]
            terms = [(-f(c, whole, t), t.encode(), t) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, r) for r, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def token_counts(rows, folds=10, held=0):
    """rows: (doc_id, text); each row's (held out, tokens, known, N, base score) and the training counts."""
    def out(i):
        return i is not None and zlib.crc32(str(i).encode()) % folds == held

    def tokens(t):
        return [*WORD.findall((t or "").translate(LOWER)), None]  # None: the end
    count = Counter(w for i, t in rows if i is not None and not out(i) for w in tokens(t))
    n, v = count.total(), len(count)
    return [(i, out(i), len(w := tokens(t)), sum(count[x] > 0 for x in w), n,
             sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for i, t in rows], count
