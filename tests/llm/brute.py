"""Plain versions of the operators, for small tables."""

import math
import zlib
from collections import Counter, defaultdict

from textloom.llm import katz


def words(text):
    return (text or "").encode().split()


def katz_scores(docs, k=katz.CUTOFF):
    """doc_id to (tokens, known, training tokens, base, score)."""
    def tokens(t):
        return [w.lower() for w in words(t)] + [b""]

    uni, bi = Counter(), defaultdict(Counter)
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % katz.HELD_MOD != katz.HELD_REST:
            ws = tokens(t)
            uni.update(ws)
            for h, w in zip([None, *ws[:-1]], ws):
                bi[h][w] += 1
    n, v = sum(uni.values()), len(uni)

    def of(counts):
        c = Counter(counts)
        return [c[r] for r in range(1, k + 2)]

    du = katz.discounts(of(uni.values()))
    db = katz.discounts(of(c for x in bi.values() for c in x.values()))

    def less(d, c):
        return c * (d[c] if c <= k else 1)

    total = n + all(c > k for c in uni.values())
    unknown = 1 - sum(less(du, c) for c in uni.values()) / total

    def pu(w):
        return less(du, uni[w]) / total if w in uni else unknown

    size, weight = {}, {}
    for h, x in bi.items():
        size[h] = sum(x.values()) + all(c > k for c in x.values())
        weight[h] = (1 - sum(less(db, c) for c in x.values()) / size[h]) / (
            1 - sum(pu(w) for w in x))

    def p(h, w):
        if h not in bi:
            return pu(w)
        return less(db, bi[h][w]) / size[h] if w in bi[h] else weight[h] * pu(w)

    for h in list(bi)[:20]:
        assert abs(sum(p(h, w) for w in uni) + p(h, b"not a word") - 1) < 1e-9
    out = {}
    for i, t in docs:
        ws = tokens(t)
        out[i] = (len(ws), sum(w in uni for w in ws), n,
                  sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ws),
                  sum(math.log10(p(h, w)) for h, w in zip([None, *ws[:-1]], ws)))
    return out


def repeats(docs, size=13):
    """doc_id to (words, removed words, kept text)."""
    first = {}
    for i, t in docs:
        ws = words(t)
        for k in range(len(ws) - size + 1):
            w = tuple(ws[k:k + size])
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in docs:
        ws, gone = words(t), set()
        for k in range(len(ws) - size + 1):
            if first[tuple(ws[k:k + size])] < i:
                gone.update(range(k, k + size))
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        out[i] = (len(ws), len(gone), kept)
    return out


def components(docs, size=5):
    """doc_id to (shingles, least id that links reach)."""
    sets = {}
    for i, t in docs:
        ws = [w.lower() for w in words(t)]
        sets[i] = ({tuple(ws[k:k + size]) for k in range(len(ws) - size + 1)} if len(ws) >= size
                   else {tuple(ws)} if ws else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in ids}
