"""Toxic spans by a linear-chain conditional random field over words.

Labels say which documents are toxic, not which words, so training words get labels first: a word, or
its first four or five letters, is toxic when its document frequencies in toxic and other training
documents differ by a likelihood ratio above EVIDENCE and lean EXCESS-fold to the toxic side. Words of
clean documents, and words of toxic ones that clean documents hold too, are clean; the rest stay
open, and the field sums over both of their states.

The field has two states, a weight per hashed feature of a word (the word, its first letters, its
character n-grams) and transitions. Each step of the fit is one Spark job over the training words:
every task returns the gradient of its documents, forward-backward with the labels held minus
forward-backward without. Scoring runs forward-backward over whole texts; marginals give the toxic
spans with character offsets, and a logistic curve over the most toxic word's odds and the number of words
likelier toxic than not, fitted on training documents, gives the document's score.

The fit uses at most TRAIN_TOXIC and TRAIN_CLEAN labelled rows in hash order, never the held-out ones;
labels, language, source and id are no inputs. Nulls: a null text is empty and scores the least; null labels and ids are not trained on. Repeated rows get equal scores. An empty table gives
no rows. Without toxic or without clean training rows the score is the share of toxic ones.
"""

import re
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C
from textloom.session import checkpoint

HELD_MOD, HELD_REST = 5, 0
TRAIN_TOXIC, TRAIN_CLEAN = 3000, 6000
EVIDENCE, EXCESS = 20.0, 5.0
BITS = 17
FIT_TASKS = 16
STEPS, RATE, DECAY = 20, 0.4, 1e-5
CHUNK = 128
CACHED = 1_000_000
STRIP = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
VISIBLE = re.compile(rb"[^\x20\x09-\x0D]+")
CLEAN, TOXIC, OPEN = 0, 1, 2


def normal(word: bytes) -> bytes:
    return word.lower().strip(STRIP)


def units(word: bytes):
    """What the evidence is counted on: the word and its beginnings."""
    w = normal(word)
    return [b"w" + w] + [b"%d" % k + w[:k] for k in (4, 5) if len(w) > k]


def features(word: bytes):
    """Hashed features of a word: itself, its beginning, and its runs of four bytes."""
    w = normal(word)
    framed = b"<" + w + b">"
    mask = (1 << BITS) - 1
    return [0, crc32(b"w" + w) & mask, crc32(b"4" + w[:4]) & mask, crc32(b"5" + w[:5]) & mask,
            *[crc32(framed[i:i + 4]) & mask for i in range(len(framed) - 3)]]


class Cached(dict):
    """A function of words, computed once for each."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, word):
        self[word] = found = self.function(word)
        return found


def steps(emission, starts, transition):
    """Transfer weights (from clean to clean, clean to toxic, toxic to clean, toxic to toxic) into
    each word; into a text's first word they are the same from either state."""
    base = np.exp(transition)
    m = np.empty((4, len(emission)))
    m[:] = base[:2].ravel()[:, None]
    m[:, starts] = np.tile(base[2], 2)[:, None]
    m[1::2] *= np.exp(np.clip(emission, -30, 30))
    return m


def prefix_messages(m):
    """Share of the toxic state in the messages after each word, from even odds.

    Chunks are multiplied up side by side, their products are carried along, and each chunk is then
    run from its entry.
    """
    n = m.shape[1]
    rows = -(-n // CHUNK)
    padded = np.empty((4, rows * CHUNK))
    padded[:, :n], padded[:, n:] = m, np.array([1.0, 0, 0, 1])[:, None]
    cc, ct, tc, tt = np.ascontiguousarray(padded.reshape(4, rows, CHUNK).transpose(0, 2, 1))
    a, b, c, d = cc[0].copy(), ct[0].copy(), tc[0].copy(), tt[0].copy()
    for k in range(1, CHUNK):
        a, b = a * cc[k] + b * tc[k], a * ct[k] + b * tt[k]
        c, d = c * cc[k] + d * tc[k], c * ct[k] + d * tt[k]
        if k % 8 == 0:
            total = a + b + c + d
            a, b, c, d = a / total, b / total, c / total, d / total
    entry, at = [], 0.5
    for pa_, pb, pc, pd in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist()):
        entry.append(at)
        clean, toxic = (1 - at) * pa_ + at * pc, (1 - at) * pb + at * pd
        at = toxic / (clean + toxic)
    at, out = np.array(entry), np.empty((CHUNK, rows))
    for k in range(CHUNK):
        toxic = ct[k] + at * (tt[k] - ct[k])
        clean = cc[k] + at * (tc[k] - cc[k])
        at = toxic / (clean + toxic)
        out[k] = at
    return out.T.reshape(-1)[:n]


def forward_backward(emission, starts, transition):
    """(marginals, forward and backward messages of the toxic state, weights) of chained texts."""
    m = steps(emission, starts, transition)
    forward = prefix_messages(m)
    # Backward messages are forward ones of the transposed weights from the end.
    back = np.full(m.shape[1], 0.5)
    if m.shape[1] > 1:
        back[:-1] = prefix_messages(m[[0, 2, 1, 3], :0:-1])[::-1]
    toxic, clean = forward * back, (1 - forward) * (1 - back)
    return toxic / (toxic + clean), forward, back, m


def pair_expectations(forward, back, m, starts):
    """Expected transitions inside texts, and expected first states, as three rows of two."""
    inner = np.ones(m.shape[1], bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    f, g = forward[at - 1], back[at]
    x = m[:, at] * np.stack(((1 - f) * (1 - g), (1 - f) * g, f * (1 - g), f * g))
    x = (x / x.sum(0)).sum(1)
    first = forward[starts] * back[starts]
    first = (first / (first + (1 - forward[starts]) * (1 - back[starts]))).sum()
    return np.array([*x, len(starts) - first, first])


class Words(dict):
    """Numbers of distinct words with their features, flat."""

    def __init__(self):
        super().__init__()
        self.flat, self.sizes = [], []

    def __missing__(self, word):
        found = features(word)
        self.flat += found
        self.sizes.append(len(found))
        self[word] = n = len(self)
        return n


def emissions(flat, sizes, weights):
    ends = np.cumsum(sizes)
    sums = np.concatenate(([0.0], np.cumsum(weights[flat])))
    return sums[ends] - sums[ends - sizes]


def training_rows(docs: DataFrame, labels: DataFrame):
    """Text and toxicity of the rows that the fit may see."""
    marked = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(
        ~C.held_out(HELD_MOD, HELD_REST)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    toxic = marked.filter("toxic = 1").orderBy(*order).limit(TRAIN_TOXIC)
    clean = marked.filter("toxic = 0").orderBy(*order).limit(TRAIN_CLEAN)
    few = toxic.unionByName(clean)
    rows = docs.select("doc_id", C.text_bytes().alias("text")).join(F.broadcast(few), "doc_id")
    return checkpoint(rows.select("text", "toxic").repartition(FIT_TASKS)), marked


def evidence(rows: DataFrame, n_toxic, n_clean) -> DataFrame:
    """(unit, verdict): 1 toxic, 0 held by clean documents; other units are left out."""
    def counted(batches):
        for b in batches:
            seen, of = {}, Cached(units)
            for text, toxic in zip(b["text"].to_pylist(), b["toxic"].to_pylist()):
                for u in {u for w in set(text.split()) for u in of[w]}:
                    seen.setdefault(u, [0, 0])[toxic] += 1
            yield C.batch(("unit", "clean", "toxic"), (pa.binary(), pa.int64(), pa.int64()),
                          [(u, *n) for u, n in seen.items()])

    sums = rows.mapInArrow(counted, "unit binary, clean long, toxic long").groupBy("unit").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share, total = n_toxic / (n_toxic + n_clean), F.col("clean") + F.col("toxic")

    def part(c, p):
        return F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (total * p))).otherwise(0.0)

    leans = F.col("toxic") / n_toxic > EXCESS * (F.col("clean") + 0.5) / n_clean
    ratio = 2 * (part("toxic", share) + part("clean", 1 - share))
    return sums.withColumn("verdict", F.when(leans & (ratio > EVIDENCE), 1).when(
        F.col("clean") > 0, 0)).filter("verdict IS NOT NULL").select("unit", "verdict")


def labelled(rows: DataFrame, verdicts) -> DataFrame:
    """Packed training blocks: word numbers, features of the words, text sizes and word labels."""
    def state(word):
        found = [verdicts.value.get(u) for u in units(word)]
        return TOXIC if 1 in found else CLEAN if found[0] == 0 else OPEN

    def run(batches):
        for held in C.gathered(b.select(["toxic", "text"]) for b in batches):
            words, codes, states, sizes, of = Words(), [], [], [], Cached(state)
            for toxic, text in held:
                split = text.split()
                codes += map(words.__getitem__, split)
                states += map(of.__getitem__, split) if toxic else [CLEAN] * len(split)
                sizes.append(len(split))
            if codes:
                yield C.batch(
                    ("codes", "states", "sizes", "flat", "lengths"), (pa.binary(),) * 5,
                    [tuple(C.pack(x) for x in (codes, states, [s for s in sizes if s],
                                               words.flat, words.sizes))])

    return rows.mapInArrow(run, "codes binary, states binary, sizes binary, flat binary, lengths binary")


def gradient(blocks, weights, transition):
    """Sum over the blocks of the gradients, as one row of bytes per task."""
    total = np.zeros(len(weights) + 6, np.float64)
    for b in blocks:
        for row in b.to_pylist():
            codes, states, sizes, flat, lengths = (C.unpack(row[c]) for c in (
                "codes", "states", "sizes", "flat", "lengths"))
            starts = np.cumsum(sizes) - sizes
            free = emissions(flat, lengths, weights)[codes]
            held = np.where(states == TOXIC, 30.0, np.where(states == CLEAN, -30.0, free))
            word = np.zeros(len(lengths))
            for e, sign in ((held, 1.0), (free, -1.0)):
                p, f, g, m = forward_backward(e, starts, transition)
                word += sign * np.bincount(codes, p, minlength=len(lengths))
                total[-6:] += sign * pair_expectations(f, g, m, starts)
            total[:-6] += np.bincount(flat, np.repeat(word, lengths), minlength=len(weights))
    yield C.batch(("g",), (pa.binary(),), [(total.astype(np.float32).tobytes(),)])


def fit_field(blocks: DataFrame, size):
    """Feature weights and transition scores by full-gradient Adam steps, one job each."""
    context = blocks.sparkSession.sparkContext
    theta = np.zeros((1 << BITS) + 6)
    theta[-6:] = [1.0, -3.0, 0.0, 0.0, 1.0, -3.0]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        shared = context.broadcast(theta)

        def run(batches):
            now = shared.value
            yield from gradient(batches, now[:-6], now[-6:].reshape(3, 2))

        total = -DECAY * size * theta
        for row in blocks.mapInArrow(run, "g binary").collect():
            total += np.frombuffer(row.g, np.float32)
        total /= max(size, 1) ** 0.5
        first = 0.8 * first + 0.2 * total
        second = 0.95 * second + 0.05 * total * total
        theta = theta + RATE * (first / (1 - 0.8 ** t)) / (
            np.sqrt(second / (1 - 0.95 ** t)) + 1e-8)
        shared.unpersist()
    return theta


class Tagger:
    """Marginals of words with the fitted field."""

    def __init__(self, theta):
        self.weights, self.transition = theta[:-6], theta[-6:].reshape(3, 2)
        self.known = {}

    def emission(self, words):
        known = self.known
        if len(known) > CACHED:
            known.clear()
        new = [w for w in set(words) if w not in known]
        found = [features(w) for w in new]
        flat = np.fromiter(chain.from_iterable(found), np.int64)
        known.update(zip(new, emissions(flat, [len(f) for f in found], self.weights).tolist()))
        return np.fromiter(map(known.__getitem__, words), float, len(words))

    def marginals(self, texts):
        """A list of words and an array of marginals for each text."""
        split = [t.split() for t in texts]
        sizes = np.array([len(ws) for ws in split])
        full = sizes[sizes > 0]
        if not len(full):
            return split, [np.zeros(0)] * len(split)
        emission = self.emission([w for ws in split for w in ws])
        p = forward_backward(emission, np.cumsum(full) - full, self.transition)[0]
        return split, np.split(p, np.cumsum(sizes)[:-1])


def summary(p):
    """Inputs of the document's curve: the most toxic word, and how many are likelier so than not."""
    top = min(max(float(p.max()) if len(p) else 0.0, 1e-6), 1 - 1e-6)
    return [1.0, np.log(top / (1 - top)), np.log1p(float((p >= 0.5).sum()))]


def logistic(x, y, weight):
    """Newton steps for a small ridge logistic regression."""
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, 1e-2, 1e-2]) * max(len(y), 1) / 100
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def spans(text: bytes, p):
    """Character offsets of the runs of words that are more likely toxic than not."""
    at = [m.span() for m in VISIBLE.finditer(text)]
    return [{"start": len(text[:at[a][0]].decode()), "end": len(text[:at[b - 1][1]].decode())}
            for a, b in zip(*C.runs(p >= 0.5))]


SCHEMA = ("doc_id long, held_out boolean, score double, predicted int, "
          "spans array<struct<start:int,end:int>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score, verdict and toxic spans of every row."""
    context = docs.sparkSession.sparkContext
    rows, marked = training_rows(docs, labels)
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    every = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if n_toxic and n_clean:
        found = evidence(rows, n_toxic, n_clean)
        verdicts = context.broadcast({bytes(r.unit): r.verdict for r in found.collect()})
        blocks = checkpoint(labelled(rows, verdicts))
        theta = fit_field(blocks, rows.agg(F.sum(F.octet_length("text"))).first()[0])
        tagger = Tagger(theta)

        def summarised(batches):
            for b in batches:
                _, ps = tagger.marginals(b["text"].to_pylist())
                yield C.batch(("x", "toxic"), (pa.list_(pa.float64()), pa.int32()),
                              list(zip(map(summary, ps), b["toxic"].to_pylist())))

        data = rows.mapInArrow(summarised, "x array<double>, toxic int").collect()
        y = np.array([r.toxic for r in data], float)
        clean_weight = every.get(0, 0) / n_clean / max(every.get(1, 0) / n_toxic, 1e-9)
        beta = logistic(np.array([r.x for r in data]), y, np.where(y == 1, 1.0, clean_weight))
    else:
        share = n_toxic / max(n_toxic + n_clean, 1)
        share = min(max(share, 1e-6), 1 - 1e-6)
        theta = np.zeros((1 << BITS) + 6)
        beta = np.array([np.log(share / (1 - share)), 0, 0])
    model = context.broadcast((theta, beta))

    def scored(batches):
        theta, beta = model.value
        tagger = Tagger(theta)
        for held in C.gathered(batches, 2 << 20):
            ids, texts, out = zip(*held)
            split, ps = tagger.marginals(texts)
            x = np.array([summary(p) for p in ps])
            score = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            yield C.batch(
                ("doc_id", "held_out", "score", "predicted", "spans"),
                (pa.int64(), pa.bool_(), pa.float64(), pa.int32(),
                 pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                list(zip(ids, out, score.tolist(), (score >= 0.5).astype(int).tolist(),
                         [spans(t, p) if (p >= 0.5).any() else [] for t, p in zip(texts, ps)])))

    plain = docs.select("doc_id", C.text_bytes().alias("text"),
                        C.held_out(HELD_MOD, HELD_REST).alias("held"))
    return plain.mapInArrow(scored, SCHEMA)
