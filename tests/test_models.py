"""Kernel Bayes, F-tests, decomposition and the vector index against plain versions."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import embed, ftest, index, kernel
from textloom.operators.svd import TruncatedSVD
from textloom.operators.topics import LabelTopics
from textloom.session import ship, stage


def corpus(seed=1, docs=40, words=60):
    rng = random.Random(seed)
    tf = {(d, f"w{min(int(rng.expovariate(0.1)), words)}"): rng.randint(1, 4) for d in range(docs) for _ in range(12)}
    return [(d, w, n) for (d, w), n in tf.items()]


def test_kernel_bayes_scores(spark):
    ship(spark)
    rng = np.random.default_rng(3)
    rows = corpus()
    vectors = {f"w{i}": rng.normal(size=6) * (40 if i == 3 else 1) for i in range(0, 60, 2)}
    vectors |= {f"w{i}": rng.normal(size=6) * 40 for i in (3, 5)}
    label = {d: None if d == 7 else "abc"[d % 3] for d in range(30)}
    tf = spark.createDataFrame(rows, "doc_id long, term string, tf long")
    docs = spark.createDataFrame(list(label.items()), "doc_id long, label string")
    wv = spark.createDataFrame([(w, v.tolist()) for w, v in vectors.items()], "word string, vec array<double>")
    model = kernel.KernelBayes(tf, docs, wv, "label", alpha=0.5, sigma=0.7)
    got = {r.doc_id: r for r in model.predict(tf).collect()}

    counts = {}
    for d, w, n in rows:
        if label.get(d):
            counts.setdefault(label[d], {}).setdefault(w, []).append(n)
    counts = {c: {w: sum(n) for w, n in t.items()} for c, t in counts.items()}
    size = len({w for t in counts.values() for w in t})
    prior = {c: sum(v == c for v in label.values()) / 29 for c in "abc"}

    def log_kernel(c, w):
        e = [math.log(n) - ((vectors[w] - vectors[v]) ** 2).sum() / (2 * 0.7**2)
             for v, n in counts[c].items() if v in vectors]
        return max(e) + math.log(sum(math.exp(x - max(e)) for x in e))

    for d in {d for d, _, _ in rows}:
        want = []
        for c in "abc":
            s = math.log(prior[c])
            for k, w, n in rows:
                if k == d:
                    s += n * math.log((counts[c].get(w, 0) + 0.5) / (sum(counts[c].values()) + 0.5 * size))
                    s += n * log_kernel(c, w) if w in vectors else 0
            want.append(s)
        assert [got[d].s0, got[d].s1, got[d].s2] == pytest.approx(want, rel=1e-9)
        assert got[d].pred == "abc"[int(np.argmax(np.round(want, 6)))]


def test_kernel_states_merge_alike_in_any_blocks(spark):
    ship(spark)
    rng = np.random.default_rng(4)
    words = spark.createDataFrame([(f"a{i}", rng.normal(size=3).tolist()) for i in range(30)], "word string, vec array<double>")
    base = spark.createDataFrame([(f"b{i}", i % 2, i + 1, (rng.normal(size=3) * 30).tolist()) for i in range(40)],
                                 "word string, y int, n long, vec array<double>")
    one, many = ({(r.word, r.y): r.log for r in kernel.kernel_logs(words, base, "y", 0.1, rows).collect()}
                 for rows in (1000, 7))
    assert len(one) == 60 and many == pytest.approx(one) and min(one.values()) < -800


def test_kernel_measures_a_word_of_many_classes_once(spark, monkeypatch):
    import types

    import pandas as pd

    work, sizes = [], []
    monkeypatch.setattr(kernel, "pair_blocks", lambda words, base, run, *rest: work.append(run) or spark.createDataFrame(
        [], "word string, y string, top double, mass double"))
    words = spark.createDataFrame([("a", [0.0, 1.0])], "word string, vec array<double>")
    kernel.kernel_logs(words, words.selectExpr("word", "'x' AS y", "1 AS n", "vec"), "y")
    exp = lambda x: sizes.append(np.size(x)) or np.exp(x)
    monkeypatch.setattr(kernel, "np", types.SimpleNamespace(**{**vars(np), "exp": exp}))
    rng = np.random.default_rng(1)
    v = {f"w{i}": rng.normal(size=2) for i in range(10)} | {"far": np.array([900.0, 0])}
    base = [(w, c, i + 1) for i, w in enumerate(v) for c in "xyz" if (w == "far") == (c == "z")]
    right = pd.DataFrame([(w, c, n, v[w]) for w, c, n in base], columns=["word", "y", "n", "vec"])
    left = pd.DataFrame({"word": list(v)[:5], "vec": list(v.values())[:5]})
    got = {(r.word, r.y): r.top + math.log(r.mass) for r in work[0](left, right).itertuples()}
    assert sum(sizes) == 5 * 11 + 5  # each vector once; the far class on a scale of its own
    for (w, c), log in got.items():
        e = [math.log(n) - ((v[w] - v[u]) ** 2).sum() / 2 for u, k, n in base if k == c]
        assert log == pytest.approx(max(e) + math.log(sum(math.exp(x - max(e)) for x in e)))


def test_f_values_and_their_tails(spark):
    ship(spark)
    rows = corpus(5)
    label = {d: d % 3 for d in range(40)}
    rows += [(d, "apart", 2) for d in range(40) if label[d] == 1] + [(d, "same", 1) for d in range(40)]
    cells = spark.createDataFrame(rows, "doc_id long, term string, weight long")
    docs = spark.createDataFrame(list(label.items()), "doc_id long, y int")
    found, freedom = ftest.f_values(cells, docs, "y")
    assert freedom == (2, 37)
    got = {r.term: (r.f_value, r.p_value) for r in ftest.with_p_values(found, freedom).collect()}
    x = {}
    for d, w, n in rows:
        x.setdefault(w, np.zeros(40))[d] += n
    y = np.arange(40) % 3
    law = spark._jvm.org.apache.commons.math3.distribution.FDistribution(2.0, 37.0)
    for w, v in x.items():
        between = sum((y == c).sum() * (v[y == c].mean() - v.mean()) ** 2 for c in range(3))
        within = sum(((v[y == c] - v[y == c].mean()) ** 2).sum() for c in range(3))
        if w == "apart":
            assert got[w] == (math.inf, 0.0)
        elif w == "same":
            assert got[w] == (None, None)
        else:
            f = between / 2 / (within / 37)
            assert got[w][0] == pytest.approx(f)
            assert got[w][1] == pytest.approx(1 - law.cumulativeProbability(float(f)), abs=1e-11)
    kept = {r.term for r in ftest.select_terms(cells, docs, "y", 0.2).collect()}
    assert kept == {w for w, (_, p) in got.items() if p is not None and p < 0.2} and "apart" in kept


@pytest.mark.parametrize("freedom", [(1, 5), (3, 400), (1, 100_000), (20, 20)])
def test_beta_tail(spark, freedom):
    d1, d2 = freedom
    law = spark._jvm.org.apache.commons.math3.distribution.FDistribution(float(d1), float(d2))
    f = np.array([1e-3, 0.1, 0.5, 1.0, 2.0, 4.0, 30.0])
    got = ftest.beta_tail(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)
    assert got == pytest.approx([1 - law.cumulativeProbability(float(v)) for v in f], abs=1e-9)


def test_svd_is_close_to_the_exact_one(spark):
    ship(spark)
    rng = np.random.default_rng(6)
    a = rng.normal(size=(80, 30)) @ np.diag(0.8 ** np.arange(30)) @ rng.normal(size=(30, 120))
    a += 0.01 * rng.normal(size=a.shape)
    a[rng.random(a.shape) < 0.3] = 0
    a[:, 0] += 5  # a term that every row holds
    cells = spark.createDataFrame([(int(i), f"t{j}", float(a[i, j])) for i, j in zip(*np.nonzero(a))],
                                  "doc_id long, term string, weight double")
    model = TruncatedSVD(cells, 12)
    exact = np.linalg.svd(a, compute_uv=False)
    assert model.singular_values == pytest.approx(exact[:12], rel=0.01)
    axes = {r.term: r.vec for r in model.axes.collect()}
    v = np.array([axes[f"t{j}"] for j in range(120)])
    assert v.T @ v == pytest.approx(np.eye(12), abs=1e-6)
    u = {r.doc_id: r.components for r in model.transform(cells).collect()}
    near = np.array([u[i] for i in range(80)]) @ v.T
    assert np.linalg.norm(a - near) < 1.01 * np.linalg.norm(exact[12:])
    new = spark.createDataFrame([(1, "t3", 2.0), (1, "unknown", 9.0)], "doc_id long, term string, weight double")
    assert model.transform(new).first().components == pytest.approx((2.0 * v[3]).tolist())


def test_svd_of_low_rank(spark):
    ship(spark)
    cells = spark.createDataFrame([(d, f"t{j}", float((d + 1) * (j + 1))) for d in range(6) for j in range(5)],
                                  "doc_id long, term string, weight double")
    model = TruncatedSVD(cells, 4)
    assert len(model.singular_values) == 1
    assert model.singular_values[0] == pytest.approx(math.sqrt(91 * 55))


def test_svd_in_slices_holds_no_whole_matrix_over_the_terms(spark, monkeypatch):
    from textloom.operators import svd, terms

    rng = random.Random(2)
    rows = [(None if d == 5 else d, [f"w{int(rng.expovariate(0.2))}" for _ in range(12)]) for d in range(40)]
    blocks = terms.TermBlocks(spark.createDataFrame(rows, "doc_id long, words array<string>"), F.col("words"))
    idf = stage(blocks.vocabulary().withColumn("idf", 1 + 1 / F.col("df")))
    whole = TruncatedSVD(blocks.weigh(idf), 2, extra=4, power=1)
    cells = blocks.weighed(idf)
    monkeypatch.setattr(svd, "SLICE_NUMBERS", 3 * cells.named(svd.GROUP_FACTS).count())
    monkeypatch.setattr(svd, "SLICE_SHARE", 0)
    widths = []

    def watched(df):
        df = stage(df)
        if "_v" in df.columns:
            widths.append(df.agg(F.max(F.size("_v"))).first()[0])
        return df

    monkeypatch.setattr(svd, "stage", lambda df: watched(df))
    model = TruncatedSVD(cells, 2, extra=4, power=1)
    assert model._columns == 3 and len(widths) == 6 and max(widths) == 3
    assert model.singular_values == pytest.approx(whole.singular_values)
    one, two = ({r.doc_id: np.abs(r.components).tolist() for r in rows.collect()} for rows in (
        model.transform(cells), whole.transform(blocks.weigh(idf))))
    assert len(one) == 40 and all(v == pytest.approx(two[k], abs=1e-9) for k, v in one.items())


def tables(spark, q, b, banned):
    name = lambda i: f"v{i:04d}"
    base = spark.createDataFrame([(name(i), x.tolist()) for i, x in enumerate(b)], "base_id string, vec array<double>")
    queries = spark.createDataFrame([(i, x.tolist(), [name(j) for j in banned[i]]) for i, x in enumerate(q)],
                                    "query_id long, vec array<double>, banned array<string>")
    return queries, base


def plain_nearest(q, b, banned, k, metric):
    if metric == "cosine":
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        s = np.round(unit(q) @ unit(b).T, 6)
    else:
        s = -np.round(np.sqrt(((q[:, None] - b[None]) ** 2).sum(2)), 6)
    out = {}
    for i in range(len(q)):
        order = sorted((j for j in range(len(b)) if j not in banned[i]), key=lambda j: (-s[i, j], j))[:k]
        out[i] = [(f"v{j:04d}", round(float(s[i, j]), 5)) for j in order]
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("kind", ["clusters", "noise", "ties", "few", "zeros"])
def test_index_is_exact(spark, metric, kind):
    ship(spark)
    rng = np.random.default_rng(8)
    b = rng.normal(size=(12, 8))[rng.integers(12, size=500)] * 3 + rng.normal(size=(500, 8)) * 0.1
    if kind == "noise":
        b = rng.normal(size=(500, 8))
    if kind == "ties":
        b = np.round(rng.normal(size=(300, 3)))
    if kind == "few":
        b = b[:3]
    if kind == "zeros":
        b[::3] = 0.0
    q = np.concatenate([b[:20], rng.normal(size=(10, b.shape[1])), np.zeros((1, b.shape[1]))])
    banned = [[i] if i < min(20, len(b)) else [] for i in range(len(q))]
    queries, base = tables(spark, q, b, banned)
    found = index.VectorIndex(base, metric, part_rows=50).nearest(queries, 4)
    got = {i: [] for i in range(len(q))}
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.base_id, round(r.score, 5)))
    assert got == plain_nearest(q, b, banned, 4, metric)


def test_index_measures_a_small_share(spark):
    ship(spark)
    rng = np.random.default_rng(9)
    b = rng.normal(size=(64, 16))[rng.integers(64, size=5000)] + rng.normal(size=(5000, 16)) * 0.05
    queries, base = tables(spark, b[:50], b, [[] for _ in range(50)])
    assert index.VectorIndex(base).pairs_measured(queries, 5) < 0.1 * 50 * 5000
    empty = base.limit(0)
    assert index.nearest(queries, empty, 5).count() == 0 and index.nearest(queries.limit(0), base, 5).count() == 0


def test_words_and_analogies(spark):
    ship(spark)
    wv = spark.createDataFrame([("king", [1.0, 1.0]), ("man", [1.0, 0.0]), ("woman", [0.0, 1.0]), ("queen", [0.1, 2.0])],
                               "word string, vec array<double>")
    near = embed.nearest_words(wv, spark.createDataFrame([("king",), ("unknown",)], "word string"), 1).collect()
    assert [(r.query_id, r.word) for r in near] == [("king", "man")] or near[0].word == "queen"
    t = spark.createDataFrame([(1, "king", "man", "woman"), (2, "king", "x", "man")], "id long, a string, b string, c string")
    assert [(r.id, r.word, r["rank"]) for r in embed.word_analogies(wv, t, "id", 1).collect()] == [(1, "queen", 1)]


def plain_topics(tf, labels, rounds):
    """Nested loops over documents, terms and labels."""
    own = {d: sorted({c for k, c in labels if k == d and c}) for d, _, _ in tf}
    w = {(d, t, c): n / len(own[d]) for d, t, n in tf for c in own[d]}
    trace = []

    def model():
        words, shares, labels_n, docs_n = {}, {}, {}, {}
        for (d, t, c), x in w.items():
            words[c, t] = words.get((c, t), 0) + x
            shares[d, c] = shares.get((d, c), 0) + x
            labels_n[c] = labels_n.get(c, 0) + x
            docs_n[d] = docs_n.get(d, 0) + x
        return ({k: x / labels_n[k[0]] for k, x in words.items()},
                {k: x / docs_n[k[0]] for k, x in shares.items()})

    for _ in range(rounds):
        words, shares = model()
        logs = count = 0
        for d, t, n in tf:
            parts = {c: words[c, t] * shares[d, c] for c in own[d]}
            if parts:
                whole = sum(parts.values())
                logs, count = logs + n * math.log(whole), count + n
                w.update({(d, t, c): n * x / whole for c, x in parts.items()})
        trace.append(math.exp(-logs / count))
    return *model(), trace


def test_label_topics_match_plain_rounds(spark):
    rows = corpus(seed=4)
    rng = random.Random(5)
    labels = [(d, c) for d in range(36) for c in rng.sample("abcd", rng.randint(1, 3))]
    # Repeated and null labels, a document without labels and one without words.
    labels += [(0, labels[0][1]), (1, None), (38, None), (99, "a")]
    words, shares, trace = plain_topics(rows, labels, 6)
    tf = spark.createDataFrame(rows, "doc_id long, term string, tf long")
    got = LabelTopics(tf, spark.createDataFrame(labels, "doc_id long, label string"), rounds=6)
    assert got.perplexity == pytest.approx(trace, rel=1e-9)
    assert all(b <= a for a, b in zip(trace, trace[1:])) and trace[-1] < trace[0]
    assert {(r.label, r.term): r.p for r in got.words.collect()} == pytest.approx(words, abs=1e-9)
    assert {(r.doc_id, r.label): r.share for r in got.shares.collect()} == pytest.approx(shares, abs=1e-9)
    best = [r for r in got.top_words(3).collect() if r.label == "a"]
    assert [r["rank"] for r in sorted(best, key=lambda r: -r.p)] == [1, 2, 3]


def test_label_topics_of_empty_tables_and_separable_labels(spark):
    docs = [(d, t, 1) for d in range(30) for t in ("all", "ab"[d % 2])]
    labels = [(d, c) for d in range(30) for c in ("common", "ab"[d % 2])]
    tf = spark.createDataFrame(docs, "doc_id long, term string, tf long")
    pairs = spark.createDataFrame(labels, "doc_id long, label string")
    got = LabelTopics(tf, pairs, rounds=4)
    # Shares are free along a ridge of equal maxima; supports and the perplexity of the maximum are not.
    assert not got.words.filter("label = 'a' AND term = 'b' OR label = 'b' AND term = 'a'").count()
    p = {(r.label, r.term): r.p for r in got.words.collect()}
    assert p["common", "all"] > 0.75 and p["a", "a"] == pytest.approx(p["b", "b"])
    assert got.perplexity[-1] == pytest.approx(2, abs=0.2)
    none = LabelTopics(tf.limit(0), pairs, rounds=2)
    assert none.words.count() == none.shares.count() == 0 and none.perplexity == [None, None]


def test_label_topics_in_many_blocks_hold_one_row_per_fact(spark, monkeypatch):
    from textloom.operators import topics

    rng = np.random.default_rng(4)
    tf = spark.createDataFrame([(d, f"w{j}", int(rng.integers(1, 4))) for d in range(40)
                                for j in rng.choice(25, 8, replace=False)], "doc_id long, term string, tf long")
    pairs = spark.createDataFrame([(d, f"l{j}") for d in range(40) for j in {d % 3, d % 5}],
                                  "doc_id long, label string")
    one = LabelTopics(tf, pairs, rounds=3)
    monkeypatch.setattr(topics, "BLOCK_FACTS", 30)
    many = LabelTopics(tf, pairs, rounds=3)
    assert many._facts.count() == tf.count()  # not one row per fact and label
    assert many.perplexity == pytest.approx(one.perplexity)
    key = lambda m: {(r.doc_id, r.label): r.share for r in m.shares.collect()}
    assert key(many) == pytest.approx(key(one))


def test_label_topics_of_packed_blocks_leave_no_earlier_round(spark, monkeypatch):
    from textloom.operators import terms, topics

    rng = random.Random(8)
    rows = [(d, [f"w{rng.randrange(25)}" for _ in range(rng.randint(0, 30))]) for d in range(50)] + [(None, ["w1"])]
    docs = spark.createDataFrame(rows, "doc_id long, words array<string>")
    labels = [(d, c) for d in range(3, 60) for c in rng.sample("abcd", rng.randint(1, 3))] + [(None, "a"), (4, None)]
    pairs = spark.createDataFrame(labels, "doc_id long, label string")
    tf = docs.select("doc_id", F.explode("words").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    want = LabelTopics(tf, pairs, rounds=2)
    monkeypatch.setattr(topics, "BLOCK_FACTS", 60)
    monkeypatch.setattr(topics, "DENSE_CODES", 10)
    written = []
    monkeypatch.setattr(topics, "stage", lambda df: written.append(stage(df)) or written[-1])
    got = LabelTopics(terms.TermBlocks(docs, F.col("words")), pairs, rounds=2)
    assert got.perplexity == pytest.approx(want.perplexity)
    of = lambda m: {tuple(r)[:2]: r[2] for t in (m.words, m.shares) for r in t.collect()}
    assert of(got) == pytest.approx(of(want))
    kept = [t for t in written if os.path.exists(t.inputFiles()[0].removeprefix("file://"))]
    assert len(written) == 1 + 3 + 3 + 2 and len(kept) == 3  # the labels, words and shares
