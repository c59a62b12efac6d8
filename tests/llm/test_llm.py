"""The training-data operators against brute force, round trips and planted cases."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tests.llm import brute
from textloom.llm import common as C
from textloom.llm import (
    chat,
    decontam,
    jaccard,
    katz,
    neighbours,
    packing,
    quality,
    substring,
    tokencount,
    toxicity,
)
from textloom.session import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=60):
    return " ".join(f"w{min(int(rng.expovariate(0.08)), vocabulary)}" for _ in range(n))


def texts(seed=3):
    """Short texts with copies, near copies, shared passages, repeats and odd cases."""
    rng = random.Random(seed)
    out = [prose(rng, rng.randint(1, 80)) for _ in range(40)]
    passage = prose(rng, 55)
    out += [out[3]] * 3 + [f"{out[k]}\n{passage} {out[k + 1]}" for k in range(5, 10)]
    base = prose(rng, 120, 400).split()
    for k in range(12):
        near = list(base)
        for _ in range(k % 4):
            near[rng.randrange(len(near))] = f"x{rng.random()}"
        out.append(" ".join(near))
    return out + [None, "", "  \n", "One", "a b c", "A B C", "be " * 400, "É é x"]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    ship(spark)
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_packing_is_exact(docs):
    rows = packing.pack(docs, with_ids=True).collect()
    enc = packing.Encoder()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, t in pairs(docs):
        want = enc.whole.encode(t or "", add_special_tokens=False).ids + [packing.END]
        got = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in got) == np.array(want, "<u4").tobytes()
        assert [r.start for r in got] == list(np.cumsum([0] + [r.length for r in got])[:-1])
        assert {r.doc_tokens for r in got} == {len(want)}
    for part in by_sequence.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY


def test_packing_fills_and_balances():
    rng = random.Random(1)
    lengths = [rng.randint(1, 2048) for _ in range(300)]
    parts = packing.place(lengths)
    n = -(-sum(lengths) // packing.CAPACITY)
    assert len({p[3] for p in parts}) <= n
    assert sum(b - a for _, a, b, _, _ in parts) == sum(lengths)


def test_packing_pads_alike_at_any_partition_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before, fills = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (4, 200):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            fills.append(packing.pack(docs).agg(
                F.sum("length") / (F.count_distinct("sequence_id") * packing.CAPACITY)).first()[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert fills[0] == fills[1] > 0.95


def test_packing_cuts_a_long_text_over_many_sequences(spark):
    ship(spark)
    text = prose(random.Random(4), 9000)
    docs = spark.createDataFrame([(1, text), (2, "short one"), (3, "")], "doc_id long, text string")
    rows = packing.pack(docs, with_ids=True).collect()
    whole = sorted((r.start, r.ids) for r in rows if r.doc_id == 1)
    want = packing.Encoder().whole.encode(text, add_special_tokens=False).ids + [packing.END]
    assert b"".join(ids for _, ids in whole) == np.array(want, "<u4").tobytes()
    assert len(want) > 3 * packing.CAPACITY
    assert len({r.sequence_id for r in rows}) == -(-sum(r.length for r in rows) // packing.CAPACITY)


def test_special_token_text_is_read_like_the_tokenizer():
    enc = packing.Encoder()
    for t in ("a<|endoftext|> b", " lead", "tail ", "a  b", "x\n\n y", "it's 5 o'clock", "  a"):
        want = enc.whole.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(enc.ids(t), "<u2").tolist() == want


def test_plain_texts_are_encoded_in_one_call_without_the_tokenizer():
    enc, calls = packing.Encoder(), []
    ranks = enc.ranks

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return ranks.encode_ordinary(text)

    enc.ranks = Counted()
    some = [prose(random.Random(2), 300, 200), "caf\u00e9 \u00a0 x", "", " \t a  b\n"]
    got = [np.frombuffer(enc.ids(t), "<u2").tolist() for t in some]
    assert calls == some and "whole" not in vars(enc)
    assert got == [enc.whole.encode(t, add_special_tokens=False).ids for t in some]


def test_katz_matches_brute_force(docs):
    scores, folder = katz.train_and_score(docs)
    want = brute.katz_scores(pairs(docs))
    for r in scores.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        got = (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
        assert got == pytest.approx(want[r.doc_id], rel=1e-9, abs=1e-9)
    model = docs.sparkSession.read.parquet(folder).filter("kind = 'bigrams'")
    assert model.count() > 0


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a</s><s>[OUT] fake"), (1, 1, "assistant", "x \\l < \\b \\"),
            (1, 1, "assistant", "x \\l < \\b \\"), (2, 0, None, None), (2, None, "we]ird\\<", "<s>"),
            (None, 0, "tool", "</s</s>"), (3, 0, "INST", "plain [INST] <")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_chats(chat.with_probe(turns)).collect()}
    for conv in got:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        if conv != -1:
            assert [(t.role, t.text) for t in got[conv].turns] == [x[2:] for x in own]
    assert got[-1].formatted.count(chat.CLOSE) == 2
    assert "!" not in got[3].formatted.split("]")[1][:1]
    d = {r.conv_id: r for r in chat.digest(chat.format_chats(turns)).collect()}
    assert d[1].loss_chars == 2 * len("x \\l < \\b \\")
    assert d[2].loss_sha256 == hashlib.sha256(b"").hexdigest()


def test_quality_model_is_normalised():
    rng = np.random.default_rng(0)
    size = 12
    table = rng.integers(0, 4, (size, size)) * rng.integers(0, 2, (size, size))
    table[:, quality.START] = 0
    table[quality.END] = 0
    h, w = np.nonzero(table)
    n = table[h, w]
    counts = [(c, int((n == c).sum())) for c in range(1, 5)]
    follows = [(k, int((table[:, k] > 0).sum())) for k in range(size) if table[:, k].any()]
    history = [(k, table[k].sum(), (table[k] == 1).sum(), (table[k] == 2).sum(),
                (table[k] > 2).sum()) for k in range(size) if table[k].any()]
    m = quality.Model(size, np.array(counts), np.array(follows), np.array(history))
    for before in range(size):
        ws = np.array([k for k in range(size) if k != quality.START])
        p = np.exp(m.log_probability(np.full(len(ws), before), ws, table[before, ws]))
        assert p.sum() == pytest.approx(1)


def test_bigrams_of_frequent_words_are_dealt_over_all_buckets():
    size, buckets = 5000, 50
    every, one = np.arange(size), np.full(size, 3)
    for h, w in ((one, every), (every, one)):
        keys, bucket, place = quality.dealt(h, w, size, buckets)
        assert (keys[place] == h * size + w).all() and (np.diff(bucket) >= 0).all()
        assert np.bincount(bucket).max() == size // buckets


def test_quality_keeps_prose_and_rejects_symbols(spark):
    ship(spark)
    rng = random.Random(5)
    rows = [(i, prose(rng, 60), "en", "s", 1) for i in range(200)]
    rows += [(1000 + i, " ".join("#%" * 8 + str(rng.random()) for _ in range(60)), "en", "s", 1)
             for i in range(10)] + [(2000, None, None, None, None), (None, "w1 w2", "xx", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert not kept & set(range(1000, 1010)) and {2000, None} <= kept
    assert len(kept & set(range(200))) >= 195
    assert quality.keep_good(docs, labels.limit(0)).count() == len(rows)


def test_quality_cuts_by_language(spark):
    """Cuts of seen languages are their own; null and unseen languages share the overall one."""
    ship(spark)
    rng = random.Random(6)
    lang = {0: "en", 1: "fr", 2: None, 3: "xx"}
    rows = [(i, prose(rng, 40), lang[i % 4], "s", 1) for i in range(240)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(240) if i % 4 != 3],
                                   "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    found = quality.classify(docs, labels).toPandas()
    assert sorted(found.doc_id) == list(range(240))
    fair = {r.doc_id for r in quality.trusted(docs, labels, 1).collect()}
    marked = found[found.doc_id.isin(fair)]
    means = -marked.groupby("lang").log_prob.sum() / marked.groupby("lang").n_tokens.sum()
    overall = -marked.log_prob.sum() / marked.n_tokens.sum()
    centre = found.lang.map(means).fillna(overall)
    surprise = (quality.PRIOR * centre - found.log_prob) / (found.n_tokens + quality.PRIOR)
    assert np.allclose(surprise, found.surprise)
    for name in ("en", "fr"):
        of = marked[marked.lang == name].surprise
        assert (found[found.lang == name].cut == of.max()).all()
    other = found[~found.lang.isin(["en", "fr"])]
    assert (other.cut == marked.surprise.max()).all()


def test_quality_cut_of_a_language_with_few_good_rows(spark):
    """Three fair rows of a language do not reject a quarter of its clean documents."""
    ship(spark)
    rng = random.Random(9)
    rows = [(i, prose(rng, 60), "en", "s", 1) for i in range(400)]
    rows += [(1000 + i, prose(rng, 60).replace("w", "v"), "es", "s", 1) for i in range(300)]
    rows += [(2000 + i, " ".join(f"#{rng.random()}" for _ in range(60)), "es", "s", 1) for i in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    every = spark.createDataFrame([(i, 1, 0) for i in [*range(400), *range(1000, 1300)]],
                                  "doc_id long, quality int, toxic int")
    parts = [[r.doc_id for r in quality.trusted(docs, every.filter("doc_id >= 1000"), k).orderBy(
        "doc_id").limit(3).collect()] for k in (0, 1)]
    labels = every.filter(F.col("doc_id").isin(parts[0] + parts[1]) | (F.col("doc_id") < 400))
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert len(kept & set(range(1000, 1300))) >= 294
    assert not kept & set(range(2000, 2005))


def test_all_good_rows_that_were_not_fitted_on_are_fair(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_ROWS", 10)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    fitted = {r.doc_id for r in quality.fitted(labels, labels).collect()}
    rest = [r.doc_id for r in quality.unfitted(labels, labels).collect()]
    assert len(fitted) == 10 and sorted(rest) == sorted(set(range(200)) - fitted)


def test_quality_is_fitted_on_every_row_of_its_half(spark):
    labels = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    fitted, rest = (f(labels, labels) for f in (quality.fitted, quality.unfitted))
    assert fitted.count() > 25_000 and fitted.union(rest).distinct().count() == 60_000


def test_forward_backward_by_enumeration(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 4)
    rng = np.random.default_rng(1)
    tr, sizes, e = rng.normal(size=(3, 2)), [1, 4, 7, 3], rng.normal(size=15) * 2
    starts = np.cumsum(sizes) - sizes
    p, f, g, m = toxicity.forward_backward(e, starts, tr)
    want, expected = [], np.zeros((3, 2))
    for s, n in zip(starts, sizes):
        z, marginal, x = 0, np.zeros(n), np.zeros((3, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(tr[2][y[0]] + sum(e[s + i] * y[i] for i in range(n))
                       + sum(tr[y[i - 1]][y[i]] for i in range(1, n)))
            z += w
            marginal += w * np.array(y)
            x[2, y[0]] += w
            for i in range(1, n):
                x[y[i - 1], y[i]] += w
        want += list(marginal / z)
        expected += x / z
    assert p == pytest.approx(want)
    assert toxicity.pair_expectations(f, g, m, starts) == pytest.approx(expected.ravel())


def test_toxicity_finds_held_out_words(spark):
    ship(spark)
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(300):
        ws, bad = prose(rng, 40).split(), i % 5 == 0
        if bad:
            ws[rng.randrange(40)] = rng.choice(["scoundrel", "vermin,"])
        rows.append((i, " ".join(ws), "en", "s", 1))
        marks.append((i, 1, int(bad)))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(out[i].predicted == bad for i, _, bad in marks)
    assert out[900].predicted == 0 and 0 <= out[901].score <= 1
    text = {r[0]: r[1] for r in rows}
    hit = out[0].spans[0]
    assert text[0][hit.start:hit.end].strip(",") in ("scoundrel", "vermin")


def test_neighbours_against_brute_force(spark):
    ship(spark)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[50:60] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (None, x[0].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = neighbours.nearest_neighbours(vectors, F.col("vec_id") % 20 == 0).collect()
    found = 0
    for q in range(0, 400, 20):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        got = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 11))
        assert all(r.score == pytest.approx(d[r.vec_id], abs=1e-9) for r in got)
        found += len({r.vec_id for r in got} & set(want))
    assert found >= 0.95 * 200


def answers_of(vectors, queries):
    """vec_ids by rank of every asked id."""
    out = neighbours.nearest_neighbours(vectors, F.col("vec_id").isin(queries)).collect()
    return {q: [r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)]
            for q in queries}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_among_near_copies_and_at_any_scale(spark, kind):
    """More near copies than the beam holds, and components that half floats turn to inf or 0."""
    ship(spark)
    rng = np.random.default_rng(4)
    copies = 0.2 + 1e-6 * rng.normal(size=(700, 8))
    huge, tiny = 1e6 * rng.normal(size=(40, 8)), 1e-9 * rng.normal(size=(40, 8))
    x = np.concatenate([copies, huge, tiny])
    if kind == "double":
        x = np.concatenate([x, 1e300 * rng.normal(size=(40, 8)), 1e-200 * rng.normal(size=(40, 8))])
    else:
        x = x.astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    queries = [*range(0, 700, 50), 705, 730, 745, 770, *([785, 805, 825, 850] if kind == "double" else [])]
    got, hits = answers_of(vectors, queries), []
    for q in queries:
        diff = x - x[q]
        top = np.abs(diff).max(1)
        d = np.sqrt(((diff / np.where(top > 0, top, 1)[:, None]) ** 2).sum(1)) * top
        want = [int(i) for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        assert len(got[q]) == 10
        hits.append(len(set(want) & set(got[q])))
    assert min(hits) >= 8 and sum(hits) >= 9.5 * len(hits)


def test_trees_follow_the_row_count(spark, monkeypatch):
    """Leaves far above the sample are cut by their own vectors, not dealt at random."""
    ship(spark)
    monkeypatch.setattr(neighbours, "SAMPLE", 256)
    monkeypatch.setattr(neighbours, "LEAF", 16)
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(1000, 8)), 8, 0) + 0.001 * rng.normal(size=(8000, 8))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, v array<double>")
    edges, _ = neighbours.start(nodes, np.float64, 4)
    pairs = edges.select("src", "dst").distinct().filter("src div 8 = dst div 8").count()
    assert pairs >= 0.8 * 8000 * 7


def test_reverse_neighbours_change_with_the_round(spark):
    """A hub's other reverse links come up in other rounds, new and older ones alike."""
    edges = spark.createDataFrame([(i, 0, float(i), i % 2 == 0) for i in range(1, 2001)],
                                  neighbours.LISTED)
    rounds = [{r.member for r in neighbours.drawn(edges, k).collect()} for k in range(6)]
    assert all(20 <= len(r) <= 90 for r in rounds)
    assert len(set.union(*rounds)) >= 4 * len(rounds[0])


def test_substring_matches_brute_force(docs):
    want = brute.repeats(pairs(docs))
    for r in substring.substring_dedup(docs, "lang").collect():
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed) == (n, gone)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
        assert brute.words(r.text) == kept.split()


def test_heavy_minimisers_and_long_texts_change_nothing(spark, monkeypatch):
    """Windows dealt by all their words, a common pair in every text, one very long text."""
    ship(spark)
    rng = random.Random(12)
    texts = [" ".join(f"a b {rng.choice('uvwxyz')}" for _ in range(rng.randrange(3, 30))) for _ in range(60)]
    texts += [" ".join(rng.choice("pq") for _ in range(60_000)), texts[0], texts[7] + " tail", None, ""]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.repeats(rows)
    every = substring.read([(t or "").encode() for t in texts])
    hashes = np.array([substring.C.word_hash(w) for w in every[0]], np.uint64)[every[1]]
    for heavy in ([], np.unique(substring.windows(hashes))):
        monkeypatch.setattr(substring, "heavy_places", lambda docs, buckets: np.array(heavy, np.uint64))
        for r in substring.substring_dedup(docs).collect():
            n, gone, kept = want[r.doc_id]
            assert (r.n_words, r.n_removed) == (n, gone)
            assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_heavy_minimisers_are_found(spark):
    ship(spark)
    rng = random.Random(13)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for i in range(400)]
    rows += [(1000 + i, " ".join(f"{'a b c' if k % 3 else rng.randrange(9**9)}" for k in range(60)))
             for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring.heavy_places(docs, 64)
    assert 0 < len(found) <= 16 and (np.diff(found.astype(object)) > 0).all()


def test_strings_with_equal_sums_stay_apart(monkeypatch):
    ids = np.array([*range(20), *range(20), *range(1, 21)], np.int32)
    starts, lengths = np.array([0, 20, 40, 5]), np.array([20, 20, 20, 13])
    assert substring.numbered(ids, starts, lengths).tolist() == [0, 0, 1, 2]
    monkeypatch.setattr(substring.C, "mix", lambda a: np.zeros_like(a))
    assert substring.numbered(ids, starts, lengths).tolist() == [0, 0, 1, 2]


def test_windows_with_equal_hashes_stay_apart(monkeypatch):
    monkeypatch.setattr(substring.C, "rolling", lambda h, n: np.zeros(max(len(h) - n + 1, 0), np.uint64))
    ids = np.arange(40, dtype=np.int32) % 20
    order, groups = substring.sorted_windows(ids, np.arange(40 - 12))
    assert len(groups) == 20


def test_token_counts_match_plain_segmentation(docs):
    model = tokencount.Model(tokencount.vocabulary())
    words = ["", "a", "日本", "x" * 300, "aéß😀", "internationalisation", "aaaa"]
    assert model.counts(words).tolist() == [model.count(w) for w in words]
    for r in tokencount.token_counts(docs).collect():
        ws = [w.decode() for w in brute.words(dict(pairs(docs))[r.doc_id])]
        assert (r.n_pretokens, r.n_tokens) == (len(ws), sum(map(model.count, ws)))


def test_jaccard_matches_brute_force(docs):
    want = brute.components(pairs(docs))
    rows = jaccard.jaccard_components(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    kept = {r.doc_id for r in jaccard.keep_one(docs).collect()}
    assert kept == {c for _, c in want.values()}


def test_decontamination_matches_plain_search(spark, docs):
    rng = random.Random(9)
    source = dict(pairs(docs))
    items = [(1, " ".join(source[5].split()[3:20])), (2, "A, b-c"), (3, None), (4, prose(rng, 30)),
             (5, "be be"), (6, source[3])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    phrases = {}
    for i, t in items:
        ws = decontam.words((t or "").encode())
        n = min(len(ws), 10)
        for k in range(len(ws) - n + 1 if n else 0):
            phrases.setdefault(tuple(ws[k:k + n]), set()).add(str(i))
    for r in decontam.scan(docs, bench, "lang").collect():
        ws = decontam.words((source[r.doc_id] or "").encode())
        hit, found = set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(ws) - n + 1):
                if tuple(ws[k:k + n]) in phrases:
                    hit.update(range(k, k + n))
                    found |= phrases[tuple(ws[k:k + n])]
        assert r.n_words == len(ws) and set(r["items"]) == found
        assert {k for s in r.spans for k in range(s.start, s.end)} == hit
        if hit:
            left = [w for k, w in enumerate(ws) if k not in hit]
            assert decontam.words(r.cleaned.encode()) == left


def test_decontamination_in_passes_is_the_same(spark, monkeypatch):
    ship(spark)
    rng = random.Random(12)
    long_text, texts = prose(rng, 700), [prose(rng, 60) for _ in range(12)]
    docs = spark.createDataFrame(
        [(k % 9, f"{t} {long_text[k * 50:k * 50 + 400]} {texts[-1]}", k) for k, t in enumerate(texts)]
        + [(None, None, 1), (3, "", 2)], "doc_id long, text string, text2 int")
    docs = docs.withColumns({"row": F.lit(1), "_text": F.lit("x"), "a b": F.col("text2")})
    items = [(1, long_text), (2, long_text), (3, texts[-1]), (3, texts[-1]), (4, "be"), (5, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    carried = ("row", "_text", "a b", "text2")

    def found(**options):
        out = decontam.scan(docs, bench, *carried, **options)
        return sorted(map(repr, out.collect()))

    want = found()
    monkeypatch.setattr(decontam, "PIECE_WORDS", 40)
    assert found() == want
    assert decontam.benchmark_passes(bench, 3000)[1] > 2
    assert found(pass_bytes=3000) == want
    assert sum("Row(start" in r for r in want) == 12


def test_packed_bits_rank_like_plain_sums():
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 1000):
        ones = rng.random(n) < 0.4
        bits, at = decontam.Bits(ones), np.arange(n + 1)
        assert (bits.rank(at) == np.concatenate(([0], np.cumsum(ones)))).all()
        assert (bits.at(at[:-1]) == ones).all()


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    outs = [packing.pack(empty), katz.train_and_score(empty)[0], chat.digest(chat.format_chats(turns)),
            quality.classify(empty, labels), toxicity.toxicity(empty, labels),
            neighbours.nearest_neighbours(vectors), substring.substring_dedup(empty),
            tokencount.token_counts(empty), jaccard.jaccard_components(empty),
            decontam.scan(empty, bench)]
    assert [o.count() for o in outs] == [0] * 10


def test_repeated_rows_null_ids_and_other_columns(spark):
    ship(spark)
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text, 1), (1, text, 2), (None, text, 3), (None, None, 4), (2, text, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    docs = docs.withColumns({"lang": F.lit("en"), "_block": F.lit(1), "held": F.lit(1)})
    out = {(r.doc_id, r.n_removed) for r in substring.substring_dedup(docs).collect()}
    assert out == {(1, 0), (None, 30), (None, 0), (2, 30)}
    comps = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.jaccard_components(docs).collect())
    assert comps == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)]
    assert packing.pack(docs).agg(F.sum("length")).first()[0] > 0
    assert katz.train_and_score(docs)[0].count() == 5
    assert tokencount.token_counts(docs).count() == 5
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert decontam.scan(docs, bench).filter("size(spans) = 1").count() == 4
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == 5
    assert toxicity.toxicity(docs, labels).count() == 5


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
            sizes.append(docs.count())
        if k == 2:
            gone = [r.n_removed for r in substring.substring_dedup(docs).collect()]
            assert sum(gone) == 0 or sum(g > 0 for g in gone) < len(gone) / 10
        if k == 3:
            bench = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert decontam.scan(docs, bench).filter("size(spans) > 0").count() <= 1
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0]
    assert docs.agg(F.max("length")).first()[0] <= packing.CAPACITY


def files_below(folder):
    return [p for p in folder.rglob("*") if p.is_file()]


def columns_stored(folder):
    """Names of all columns of the tables left below a folder."""
    return {c for p in files_below(folder) if p.suffix == ".parquet" for c in pq.read_schema(p).names}


@pytest.fixture
def shared(monkeypatch, tmp_path):
    """The folder of stored tables for one test."""
    monkeypatch.setattr(C, "shared_dir", lambda spark: str(tmp_path))
    return tmp_path


def test_sets_of_the_jaccard_join_do_not_outlive_it(docs, shared):
    want = brute.components(pairs(docs))
    found = jaccard.jaccard_components(docs)
    assert not columns_stored(shared) & {"hashes", "prefix", "shingle"}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == want


def test_training_texts_and_shards_do_not_outlive_the_fit(spark, shared):
    rng = random.Random(5)
    rows = [(i, prose(rng, 30), "en", "s", 9) for i in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    found = quality.classify(docs, labels)
    assert not columns_stored(shared) & {"text", "key", "keys", "payload"}
    assert found.count() == 80


def test_packed_bigram_counts_are_plain_counts(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(0, 40)), "en", "s", 9) for i in range(90)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(90)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    vocabulary, model, shards, _ = quality.fit(docs, labels, 7)
    ids = {r.doc_id for r in quality.fitted(docs, labels).collect()}
    want, size = Counter(), vocabulary.value.size
    for i, text, *_ in rows:
        if i in ids:
            s, _ = quality.sequence(text.encode(), vocabulary.value)
            want.update((s[:-1] * size + s[1:]).tolist())
    got = {}
    for shard in shards.toArrow().to_batches():
        for k in range(shard.num_rows):
            keys, n = quality.counts_of(shard.slice(k, 1))
            assert ((keys // size + keys % size) % 7 == shard["_bucket"][k].as_py()).all()
            got.update(zip(keys.tolist(), n.tolist()))
    assert got == dict(want)
    total = Counter()
    for key, n in want.items():
        total[key // size] += n
    assert {h: model.value.total[h] for h in total} == dict(total)


def test_katz_keeps_no_shuffle_of_a_written_table(docs, monkeypatch):
    cleaned, write = [], DataFrameWriter.parquet

    def seen(self, path, *a, **b):
        cleaned.append(docs.sparkSession.conf.get(C.CLEANUP, "false"))
        return write(self, path, *a, **b)

    def checkpoint(self, *a, **b):
        raise AssertionError("a checkpoint keeps the shuffles before it")

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    monkeypatch.setattr(type(docs), "checkpoint", checkpoint)
    scores, _ = katz.train_and_score(docs)
    assert len(cleaned) == 2 and set(cleaned) == {"true"}
    assert scores.count() == docs.count()


def test_distinct_is_sorted_and_whole():
    keys = np.random.default_rng(1).integers(0, 500, 2000).astype(np.uint64)
    for some in (keys, keys[:1], keys[:0]):
        assert np.array_equal(C.distinct(some), np.array(sorted(set(some.tolist())), np.uint64))


def test_long_rows_come_in_short_slices():
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(1000)), pa.array(["x" * 100] * 1000)], names=["doc_id", "text"])
    pieces = list(packing.cut([batch]))
    assert len(pieces) == 4 and sum(p.num_rows for p in pieces) == 1000


def own_mb():
    with open("/proc/self/smaps_rollup") as f:
        return sum(int(x.split()[1]) for x in f if x.startswith("Pss_Anon")) / 1024


def test_free_memory_goes_back_to_the_system():
    held = [bytes(60_000) for _ in range(4000)]  # each too small for a mapping of its own
    pinned, held = held[::400], None
    before = own_mb()
    C.release()
    assert len(pinned) == 10 and own_mb() < before - 150


def test_blocks_release_what_they_have_read(monkeypatch):
    calls = []
    monkeypatch.setattr(C, "release", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(3000)), pa.array(["x" * 9000] * 3000)], names=["doc_id", "text"])
    for read in (C.sized, lambda b: C.gathered(x.select(["doc_id", "text"]) for x in b)):
        del calls[:]
        assert 1 < len(list(read([batch]))) <= len(calls)
    del calls[:]
    list(packing.cut([batch.slice(0, 5)]))
    assert calls
