"""Hot keys, partitioning and brute-force checks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import bayes, blocks, embed, evaluate, index, joins, order, pairs, split
from textloom.operators import weights as V


@pytest.fixture(scope="module")
def skewed(spark):
    """300 rows, two thirds in one group, with tied scores."""
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, rng.randrange(20), i % 3) for i in range(300)]
    return spark.createDataFrame(rows, "grp string, item long, score long, level int").repartition(7)


def by_group(rows):
    out = {}
    for r in rows:
        out.setdefault(r.grp, []).append(r)
    return out


def test_ranked_and_totals(skewed):
    rows = order.ranked(skewed, ["grp"], [F.col("score"), F.col("item")], "r", total="n").collect()
    assert len(rows) == 300
    for g in by_group(rows).values():
        g.sort(key=lambda r: (r.score, r.item))
        assert [r.r for r in g] == list(range(1, len(g) + 1))
        assert {r.n for r in g} == {len(g)}


def test_running_total_with_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v long")
    got = order.running_totals(df, ["g"], [F.col("v")], {"t": F.col("v")}).collect()
    assert sorted((r.g or "", r.t) for r in got) == [("", 1), ("", 3), ("a", 3)]


def test_splits_ignore_partitioning(skewed):
    for fn in (lambda d: split.stratified_split(d, "grp", "item", 0.6, 1),
               lambda d: split.stratified_folds(d, "grp", "item", 5, 1),
               lambda d: split.random_split(d, "item", 0.3, 1),
               lambda d: split.contiguous_folds(d, [F.col("item")], 4)):
        a = sorted(map(tuple, fn(skewed).collect()))
        b = sorted(map(tuple, fn(skewed.repartition(2, "score")).collect()))
        assert a == b and len(a) == 300


def beats(a, b):
    return (a.score, a.item) > (b.score, b.item)


def test_tournament_and_concordance_against_pairs(skewed):
    rows = by_group(skewed.collect())
    wins = {(g, a.item): sum(beats(a, b) for b in m) for g, m in rows.items() for a in m}
    got = pairs.tournament(skewed, "grp", "score", "item").collect()
    assert {(r.grp, r.item): r.wins for r in got} == wins
    want = {g: (sum(beats(a, b) for a in m for b in m if a.level > b.level),
                sum(a.level > b.level for a in m for b in m)) for g, m in rows.items()}
    got = pairs.concordance(skewed, "grp", "level", "score", "item").collect()
    assert {r.grp: (r.correct, r.total) for r in got} == want


def test_gold_levels(skewed):
    got = pairs.gold_levels(skewed.select("item", "grp", "score"), "grp",
                            [F.desc("score"), F.col("item")]).collect()
    for g in by_group(got).values():
        g.sort(key=lambda r: (-r.score, r.item))
        assert [r.level for r in g] == ([2] + [1] * 9 + [0] * len(g))[:len(g)]


def test_auc_with_ties(spark, skewed):
    df = skewed.select((F.col("level") == 1).cast("int").alias("y"), "score")
    rows = df.collect()
    pos, neg = ([r.score for r in rows if r.y == v] for v in (1, 0))
    u = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert evaluate.roc_auc(df).first().auc == pytest.approx(u / len(pos) / len(neg))


def test_hot_lookup_equals_join(spark):
    facts = spark.createDataFrame(
        [("the" if i % 3 else f"w{i}", i) for i in range(200)], "term string, doc_id long")
    table = spark.createDataFrame(
        [("the", 1.0, 100)] + [(f"w{i}", float(i), 1) for i in range(0, 150)],
        "term string, x double, n long")
    hot = joins.hottest(table, "term", "n", 1)
    for how in ("inner", "left"):
        want = facts.join(table.select("term", "x"), "term", how).select("term", "doc_id", "x")
        key = lambda r: (r.doc_id, r.term)
        got = joins.hot_lookup(facts, table, "term", ["x"], hot, ["doc_id"], how)
        assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_hot_lookup_of_numbers_and_nulls(spark):
    facts = spark.createDataFrame([(0.0, 1), (-0.0, 2), (None, 3), (2.5, 4)], "v double, id long")
    table = spark.createDataFrame([(0.0, "a", 9), (2.5, "b", 1), (None, "c", 5)],
                                  "v double, x string, n long")
    for rows in (1, 2):
        hot = joins.hottest(table, "v", "n", rows)
        got = joins.hot_lookup(facts, table, "v", ["x"], hot, ["id"], "left").collect()
        assert {r.id: r.x for r in got} == {1: "a", 2: "a", 3: None, 4: "b"}


def test_hot_rows_are_spread(spark):
    facts = spark.range(20000).select(F.lit("the").alias("term"), F.col("id").alias("doc_id"))
    table = spark.createDataFrame([("the", 1.0, 9)], "term string, x double, n long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = joins.hot_lookup(facts, table, "term", ["x"], joins.hottest(table, "term", "n"),
                               ["doc_id"])
        sizes = out.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in sizes) == 20000
    assert max(r["count"] for r in sizes) < 20000 / 4


def test_keep_top(spark):
    t = spark.createDataFrame([(f"w{i:03d}", i % 10) for i in range(100)], "term string, n long")
    got = [(r.n, r.term) for r in joins.keep_top(t, "n", "term", 13).collect()]
    assert got == sorted(((r.n, r.term) for r in t.collect()), key=lambda x: (-x[0], x[1]))[:13]
    assert joins.keep_top(t, "n", "term", 1000).count() == 100


def closeness(metric, x):
    return blocks.cosines(x, x) if metric == "cosine" else -np.round(np.sqrt(blocks.squared_distances(x, x)), 6)


def test_nearest_in_many_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    base = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)],
                                 "base_id long, vec array<double>")
    q = base.select(F.col("base_id").alias("query_id"), "vec", F.array("base_id").alias("banned"))
    for metric in ("cosine", "euclidean"):
        got = index.VectorIndex(base, metric, part_rows=7).nearest(q, 3).collect()
        s = closeness(metric, x)
        for i in range(60):
            ids = [j for j in np.lexsort((np.arange(60), -s[i])) if j != i][:3]
            assert [r.base_id for r in sorted((r for r in got if r.query_id == i),
                                              key=lambda r: r["rank"])] == ids


def test_words_near_three_clusters(spark):
    centres = {"paris": (0, 1), "london": (0.1, 1), "berlin": (-0.1, 1), "dog": (1, 0),
               "cat": (1, 0.1), "rabbit": (1, -0.1), "red": (-1, 0), "blue": (-1, 0.1),
               "green": (-1, -0.1)}
    wv = spark.createDataFrame([(w, [float(a), float(b)]) for w, (a, b) in centres.items()],
                               "word string, vec array<double>")
    docs = {0: "dog cat", 1: "red red blue", 2: "paris unknown", 3: "unknown"}
    tf = spark.createDataFrame(
        [(i, w, t.split().count(w)) for i, t in docs.items() for w in set(t.split())],
        "doc_id long, term string, tf long")
    got = {r.doc_id: r.vec for r in embed.mean_vectors(tf, wv, 2).collect()}
    assert got[0] == pytest.approx([1.0, 0.05])
    assert got[1] == pytest.approx([-1.0, 0.1 / 3])
    assert got[2] == pytest.approx([0.0, 1.0]) and got[3] == [0.0, 0.0]


def test_count_model_against_library(spark):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import CountVectorizer

    rng = random.Random(5)
    docs = [(i, [rng.choice("abcdef" if i % 2 else "defghi") for _ in range(8)], float(i % 2))
            for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>, y double")
    cv = CountVectorizer(inputCol="tokens", outputCol="features").fit(df)
    x = cv.transform(df)
    model = NaiveBayes(labelCol="y", smoothing=1.0).fit(x)
    theirs = {r.doc_id: r.prediction for r in model.transform(x).collect()}
    tf = V.term_counts(df.select("doc_id", F.explode("tokens").alias("term")), ["doc_id"])
    ours = bayes.CountModel(tf, df.select("doc_id", "y"), "y").predict(tf).collect()
    assert {r.doc_id: r.pred for r in ours} == theirs


def test_listed_pairs_count_once(spark):
    gold = spark.createDataFrame([("g", "a", 2), ("g", "b", 1), ("g", "c", 1)],
                                 "grp string, item string, level int")
    p = spark.createDataFrame([("g", "a", "b", 1), ("g", "b", "a", 1), ("g", "c", "a", 0),
                               ("g", "b", "c", 1)], "grp string, a string, b string, label int")
    r = pairs.score_predicted_pairs(p, gold, ["grp"]).first()
    assert (r.correct, r.total) == (2, 2)


def test_mean_vectors_ship_no_vector_per_fact(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(embed, "BLOCK_FACTS", 40)
    vec = {f"w{j}": rng.normal(size=3) for j in range(30)}
    rows = [(None if i == 7 else i, f"w{j}", int(rng.integers(1, 5)))
            for i in range(50) for j in rng.choice(40, 12, replace=False)]
    wv = spark.createDataFrame([(w, v.tolist()) for w, v in vec.items()] + [("w1", [1.0, 2.0, 3.0])] +
                               [("w39", [None, 1.0, None])], "word string, vec array<double>")
    tf = spark.createDataFrame(rows, "doc_id long, term string, tf long")
    many = embed.mean_vectors(tf, wv, 3)
    joined = tf.join(wv, F.col("term") == F.col("word"), "left")
    want = embed.weighted_sum(joined.filter("vec IS NOT NULL"), "doc_id", "vec", F.col("tf"), 3,
                              [F.sum("tf").alias("_by")])
    want = {r.doc_id: [None if x is None else x / r._by for x in r._sum] for r in want.collect()}
    got = {r.doc_id: r.vec for r in many.collect()}
    assert len(got) == 50 and want.keys() <= got.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v)
    # Vectors meet distinct (block, word) pairs; no join or sum has one row of vectors per fact.
    plan = many._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "sum(" not in plan


def test_routed_queries_come_in_bounded_frames(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(index, "ROUTED_ROWS", 20)
    x = np.random.default_rng(2).normal(size=(60, 4))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "base_id long, vec array<double>")
    found = index.VectorIndex(base, "euclidean", part_rows=2)
    asked = pd.DataFrame({"query_id": range(60), "vec": list(x), "banned": [[]] * 60, "limit": np.nan})
    sizes = [len(f) for f in found._router(False, 3)(iter([asked]))]
    assert sum(sizes) > 100 and max(sizes) <= 20


def test_word_vector_partitions_do_not_exceed_what_runs_at_once(spark, monkeypatch):
    from textloom.operators import learn

    asked = []
    monkeypatch.setattr(learn, "Word2Vec", lambda **k: type("W", (), {"fit": lambda s, d: asked.append(
        k["numPartitions"])})())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 500)
    try:
        learn.train_word_vectors(spark.range(1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert asked == [spark.sparkContext.defaultParallelism]


def test_hot_facts_of_a_document_meet_in_one_task(spark):
    facts = spark.range(300).select((F.col("id") % 10).alias("doc_id"), F.concat(F.lit("w"), F.floor(
        F.col("id") / 10)).alias("term"))
    table = facts.groupBy("term").agg(F.count("*").alias("n"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = joins.hot_lookup(facts, table, "term", ["n"], joins.hottest(table, "term", "n"), ["doc_id"])
        found = out.withColumn("p", F.spark_partition_id()).groupBy("doc_id").agg(
            F.collect_set("p").alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(found) == 10 and all(len(r.p) == 1 for r in found)
