import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import blocks, embed, learn, terms
from textloom.operators import weights as V
from textloom.operators.terms import TermBlocks
from textloom.plans import registry
from textloom.plans.features import v1, v3
from textloom.plans.tokenizing import term_counts
from textloom.session import stage
from textloom.sources import readers

ROWS = [(1, "a b a"), (2, "b c"), (1, "a d"), (None, "b"), (3, ""), (4, None)]


def blocks_of(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    return TermBlocks(docs, F.filter(F.split("text", " "), lambda x: x != ""))


def test_term_blocks_count_weigh_and_rename(spark):
    t = blocks_of(spark)
    assert {tuple(r) for r in t.vocabulary().collect()} == {("a", 1, 3), ("b", 3, 3), ("c", 1, 1), ("d", 1, 1)}
    idf = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 0.0)], "term string, idf double")
    found = {(r.doc_id, r.term): (r.tf, r.weight) for r in t.weigh(idf).collect()}
    long = math.sqrt(37)
    assert set(found) == {(1, "a"), (1, "b"), (2, "b"), (2, "c"), (None, "b")}
    assert found[1, "a"] == (3, pytest.approx(6 / long)) and found[1, "b"] == (1, pytest.approx(1 / long))
    assert found[2, "c"] == (1, 0.0) and found[None, "b"] == (1, 1.0)
    plain = {(r.doc_id, r.term): r.weight for r in t.weigh(idf, sublinear=True, normalize=False).collect()}
    assert plain[1, "a"] == pytest.approx(2 * (1 + math.log(3)))
    names = spark.createDataFrame([("a", "x"), ("b", "x")], "term string, name string")
    by = lambda *a: {tuple(r) for r in t.renamed(names, "name", *a).collect()}
    assert by() == {(1, "x", 4), (1, "d", 1), (2, "x", 1), (2, "c", 1), (None, "x", 1)}
    assert by("drop") == {(1, "x", 4), (2, "x", 1), (None, "x", 1)}
    assert by("") == {(1, "x", 4), (1, "", 1), (2, "x", 1), (2, "", 1), (None, "x", 1)}


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange" in line]


def test_only_texts_are_shuffled_to_count_by_document(spark, tmp_path, monkeypatch):
    """As with a large input, whose many splits are read as they are."""
    monkeypatch.setattr(registry, "spread", lambda df, *keys: df)
    spark.createDataFrame([(1, "One two. Three", "en"), (2, "Four.", "en")], "doc_id long, text string, lang string"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    for query in (term_counts, v1, v3):
        moved = exchanges(query(spark, str(tmp_path)))
        assert len(moved) == 1 and "hashpartitioning(doc_id" in moved[0], (query, moved)


def test_annotated_lines_are_numbered_and_counted_without_a_shuffle_of_lines(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for name, n in (("a", 300), ("b", 200)):
        lines = [f"{i}\tW\tw{i % 7}\tX" if i % 5 else "" for i in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        tokens = readers.annotated_ranges(spark, str(tmp_path))
        assert not exchanges(tokens) or all("Broadcast" in x for x in exchanges(tokens))
        rows = tokens.collect()
        found = {r.lemma: (r.n_tokens, r.n_sentences) for r in readers.lemma_counts(tokens).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(n, i): i // 5 + 2 for n, size in (("a", 300), ("b", 200)) for i in range(size) if i % 5}
    assert len({r._range for r in rows}) > 4
    # The first line of a file is blank, so its first token is of sentence 2.
    got = sorted((r.path[-1], r.pos, r.sentence_id, r.lemma) for r in rows)
    assert got == sorted((n, i - i // 5 - 1, s, f"w{i % 7}") for (n, i), s in want.items())
    for lemma in {f"w{i % 7}" for _, i in want}:
        mine = [(n, s) for (n, i), s in want.items() if f"w{i % 7}" == lemma]
        assert found[lemma] == (len(mine), len(set(mine)))


def test_rows_are_sent_for_no_more_parts_than_keep_the_tasks_busy():
    assert blocks._sides(100, 100, 32) == (7, 7)
    assert blocks._sides(1, 100, 32) == (1, 32)
    assert blocks._sides(100, 1, 32) == (32, 1)
    assert blocks._sides(3, 2, 400) == (3, 2)
    q, b = blocks._sides(1000, 1000, 32)
    assert q == b == -(-1000 // blocks.BLOCKS_HELD)


def test_hashed_counts_replace_the_tokens_before_fits(spark):
    df = spark.createDataFrame([(1, 0.0, ["a", "b"])], "doc_id long, y double, tokens array<string>")
    ready, rest = learn.prepared(df, [*learn.text_stages(16), learn.CLASSIFIERS["bayes"]("y")], ["doc_id", "y"])
    assert ready.columns == ["doc_id", "y", "counts"] and len(rest) == 3


def test_vectors_reach_a_group_of_blocks_once_and_groups_go_in_waves(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(None if i == 7 else i, " ".join(rng.choices([f"w{j}" for j in range(30)], k=rng.randint(0, 12)) * 2))
            for i in range(60)]
    docs = spark.createDataFrame([*rows, (1, "w0 w1")], "doc_id long, text string")
    vectors = [(f"w{j}", [float(j), 1.0 - j]) for j in range(0, 30, 2)] + [("w2", [5.0, 5.0]), ("w4", [None, 1.0]),
                                                                      ("w6", None), ("w8", [3.0])]
    wv = spark.createDataFrame(vectors, "word string, vec array<double>")
    words = F.filter(F.split("text", " "), lambda x: x != "")
    t = TermBlocks(docs, words)
    idf = stage(t.vocabulary().filter("term != 'w12'").withColumn("idf", 1 + F.col("df") / 10))
    monkeypatch.setattr(terms, "GROUP_FACTS", 30)
    monkeypatch.setattr(terms, "WAVE_GROUPS", 4)
    met = []
    monkeypatch.setattr(terms, "stage", lambda df: met.append(df) or stage(df))
    tf = V.term_counts(docs.select("doc_id", F.explode(words).alias("term")), ["doc_id"])
    plain = embed.mean_vectors(tf, wv, 2), embed.mean_vectors(
        V.weigh(tf, idf), wv, 2, weight=F.col("weight"))
    for want, model in zip(plain, (None, idf)):
        t = TermBlocks(docs, words)
        got = {r.doc_id: r.vec for r in embed.block_means(t, wv, 2, model).collect()}
        want = {r.doc_id: r.vec for r in want.collect()}
        assert got.keys() == want.keys() and None in got
        assert all(got[k] == [None if x is None else pytest.approx(x) for x in v] for k, v in want.items())
    n, _ = t.group(30)
    assert n > 8 and len(met) == 2 * (1 + -(-n // 4))  # the blocks, then a table for each wave


def test_model_comparison_keeps_no_tokens(spark, tmp_path, monkeypatch):
    from textloom.plans import learning

    spark.createDataFrame([(i, f"One two w{i}. Three", "en") for i in range(8)], "doc_id long, text string, lang string"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int"
                          ).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, [float(i)] * 64) for i in range(5)], "vec_id long, embedding array<float>"
                          ).write.parquet(f"{tmp_path}/embeddings.parquet")
    kept = []
    for module in (learning, learn):
        monkeypatch.setattr(module, "checkpoint", lambda df, put=module.checkpoint: kept.append(df.columns) or put(df))

    def stop(stages, train, test):
        raise StopIteration

    monkeypatch.setattr(learn, "fit_predict", stop)
    with pytest.raises(StopIteration):
        learning.model_comparison(spark, str(tmp_path))
    assert len(kept) == 4 and not any({"tokens", "text"} & set(c) for c in kept)
