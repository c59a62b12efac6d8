"""Small inputs with exact answers."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.functions import clean
from textloom.functions import constants as K
from textloom.functions import tokens as T
from textloom.operators import annotate as A
from textloom.operators import curate, evaluate, select
from textloom.operators import weights as V


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first().x


SKY = ["the sky is blue", "sky is blue and sky is beautiful", "the beautiful sky is so blue",
       "i love blue cheese"]


def sky(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = T.unnest(d, ["doc_id"], T.word_tokens(F.col("text")), "term")
    return V.term_counts(t, ["doc_id"])


def test_tfidf_of_four_sentences(spark):
    tf = sky(spark, SKY)
    assert {(r.doc_id, r.term): r.tf for r in tf.collect()}[(1, "sky")] == 2
    model = V.idf_table(tf, F.lit(4))
    got = {(r.doc_id, r.term): r.weight for r in V.weigh(tf, model).collect()}
    counts = [{w: s.split().count(w) for w in s.split() if len(w) > 1} for s in SKY]
    for i, c in enumerate(counts):
        raw = {w: n * (1 + math.log(5 / (1 + sum(w in x for x in counts)))) for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        for w, x in raw.items():
            assert got[(i, w)] == pytest.approx(x / norm)
    new = V.weigh(sky(spark, ["loving this blue sky today"]), model).collect()
    assert {r.term for r in new} == {"blue", "sky"}


def test_metrics_of_twenty_labels(spark):
    actual = "s h s s s h h s h s s h h h s h h s s h".split()
    guess = "s s s h s s h h s s h h s h h h s h s s".split()
    df = spark.createDataFrame(list(zip(actual, guess)), "y string, pred string")
    r = evaluate.positive_scores(df, "s").first()
    assert (r.tp, r.fp, r.fn, r.tn) == (5, 6, 5, 4)
    assert (r.accuracy, r.precision, r.recall) == (0.45, 0.45, 0.5)
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator as Judge

    w = evaluate.weighted_scores(df, digits=6).first()
    n = df.select(*[(F.col(c) == "s").cast("double").alias(c) for c in ("y", "pred")])
    for ours, theirs in (("accuracy", "accuracy"), ("f1", "f1"),
                         ("precision", "weightedPrecision"), ("recall", "weightedRecall")):
        judge = Judge(labelCol="y", predictionCol="pred", metricName=theirs)
        assert w[ours] == pytest.approx(judge.evaluate(n), abs=1e-6)


def test_order_weights_fold_and_closed_form_agree(spark):
    docs = ["a b a c", "b", "c c c a b b", ""]
    d = spark.createDataFrame([(i, t.split()) for i, t in enumerate(docs)],
                              "doc_id long, tokens array<string>")
    got = {(r.doc_id, r.term): r.weight for r in V.order_weights(d, "doc_id", "tokens").collect()}
    want = {}
    for i, t in enumerate(docs):
        state = {}
        for w in t.split():
            state = {k: v * 0.99 for k, v in state.items()}
            state[w] = state.get(w, 0.0) + 1
        want.update({(i, k): v for k, v in state.items()})
    assert got == pytest.approx(want)


@pytest.mark.parametrize("text,want", [
    ("I can't go", "I cannot go"),
    ("CAN'T've it", "Cannot have it"),
    ("He's here, y'all'd've known", "He is here, you all would have known"),
    ("the dogs' bowl", "the dogs bowl"),
    ("plain", "plain"),
])
def test_contractions_longest_first(spark, text, want):
    assert one(spark, text, clean.expand_contractions) == want


@pytest.mark.parametrize("text, want", [
    ("'cause it", "because it"), ("He'll've gone", "He will have gone"),
])
def test_contractions_without_first_letter_or_doubled_words(spark, text, want):
    assert one(spark, text, clean.expand_contractions) == want


def test_contraction_keys_are_lower_case():
    assert all(k == k.lower() for k in K.CONTRACTIONS)


def bracket_free(text):
    depth, out = {"(": 0, "[": 0, "{": 0}, []
    for c in text:
        if c in depth:
            depth[c] += 1
            continue
        if c in ")]}":
            kind = "([{"[")]}".index(c)]
            if depth[kind]:
                depth[kind] -= 1
                continue
        if not any(depth.values()):
            out.append(c)
    return "".join(out)


@pytest.mark.parametrize("text", [
    "a (b) c", "a (b [c] d) e", "a ) b", "a (b", "x ([)] y", "{a} [b] (c) d", "no", "((a) b) c ] d",
    "a) (b) c ( d", ""])
def test_brackets_against_brute_force(spark, text):
    assert one(spark, text, clean.remove_bracketed) == bracket_free(text)


def test_inline_tags(spark):
    tags = {"MIES": "NIMI_MIES"}
    text = "x <MIES>Matti</MIES> y <MIES>Pekka</MIES>"
    assert one(spark, text, lambda t: clean.replace_inline_tags(t, tags)) == "x NIMI_MIES y NIMI_MIES"
    assert one(spark, text, lambda t: clean.replace_inline_tags(t, tags, False)) == "x Matti y Pekka"
    with pytest.raises(Exception, match="not closed"):
        one(spark, "x <MIES>Matti", lambda t: clean.replace_inline_tags(t, tags))


def test_rule_tokens_keep_number_commas(spark):
    got = one(spark, "I'm paying 1,000 euros, John's (well-known) dog. a,b", clean.rule_tokens)
    assert got == ["i", "am", "paying", "1,000", "euros", "john", "'s", "well", "known", "dog", "a",
                   "b"]


def test_question_rewrites(spark):
    got = one(spark, "What's 5k?  I'm e-mail, can't", clean.clean_question)
    assert got.split() == "what is 5000 i am email cannot".split()


def test_wiki(spark):
    text = "<text x>[[Image:a.jpg|thumb|10px|Cap]] [[link|Shown]] {{x}} &amp;nbsp; 12"
    assert one(spark, text, clean.strip_wiki) == "cap shown one two"


def test_annotation_flags(spark):
    d = spark.createDataFrame([(1, 'Hei, "maa" 3.5! Toinen lause on 1e5.')], "id long, text string")
    rows = A.annotate(d, ["id"]).orderBy("sentence_id", "pos").collect()
    assert [r.raw for r in rows] == ["Hei", ",", '"', "maa", '"', "3", ".", "5", "!", "Toinen",
                                     "lause", "on", "1e5", "."]
    assert [r.raw for r in rows if r.is_number] == ["3", "5", "1e5"]
    assert [r.raw for r in rows if r.is_eos_token] == ["!", "."]
    assert [r.raw for r in rows if r.is_eos_punct] == ['"', '"', ".", "!", "."]
    s = A.sentence_arrays(d, ["id"]).select("sentence", A.rebuild(F.col("tokens")).alias("r"))
    assert all(r.sentence == r.r for r in s.collect())


def test_ngrams_and_subwords(spark):
    assert one(spark, "abc", lambda t: T.char_ngrams(t, 1, 3)) == ["a", "b", "c", "ab", "bc", "abc"]
    assert one(spark, "", lambda t: T.char_ngrams(t, 2, 3)) == []
    assert one(spark, "abcd", lambda t: T.char_windows(t, 3)) == ["abc", "bcd", "cd", "d"]
    assert one(spark, "", lambda t: T.char_windows(t, 3)) == []


def test_prefixes_of_windows_count_like_ngrams(spark):
    texts = ["abcabcab", "a", "", "é a b", "aaaaaaa", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    w = T.unnest(df, [], T.char_windows(F.col("text"), 5), "window")
    want = Counter(t[i:i + n] for t in texts if t for n in range(2, 6) for i in range(len(t) - n + 1))
    assert {r.gram: r.n for r in V.prefix_counts(w, "window", 2, "gram").collect()} == dict(want)
    assert one(spark, "ab", lambda t: T.subwords(t, 3, 6)) == ["<ab", "ab>", "<ab>"]
    split = lambda t: T.ngrams(F.split(t, " "), 1, 2)
    assert one(spark, "x y z", split) == ["x", "y", "z", "x y", "y z"]


def test_stop_word_ngrams_close_no_gaps(spark):
    d = spark.createDataFrame([(1, ["red", "the", "car"])], "doc_id long, tokens array<string>")
    got = {r.term for r in V.sentence_ngrams(d, ["doc_id"], 2, stopwords=["the"]).collect()}
    assert got == {"red", "car"}


def test_hashes(spark):
    def fnv(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) % 2**32
        return h

    words = ["foo", "barbaz", "été"]
    assert [one(spark, w, T.fnv1a) for w in words] == [fnv(w) for w in words]
    signed = lambda h: h if h < 2**31 else h - 2**32
    hashes = [signed(fnv(w)) % 2**64 for w in words]
    want = []
    for n in (2, 3):
        for i in range(len(hashes) - n + 1):
            h = hashes[i]
            for x in hashes[i + 1:i + n]:
                h = (h * K.NGRAM_PRIME + x) % 2**64
            want.append(h % K.HASH_BUCKETS)
    got = one(spark, " ".join(words), lambda t: T.word_ngram_ids(
        F.transform(F.split(t, " "), T.fnv1a), 3))
    assert got == want


def test_padding_and_char_ids(spark):
    ids = lambda t: T.pad_left(F.transform(F.split(t, " "), lambda x: x.cast("long")), 3)
    assert one(spark, "1 2", ids) == [0, 1, 2]
    assert one(spark, "1 2 3 4", ids) == [2, 3, 4]
    assert one(spark, "ab zé", lambda t: T.char_ids(t, 4, 10)) == [0, 1, 2, 0, 0, 22, 41, 0, 0, 0]


def test_small_class_is_an_error(spark):
    d = spark.createDataFrame([("a",)] * 3 + [("b",)], "label string")
    assert select.require_class_size(d, "label", 1).count() == 2
    with pytest.raises(Exception, match="fewer than 2"):
        select.require_class_size(d, "label", 2).collect()


def test_curation(spark):
    t = spark.createDataFrame([("koiratalo", "koira#talo"), ("kissa", "kissa"), ("ab", "a#b")],
                              "raw string, lemma string")
    listed = curate.build_list(t)
    assert {r.raw for r in listed.collect()} == {"koiratalo", "ab"}
    listed = listed.withColumn("replacement", F.when(F.col("raw") == "ab", "x#y").otherwise("NULL"))
    got = {r.raw: r.lemma for r in curate.apply_list(t, listed).collect()}
    assert got == {"koiratalo": "koiratalo", "kissa": "kissa", "ab": "xy"}
