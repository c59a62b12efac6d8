"""Embedding queries (E-*) and nearest-neighbour classification (M-11)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import constants as K
from textloom.functions import tokens as T
from textloom.operators import blocks, embed, index, order
from textloom.operators import weights as V
from textloom.operators.joins import hot_lookup, hottest
from textloom.plans.features import IDF, PAIRS, adjacent_pairs, n_docs
from textloom.plans.ranking import VEC_SPLIT, split_vectors
from textloom.plans.registry import TF, TOK, query, table
from textloom.plans.tokenizing import (
    DIM, VOCAB, WV, _grams_sql, term_blocks, term_counts, vocab_of, word_vectors)
from textloom.session import checkpoint

BENCH = f"""bench AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '{K.WORD_2PLUS}')) AS term
  FROM benchmark), bterm AS (SELECT DISTINCT term FROM bench)"""
WV_TF = WV + ", " + TF[len(TOK) + 2:]


def bench_words(spark, sf):
    b = table(spark, sf, "benchmark")
    return T.unnest(b, [], T.word_tokens(F.col("text")), "word").distinct()


def long_form(df, key, vec="vec", digits=4):
    out = df.select(key, F.posexplode(vec).alias("dim", "value"))
    return out.select(key, F.col("dim").cast("long").alias("dim"),
                      F.round("value", digits).alias("value"))


def _checksum(vec):
    """First value and a position-weighted sum: enough to compare whole vectors."""
    total = F.aggregate(F.transform(vec, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0),
                        lambda a, x: a + x)
    return [F.round(vec[0].cast("double"), 4).alias("first"), F.round(total, 3).alias("mix")]


_CHECK = """round({v}[1]::DOUBLE, 4) + 0.0 AS first, round(list_sum(list_transform({v}::DOUBLE[],
  lambda x, i: x * i)), 3) + 0.0 AS mix"""


@query("e1_restrict_vectors", f"""
WITH {WV}, {BENCH} SELECT word, {_CHECK.format(v='vec')} FROM wv SEMI JOIN bterm ON word = term""")
def e1(spark, sf):
    r = embed.restrict(word_vectors(spark, sf), bench_words(spark, sf))
    return r.select("word", *_checksum(F.col("vec")))


@query("e2_lookup", f"""
WITH {WV}, {BENCH} SELECT term AS word, vec IS NOT NULL AS known, round(vec[1], 4) + 0.0 AS first
FROM bterm LEFT JOIN wv ON word = term""")
def e2(spark, sf):
    j = bench_words(spark, sf).join(word_vectors(spark, sf), "word", "left")
    return j.select("word", F.col("vec").isNotNull().alias("known"),
                    F.round(F.col("vec")[0].cast("double"), 4).alias("first"))


_LONG = """l AS (SELECT doc_id, i AS dim, {w} AS w, tf, vec[i + 1] AS x FROM (
  SELECT doc_id, tf, {w0} AS w0, vec, unnest(range(64)) AS i FROM {src}))"""
_ALL = """SELECT doc_id, dim, coalesce(round(value, 4), 0.0) + 0.0 AS value FROM
  (SELECT DISTINCT doc_id, d AS dim FROM tf, range(64) AS r(d)) LEFT JOIN m USING (doc_id, dim)"""


@query("e4_mean_vectors", f"""
WITH {WV_TF}, {_LONG.format(w='tf', w0='1', src='tf JOIN wv ON word = term')},
m AS (SELECT doc_id, dim, sum(w * x) / sum(w) AS value FROM l GROUP BY ALL) {_ALL}""")
def e4(spark, sf):
    return long_form(embed.mean_vectors(term_counts(spark, sf), word_vectors(spark, sf), DIM),
                     "doc_id")


_WEIGHTED = f"""WITH {WV}, {IDF[len(TOK) + 2:]}"""


@query("e5_tfidf_mean", f"""
{_WEIGHTED}, {_LONG.format(w='tf * w0', w0='weight', src='tfidf JOIN wv ON word = term')},
m AS (SELECT doc_id, dim, sum(w * x) / sum(w) AS value FROM l GROUP BY ALL) {_ALL}""")
def e5(spark, sf):
    t = term_blocks(spark, sf)
    idf = V.idf_of(t.vocabulary(), n_docs(spark, sf))
    return long_form(embed.block_means(t, word_vectors(spark, sf), DIM, idf), "doc_id")


@query("e6_idf_mean", f"""
{_WEIGHTED}, {_LONG.format(w='tf * w0', w0='idf', src='tf JOIN idf USING (term) JOIN wv ON word = term')},
m AS (SELECT doc_id, dim, sum(w * x) / sum(tf) AS value FROM l GROUP BY ALL) {_ALL}""")
def e6(spark, sf):
    tf = term_counts(spark, sf)
    idf = V.idf_table(tf, n_docs(spark, sf))
    highest = idf.agg(F.max("idf")).scalar()
    hot = hottest(idf, "term", "df")
    w = hot_lookup(tf, idf, "term", ["idf"], hot, ["doc_id"], "left").withColumn(
        "idf", F.coalesce("idf", highest))
    return long_form(embed.mean_vectors(w, word_vectors(spark, sf), DIM, weight=F.col("idf"),
                                        by_count=True), "doc_id")


_UNIT = """uv AS (SELECT word, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec
  FROM wv)"""


@query("e7_unit_mean", f"""
WITH {WV_TF}, {_UNIT}, {_LONG.format(w='tf', w0='1', src='tf JOIN uv ON word = term')},
m0 AS (SELECT doc_id, dim, sum(w * x) / sum(w) AS value FROM l GROUP BY ALL),
m AS (SELECT doc_id, dim, value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)) AS value
  FROM m0) {_ALL}""")
def e7(spark, sf):
    return long_form(embed.mean_vectors(term_counts(spark, sf), word_vectors(spark, sf), DIM,
                                        l2="both"), "doc_id")


# The n-gram table: the n-th most frequent 3- to 6-gram of the vocabulary takes the n-th vector.
GRAMS = VOCAB + f""", sub AS (
  SELECT term, unnest({_grams_sql("'<' || term || '>'", 3, 6)}) AS gram FROM vocab),
gv AS (SELECT gram, embedding::DOUBLE[] AS vec FROM (SELECT gram, row_number() OVER (
    ORDER BY count(*) DESC, gram) - 1 AS vec_id FROM sub GROUP BY gram)
  JOIN embeddings USING (vec_id))"""


def gram_vectors(spark, sf):
    v = vocab_of(spark, sf).select("term")
    n = T.unnest(v, [], T.subwords(F.col("term")), "gram").groupBy("gram").agg(
        F.count("*").alias("n"))
    r = order.ranked(n, [], [F.desc("n"), F.col("gram")], "r")
    e = table(spark, sf, "embeddings").select((F.col("vec_id") + 1).alias("r"),
                                              F.col("embedding").alias("vec"))
    return r.join(e, "r").select("gram", "vec")


@query("e8_subword_vectors", f"""
WITH {GRAMS}, {BENCH}, s AS (
  SELECT term AS word, unnest({_grams_sql("'<' || term || '>'", 3, 6)}) AS gram FROM bterm),
l AS (SELECT word, i AS dim, vec[i + 1] AS x FROM (
  SELECT word, vec, unnest(range(64)) AS i FROM s JOIN gv USING (gram)))
SELECT word, dim, round(avg(x), 4) + 0.0 AS value FROM l GROUP BY ALL""")
def e8(spark, sf):
    return long_form(embed.subword_vectors(bench_words(spark, sf), gram_vectors(spark, sf), DIM),
                     "word")


# One query per label: its first vector. Analogies use the label's first three vectors.
FIRST = """f AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (
  PARTITION BY label ORDER BY vec_id) AS k FROM embeddings)"""
_COS = """round(list_dot_product({q}, {b}) / sqrt(list_dot_product({q}, {q}))
  / sqrt(list_dot_product({b}, {b})), 6) + 0.0"""


def first_vectors(spark, sf, n):
    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, sf, "embeddings").withColumnRenamed("embedding", "vec")
    return e.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)


def base_vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("base_id"), F.col("embedding").alias("vec"))


@query("e9_nearest", f"""
WITH {FIRST}, s AS (SELECT f.vec_id AS query_id, e.vec_id AS base_id,
    {_COS.format(q='f.v', b='e.embedding::DOUBLE[]')} AS score
  FROM f, embeddings e WHERE k = 1 AND e.vec_id <> f.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_id)::INTEGER AS rank
  FROM s) SELECT query_id, base_id, score, rank FROM r WHERE rank <= 10""")
def e9(spark, sf):
    q = first_vectors(spark, sf, 1).select(
        F.col("vec_id").alias("query_id"), "vec", F.array("vec_id").alias("banned"))
    return index.nearest(q, base_vectors(spark, sf), 10)


@query("e10_analogies", f"""
WITH {FIRST}, q AS (SELECT a.label, a.vec_id AS query_id, [a.vec_id, b.vec_id, c.vec_id] AS banned,
    list_transform(list_zip(a.v, b.v, c.v), lambda z: z[1] - z[2] + z[3]) AS v
  FROM f a JOIN f b USING (label) JOIN f c USING (label) WHERE a.k = 1 AND b.k = 2 AND c.k = 3),
s AS (SELECT query_id, e.vec_id AS base_id, {_COS.format(q='q.v', b='e.embedding::DOUBLE[]')} AS score
  FROM q, embeddings e WHERE NOT list_contains(banned, e.vec_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_id)::INTEGER AS rank
  FROM s) SELECT query_id, base_id, score, rank FROM r WHERE rank <= 10""")
def e10(spark, sf):
    three = first_vectors(spark, sf, 3).groupBy("label").agg(
        F.array_sort(F.collect_list(F.struct("k", "vec_id", "vec"))).alias("t"))
    three = three.filter(F.size("t") == 3)
    vec = lambda i: F.col("t")[i]["vec"]
    a_minus_b = F.zip_with(vec(0), vec(1), lambda x, y: x.cast("double") - y.cast("double"))
    q = three.select(
        F.col("t")[0]["vec_id"].alias("query_id"),
        F.zip_with(a_minus_b, vec(2), lambda x, y: x + y.cast("double")).alias("vec"),
        F.col("t.vec_id").alias("banned"))
    return index.nearest(q, base_vectors(spark, sf), 10)


# Word pairs: neighbours in the vocabulary's order; the gold value is their shared length.
_WORD_PAIRS = WV + """, ranked AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) AS r
  FROM vocab), wp AS (SELECT a.term AS w1, b.term AS w2,
    abs(length(a.term) - length(b.term))::DOUBLE AS gold
  FROM ranked a JOIN ranked b ON b.r = a.r + 1),
sim AS (SELECT gold, round(list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec))
  / sqrt(list_dot_product(b.vec, b.vec)), 6) AS cosine
  FROM wp LEFT JOIN wv a ON a.word = w1 LEFT JOIN wv b ON b.word = w2)"""


@query("e11_word_similarity", f"""
WITH {_WORD_PAIRS}, k AS (SELECT
    rank() OVER (ORDER BY cosine) + (count(*) OVER (PARTITION BY cosine) - 1) / 2.0::DOUBLE AS ra,
    rank() OVER (ORDER BY gold) + (count(*) OVER (PARTITION BY gold) - 1) / 2.0::DOUBLE AS rb
  FROM sim WHERE cosine IS NOT NULL)
SELECT round(corr(ra, rb), 6) AS spearman, count(*) AS n,
  (SELECT ceil(100.0 * count(*) FILTER (cosine IS NULL) / count(*))::BIGINT FROM sim) AS unknown
FROM k""")
def e11(spark, sf):
    r = order.ranked(vocab_of(spark, sf), [], [F.desc("n"), F.col("term")], "r")
    wv = word_vectors(spark, sf)
    a = r.select(F.col("term").alias("w1"), "r")
    b = r.select(F.col("term").alias("w2"), (F.col("r") - 1).alias("r"))
    wp = a.join(b, "r").withColumn(
        "gold", F.abs(F.length("w1") - F.length("w2")).cast("double"))
    va = wv.select(F.col("word").alias("w1"), F.col("vec").alias("va"))
    vb = wv.select(F.col("word").alias("w2"), F.col("vec").alias("vb"))
    j = wp.join(va, "w1", "left").join(vb, "w2", "left").select(
        "gold", F.round(embed.cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))
    j = checkpoint(j)  # two numbers per pair, read by each ranking below
    share = j.agg(F.ceil(100.0 * F.count(F.when(F.col("cosine").isNull(), 1)) / F.count("*"))
                  .cast("long")).scalar()
    s = embed.spearman(j.filter("cosine IS NOT NULL"), "cosine", "gold")
    return s.select(F.round("spearman", 6).alias("spearman"), "n", share.alias("unknown"))


# By word: every known word of the benchmark asks; its items' first three known words form analogies.
_WORD_NEAR = f"""s AS (SELECT query_id, query, w.word, {_COS.format(q='q.v', b='w.vec')} AS score
  FROM q, wv w WHERE NOT list_contains(banned, w.word)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, word)::INTEGER AS rank FROM s)
SELECT query, word, score, rank FROM r WHERE rank <= 10"""


@query("e9_nearest_words", f"""
WITH {WV}, {BENCH}, q AS (SELECT word AS query_id, word AS query, vec AS v, [word] AS banned
  FROM wv SEMI JOIN bterm ON word = term), {_WORD_NEAR}""")
def e9_words(spark, sf):
    wv = word_vectors(spark, sf)
    asked = embed.restrict(wv, bench_words(spark, sf)).select("word")
    return embed.nearest_words(wv, asked, 10).withColumnRenamed("query_id", "query")


@query("e10_word_analogies", f"""
WITH {WV}, p AS (SELECT item_id, t[i] AS term, i FROM (SELECT item_id, t, unnest(range(1, len(t) + 1)) AS i
  FROM (SELECT item_id, regexp_extract_all(lower(text), '{K.WORD_2PLUS}') AS t FROM benchmark))),
f AS (SELECT item_id, word, vec, row_number() OVER (PARTITION BY item_id ORDER BY min(i)) AS k
  FROM p JOIN wv ON word = term GROUP BY item_id, word, vec),
q AS (SELECT a.item_id AS query_id, a.word || ' - ' || b.word || ' + ' || c.word AS query,
    [a.word, b.word, c.word] AS banned,
    list_transform(list_zip(a.vec, b.vec, c.vec), lambda z: z[1] - z[2] + z[3]) AS v
  FROM f a JOIN f b USING (item_id) JOIN f c USING (item_id) WHERE a.k = 1 AND b.k = 2 AND c.k = 3),
{_WORD_NEAR.replace('SELECT query, word', 'SELECT query_id AS item_id, query, word')}""")
def e10_words(spark, sf):
    wv = word_vectors(spark, sf)
    b = table(spark, sf, "benchmark")
    seen = T.unnest(b, ["item_id"], T.word_tokens(F.col("text")), "word", "pos").groupBy(
        "item_id", "word").agg(F.min("pos").alias("pos"))
    known = seen.join(wv.select("word"), "word", "left_semi")
    at = F.row_number().over(Window.partitionBy("item_id").orderBy("pos"))
    three = known.withColumn("k", at).filter("k <= 3").groupBy("item_id").agg(*[
        F.max(F.when(F.col("k") == k, F.col("word"))).alias(c) for k, c in enumerate("abc", 1)])
    found = embed.word_analogies(wv, three.filter("c IS NOT NULL"), "item_id", 10)
    asked = F.concat("a", F.lit(" - "), "b", F.lit(" + "), "c").alias("query")
    return found.join(three.select("item_id", asked), "item_id")


_COARSE = "list_transform(embedding, lambda x: round(x::DOUBLE, 1))"


@query("e13_self_rank", f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, {_COARSE} AS q FROM embeddings),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, {_COS.format(q='a.q', b='b.v')} AS s FROM e a, e b),
o AS (SELECT a, s AS own FROM s WHERE a = b),
r AS (SELECT a, count(*) FILTER (s > own OR (s = own AND b < a)) AS rank,
  max(s) FILTER (a <> b) AS runner_up FROM s JOIN o USING (a) GROUP BY a)
SELECT rank, count(*) AS n, round(max(runner_up), 6) AS best_runner_up FROM r GROUP BY rank""")
def e13(spark, sf):
    e = table(spark, sf, "embeddings")
    coarse = F.transform("embedding", lambda x: F.round(x.cast("double"), 1))
    q = e.withColumn("q", coarse)
    q = q.select(F.col("vec_id").alias("query_id"), F.col("q").alias("vec"),
                 F.round(embed.cosine(F.col("q"), F.col("embedding")), 6).alias("own_score"))
    r = blocks.own_rank(q, base_vectors(spark, sf))
    return r.groupBy("rank").agg(F.count("*").alias("n"),
                                 F.round(F.max("runner_up"), 6).alias("best_runner_up"))


WIDTH = 40


@query("e14_fixed_sequence", f"""
WITH {WV}, p AS (SELECT doc_id, w[i] AS term, i - 1 AS pos FROM (
  SELECT doc_id, w, unnest(range(1, least(len(w), {WIDTH}) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(lower(text), '{K.WORD_2PLUS}') AS w FROM documents))),
f AS (SELECT word, vec[1] AS f FROM wv),
h AS (SELECT doc_id, pos, f FROM p JOIN f ON word = term)
SELECT 'skip' AS mode, doc_id, {WIDTH} - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS slot,
  round(f, 4) + 0.0 AS first FROM h
UNION ALL SELECT 'zero', doc_id, pos, round(f, 4) + 0.0 FROM h""")
def e14(spark, sf):
    from textloom.plans.tokenizing import corpus_tokens

    t, wv = corpus_tokens(spark, sf), word_vectors(spark, sf)
    first = F.round(F.col("vec")[0].cast("double"), 4).alias("first")
    modes = [embed.fixed_sequence(t, wv, "doc_id", WIDTH, keep).select(
        F.lit(name).alias("mode"), "doc_id", "slot", first)
        for name, keep in (("skip", False), ("zero", True))]
    return modes[0].unionByName(modes[1])


@query("e15_relaxed_transport", f"""
WITH {WV}, {PAIRS}, t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text),
    '{K.WORD_2PLUS}')) AS term FROM conversations),
w AS (SELECT conv_id, turn, term, vec, count(*) AS n FROM t JOIN wv ON word = term GROUP BY ALL),
d AS (SELECT p.conv_id, p.a, p.b, x.term AS ta, y.term AS tb, x.n AS na, y.n AS nb,
    list_distance(x.vec, y.vec) AS d FROM pairs p
  JOIN w x ON x.conv_id = p.conv_id AND x.turn = p.a
  JOIN w y ON y.conv_id = p.conv_id AND y.turn = p.b),
l AS (SELECT conv_id, a, b, sum(n * d) / sum(n) AS cost FROM (SELECT conv_id, a, b, ta,
  any_value(na) AS n, min(d) AS d FROM d GROUP BY ALL) GROUP BY ALL),
r AS (SELECT conv_id, a, b, sum(n * d) / sum(n) AS cost FROM (SELECT conv_id, a, b, tb,
  any_value(nb) AS n, min(d) AS d FROM d GROUP BY ALL) GROUP BY ALL)
SELECT conv_id, a, b, round(greatest(l.cost, r.cost), 4) AS distance FROM l JOIN r USING (conv_id, a, b)""")
def e15(spark, sf):
    c = table(spark, sf, "conversations")
    t = T.unnest(c, ["conv_id", "turn"], T.word_tokens(F.col("text")), "word")
    n = t.groupBy("conv_id", "turn", "word").agg(F.count("*").alias("n"))
    known = n.join(word_vectors(spark, sf), "word")
    bags = known.groupBy("conv_id", "turn").agg(F.collect_list(F.struct(
        F.col("n").cast("double").alias("weight"), "vec")).alias("bag"))
    p = adjacent_pairs(spark, sf)
    p = p.join(bags.withColumnsRenamed({"turn": "a", "bag": "bag_a"}), ["conv_id", "a"])
    p = p.join(bags.withColumnsRenamed({"turn": "b", "bag": "bag_b"}), ["conv_id", "b"])
    out = embed.relaxed_transport(p.select("conv_id", "a", "b", "bag_a", "bag_b"), "bag_a", "bag_b")
    return out.withColumn("distance", F.round("distance", 4))


@query("e16_top_norms", """
SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm
FROM embeddings ORDER BY norm DESC, vec_id LIMIT 100""")
def e16(spark, sf):
    e = table(spark, sf, "embeddings")
    n = e.select("vec_id", F.round(embed.norm(F.col("embedding")), 5).alias("norm"))
    return n.orderBy(F.desc("norm"), "vec_id").limit(100)


def _vote(score):
    return f"""
WITH {VEC_SPLIT}, s AS (SELECT a.vec_id AS q, a.label, b.vec_id AS b, b.label AS cls, {score} AS s
  FROM e a, e b WHERE a.is_test AND NOT b.is_test),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, b) AS k FROM s),
n AS (SELECT q, any_value(label) AS label, cls, count(*) AS n FROM r WHERE k <= {{k}} GROUP BY q, cls)
SELECT q AS query_id, any_value(label) AS label, arg_min(cls, (-n, cls)) AS pred FROM n GROUP BY q"""


def neighbour_vote(spark, sf, k, metric):
    """Majority label of the k nearest training vectors, the smaller label on equal counts."""
    train, test = split_vectors(spark, sf)
    q = test.select(F.col("vec_id").alias("query_id"), "vec",
                    F.array().cast("array<bigint>").alias("banned"))
    near = index.nearest(q, train.select(F.col("vec_id").alias("base_id"), "vec"), k, metric)
    votes = near.join(train.select(F.col("vec_id").alias("base_id"), F.col("label").alias("cls")),
                      "base_id").groupBy("query_id", "cls").agg(F.count("*").alias("n"))
    pred = votes.groupBy("query_id").agg(
        F.min_by("cls", F.struct(-F.col("n"), "cls")).alias("pred"))
    return pred.join(test.select(F.col("vec_id").alias("query_id"), "label"), "query_id").select(
        "query_id", "label", "pred")


@query("m11_knn_cosine", _vote(_COS.format(q="a.v", b="b.v")).format(k=3))
def m11_cosine(spark, sf):
    return neighbour_vote(spark, sf, 3, "cosine")


@query("m11_knn_euclidean", _vote("-round(list_distance(a.v, b.v), 6)").format(k=5))
def m11_euclidean(spark, sf):
    return neighbour_vote(spark, sf, 5, "euclidean")
