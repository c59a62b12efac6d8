"""Aggregate, window, sort, set, join and pair queries (A-*, W-*, O-*, U-*, J-*, M-20, M-21)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import constants as K
from textloom.functions import tokens as T
from textloom.operators import annotate as A
from textloom.operators import blocks, evaluate, order, pairs, split
from textloom.plans.features import (
    PAIRS, PRUNED, _u, adjacent_pairs, pruned_vocabulary)
from textloom.plans.registry import TF, query, sql_list, table
from textloom.plans.tokenizing import SENT, corpus_tokens, docs, term_counts, vocab_of
from textloom.sources import readers


@query("a1_group_stats", """
SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 4) AS mean_chars
FROM documents GROUP BY source""")
def a1(spark, sf):
    return docs(spark, sf).groupBy("source").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars"),
        F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("a2_distinct", f"""
WITH t AS (SELECT lang, source, unnest(regexp_extract_all(lower(text), '{K.WORD_2PLUS}')) AS term
  FROM documents)
SELECT lang, count(DISTINCT term) AS n_terms, count(DISTINCT source) AS n_sources
FROM t GROUP BY lang""")
def a2(spark, sf):
    d = docs(spark, sf)
    t = T.unnest(d, ["lang"], T.word_tokens(F.col("text")), "term").distinct()
    terms = t.groupBy("lang").agg(F.count("*").alias("n_terms"))
    sources = d.select("lang", "source").distinct().groupBy("lang").agg(
        F.count("*").alias("n_sources"))
    return terms.join(sources, "lang")


LANGS = ["de", "en", "es", "fr"]


def _hits(tokens, lang):
    return F.size(F.filter(tokens, lambda t: t.isin(K.STOPWORDS[lang]))) + 1.0


_HIT = ", ".join(f"len(list_filter(w, lambda t: list_contains({sql_list(K.STOPWORDS[c])}, t))) + 1.0::DOUBLE AS h_{c}"
                 for c in LANGS)
_SUM = " + ".join(f"h_{c}" for c in LANGS)


@query("a3_mean_probability", f"""
WITH {SENT}, w AS (SELECT doc_id, regexp_extract_all(lower(sentence), '{K.WORD_2PLUS}') AS w FROM sent),
h AS (SELECT doc_id, {_HIT} FROM w),
m AS (SELECT doc_id, {", ".join(f"round(avg(h_{c} / ({_SUM})), 6) AS p_{c}" for c in LANGS)}
  FROM h GROUP BY doc_id)
SELECT *, CASE greatest({", ".join(f"p_{c}" for c in LANGS)})
  {" ".join(f"WHEN p_{c} THEN '{c}'" for c in LANGS)} END AS best FROM m""")
def a3(spark, sf):
    return language_votes(spark, sf)


def language_votes(spark, sf):
    """Mean over sentences of each language's share of stop-word hits, and the likeliest."""
    s = A.sentences(docs(spark, sf), ["doc_id"]).select(
        "doc_id", T.word_tokens(F.col("sentence")).alias("w"))
    h = s.select("doc_id", *[_hits("w", c).alias(f"h_{c}") for c in LANGS])
    total = sum((F.col(f"h_{c}") for c in LANGS[1:]), F.col(f"h_{LANGS[0]}"))
    m = h.groupBy("doc_id").agg(*[
        F.round(F.avg(F.col(f"h_{c}") / total), 6).alias(f"p_{c}") for c in LANGS])
    top = F.greatest(*[f"p_{c}" for c in LANGS])
    best = F.lit(LANGS[-1])
    for c in reversed(LANGS[:-1]):
        best = F.when(F.col(f"p_{c}") == top, c).otherwise(best)
    return m.withColumn("best", best)


@query("a4_upper_median", """
SELECT lang, list_sort(list(n_chars))[count(*) // 2 + 1] AS median FROM documents GROUP BY lang""")
def a4(spark, sf):
    n = docs(spark, sf).groupBy("lang", "n_chars").agg(F.count("*").alias("n"))
    run = order.running_totals(n, ["lang"], [F.col("n_chars")], {"upto": F.col("n")},
                               {"upto": "total"})
    at = F.floor(F.col("total") / 2) + 1
    hit = run.filter((F.col("upto") >= at) & (F.col("upto") - F.col("n") < at))
    return hit.select("lang", F.col("n_chars").alias("median"))


@query("a5_confusion", """
WITH c AS (SELECT quality AS y, toxic AS pred, count(*) AS n FROM labels GROUP BY ALL)
SELECT y, pred, n, round(n / sum(n) OVER (PARTITION BY y), 6) AS share FROM c""")
def a5(spark, sf):
    t = table(spark, sf, "labels").select(F.col("quality").alias("y"), F.col("toxic").alias("pred"))
    return evaluate.confusion_shares(t)


GOLD = """ranked AS (SELECT conv_id, turn AS item, length(text) AS score,
    row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r
  FROM conversations), gold AS (SELECT conv_id, item, score,
    CASE WHEN r = 1 THEN 2 WHEN r <= 10 THEN 1 ELSE 0 END AS level FROM ranked)"""


def items(spark, sf):
    """Turns as items of their conversation, scored by length."""
    return table(spark, sf, "conversations").select(
        "turn", "conv_id", F.length("text").cast("long").alias("score")
    ).withColumnRenamed("turn", "item")


def gold(spark, sf):
    return pairs.gold_levels(items(spark, sf), "conv_id", [F.desc("score"), F.col("item")])


@query("w1_rank_buckets", f"WITH {GOLD} SELECT conv_id, item, level FROM gold")
def w1(spark, sf):
    return gold(spark, sf).select("conv_id", "item", "level")


@query("w2_running_breaks", """
SELECT conv_id, turn, sum(CASE role WHEN 'user' THEN 1 ELSE 0 END) OVER (
  PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS exchange
FROM conversations""")
def w2(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    is_break = F.when(F.col("role") == "user", 1).otherwise(0).cast("long")
    return order.running_totals(c, ["conv_id"], [F.col("turn")], {"exchange": is_break}).drop("role")


@query("w3_positions", f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '{K.WORD_2PLUS}') AS w FROM documents),
p AS (SELECT doc_id, w[i] AS term, i - 1 AS pos FROM (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w))
SELECT doc_id, term, min(pos)::INTEGER AS first_pos, max(pos)::INTEGER AS last_pos FROM p GROUP BY ALL""")
def w3(spark, sf):
    return corpus_tokens(spark, sf).groupBy("doc_id", "term").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def top_and_bottom(df, value, tie, n):
    """The n highest and n lowest rows side by side; only 2n rows are numbered."""
    def numbered(ordering, names):
        top = df.orderBy(*ordering).limit(n)
        w = Window.orderBy(*ordering)
        return top.select(F.row_number().over(w).alias("rank"), F.col(tie).alias(names[0]),
                          F.col(value).alias(names[1]))

    high = numbered([F.desc(value), F.col(tie)], ("top", "top_value"))
    low = numbered([F.col(value), F.col(tie)], ("bottom", "bottom_value"))
    return high.join(low, "rank")


@query("o1_top_and_bottom", f"""
WITH {TF}, v AS (SELECT term, sum(tf)::BIGINT AS n FROM tf GROUP BY term),
a AS (SELECT row_number() OVER (ORDER BY n DESC, term) AS rank, term AS top, n AS top_value FROM v),
b AS (SELECT row_number() OVER (ORDER BY n, term) AS rank, term AS bottom, n AS bottom_value FROM v)
SELECT rank::INTEGER AS rank, top, top_value, bottom, bottom_value FROM a JOIN b USING (rank)
WHERE rank <= 20""")
def o1(spark, sf):
    return top_and_bottom(vocab_of(spark, sf), "n", "term", 20)


@query("u1_append", """
SELECT 'documents' AS origin, doc_id AS id, text FROM documents
UNION ALL SELECT 'benchmark', item_id, text FROM benchmark""")
def u1(spark, sf):
    a = docs(spark, sf).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    b = table(spark, sf, "benchmark").select(
        F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), "text")
    return a.unionByName(b)


def _terms(spark, sf, name):
    return T.unnest(table(spark, sf, name), [], T.word_tokens(F.col("text")), "term")


@query("u2_vocabulary_sets", f"""
WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{K.WORD_2PLUS}')) AS term FROM documents),
b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{K.WORD_2PLUS}')) AS term FROM conversations)
SELECT 'union' AS op, term FROM (SELECT term FROM a UNION SELECT term FROM b)
UNION ALL SELECT 'intersect', term FROM (SELECT term FROM a INTERSECT SELECT term FROM b)""")
def u2(spark, sf):
    a, b = _terms(spark, sf, "documents"), _terms(spark, sf, "conversations")
    both = a.union(b).distinct().select(F.lit("union").alias("op"), "term")
    return both.unionByName(a.intersect(b).select(F.lit("intersect").alias("op"), "term"))


@query("j1_lookup", f"""
WITH {PRUNED} SELECT doc_id, count(*) AS n_terms, count(df) AS n_known,
  sum(CASE WHEN df IS NULL THEN 0 ELSE tf END)::BIGINT AS known_words
FROM tf LEFT JOIN pruned USING (term) GROUP BY doc_id""")
def j1(spark, sf):
    tf = term_counts(spark, sf)
    v = pruned_vocabulary(spark, sf, tf)
    j = tf.join(F.broadcast(v), "term", "left")  # the vocabulary has at most 5000 rows
    return j.groupBy("doc_id").agg(
        F.count("*").alias("n_terms"), F.count("df").alias("n_known"),
        F.sum(F.when(F.col("df").isNull(), 0).otherwise(F.col("tf"))).alias("known_words"))


@query("j2_semi_anti", f"""
WITH {PRUNED}, stops AS (SELECT unnest({sql_list(K.STOPWORDS['en'])}) AS term)
SELECT term, sum(tf)::BIGINT AS n FROM tf SEMI JOIN pruned USING (term) ANTI JOIN stops USING (term)
GROUP BY term""")
def j2(spark, sf):
    tf = term_counts(spark, sf)
    v = pruned_vocabulary(spark, sf, tf)
    stops = spark.createDataFrame([(w,) for w in K.STOPWORDS["en"]], "term string")
    n = tf.groupBy("term").agg(F.sum("tf").alias("n"))
    kept = n.join(F.broadcast(v), "term", "left_semi")  # the vocabulary has at most 5000 rows
    return kept.join(F.broadcast(stops), "term", "left_anti")


@query("j3_pair_counts", """
WITH p AS (SELECT a.conv_id, count(*) AS n_pairs FROM conversations a JOIN conversations b
  ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY a.conv_id)
SELECT conv_id, count(*) AS n, coalesce(max(n_pairs), 0) AS n_pairs
FROM conversations LEFT JOIN p USING (conv_id) GROUP BY conv_id""")
def j3(spark, sf):
    return pairs.pair_counts(items(spark, sf), "conv_id", "item")


@query("j4_labelled_pairs", f"""
WITH {GOLD} SELECT a.conv_id, a.level AS winner, b.level AS loser, count(*) AS n_pairs
FROM gold a JOIN gold b ON a.conv_id = b.conv_id AND a.level > b.level GROUP BY ALL""")
def j4(spark, sf):
    return pairs.labelled_pair_counts(gold(spark, sf), "conv_id", "level")


# Listed predictions: each turn against the next one, the longer text is said to win.
PREDICTED = PAIRS + """, predicted AS (SELECT p.conv_id, p.a, p.b,
    CASE WHEN hash_a >= hash_b THEN 1 ELSE 0 END AS label FROM pairs p
  JOIN (SELECT conv_id, turn AS a, md5(text) AS hash_a FROM conversations) USING (conv_id, a)
  JOIN (SELECT conv_id, turn AS b, md5(text) AS hash_b FROM conversations) USING (conv_id, b))"""


def predicted_pairs(spark, sf):
    """Adjacent turns with an arbitrary but repeatable verdict: the larger text hash wins."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.md5("text").alias("h"))
    p = adjacent_pairs(spark, sf)
    p = p.join(c.select("conv_id", F.col("turn").alias("a"), F.col("h").alias("ha")),
               ["conv_id", "a"])
    p = p.join(c.select("conv_id", F.col("turn").alias("b"), F.col("h").alias("hb")),
               ["conv_id", "b"])
    label = F.when(F.col("ha") >= F.col("hb"), 1).otherwise(0)
    return p.select("conv_id", "a", "b", label.alias("label"))


@query("j5_gold_pairs", f"""
WITH {GOLD}, {PREDICTED}, g AS (
  SELECT a.conv_id, a.item AS a, b.item AS b, CASE WHEN a.level > b.level THEN 1 ELSE 0 END AS label
  FROM gold a JOIN gold b ON a.conv_id = b.conv_id AND a.level <> b.level)
SELECT conv_id, a, b, g.label FROM predicted JOIN g USING (conv_id, a, b)""")
def j5(spark, sf):
    """Gold verdict of each listed pair: two look-ups, never the product of the class lists."""
    g = gold(spark, sf).select("conv_id", "item", "level")
    p = predicted_pairs(spark, sf).drop("label")
    p = p.join(g.withColumnsRenamed({"item": "a", "level": "la"}), ["conv_id", "a"])
    p = p.join(g.withColumnsRenamed({"item": "b", "level": "lb"}), ["conv_id", "b"])
    verdict = F.when(F.col("la") > F.col("lb"), 1).otherwise(0)
    return p.filter("la <> lb").select("conv_id", "a", "b", verdict.alias("label"))


VEC_SPLIT = f"""e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label,
  {_u('knn', 'vec_id')} < 0.3 AS is_test FROM embeddings)"""


def split_vectors(spark, sf):
    e = table(spark, sf, "embeddings").withColumnRenamed("embedding", "vec")
    s = split.random_split(e, "vec_id", 0.3, "knn")
    return s.filter("split = 'train'"), s.filter("split = 'test'")


@query("j6_distance_summary", f"""
WITH {VEC_SPLIT}, d AS (SELECT a.vec_id, list_distance(a.v, b.v) AS d FROM e a, e b
  WHERE a.is_test AND NOT b.is_test)
SELECT vec_id AS query_id, round(min(d), 4) AS least, round(avg(d), 4) AS mean,
  round(max(d), 4) AS most FROM d GROUP BY vec_id""")
def j6(spark, sf):
    train, test = split_vectors(spark, sf)
    s = blocks.distance_summary(test.select(F.col("vec_id").alias("query_id"), "vec"),
                                train.select(F.col("vec_id").alias("base_id"), "vec"))
    return s.select("query_id", *[F.round(c, 4).alias(c) for c in ("least", "mean", "most")])


@query("j7_zip_by_position", """
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS position FROM labels),
b AS (SELECT lang, row_number() OVER (ORDER BY doc_id) AS position
  FROM documents SEMI JOIN labels USING (doc_id))
SELECT position, doc_id, lang FROM a JOIN b USING (position)""")
def j7(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id")
    d = docs(spark, sf).join(lab, "doc_id", "left_semi").select(
        F.col("doc_id").alias("other_id"), "lang")
    return readers.zip_by_position(lab, d, ["doc_id"], ["other_id"]).drop("other_id")


@query("m20_tournament", f"""
WITH {GOLD}, w AS (SELECT a.conv_id, CASE WHEN (a.score, a.item) > (b.score, b.item)
    THEN a.item ELSE b.item END AS item FROM gold a JOIN gold b
  ON a.conv_id = b.conv_id AND a.item < b.item)
SELECT conv_id, item, coalesce(n, 0) AS wins FROM gold
LEFT JOIN (SELECT conv_id, item, count(*) AS n FROM w GROUP BY ALL) USING (conv_id, item)""")
def m20(spark, sf):
    return pairs.tournament(items(spark, sf), "conv_id", "score", "item").select(
        "conv_id", "item", "wins")


@query("m21_symmetric_scores", f"""
WITH {PAIRS}, x AS (SELECT conv_id, a, b, {_u('p', "conv_id || '|' || a || '|' || b")} AS p FROM pairs
  UNION ALL SELECT conv_id, b, a, {_u('p', "conv_id || '|' || b || '|' || a")} FROM pairs)
SELECT conv_id, least(a, b) AS a, greatest(a, b) AS b, round(avg(p), 6) AS p FROM x
GROUP BY conv_id, least(a, b), greatest(a, b)""")
def m21(spark, sf):
    both = split.symmetric_pairs(adjacent_pairs(spark, sf), "a", "b")
    scored = both.withColumn("p", order.uniform("conv_id", "a", "b", seed="p"))
    return pairs.symmetric_scores(scored, ["conv_id"], "a", "b", "p").withColumn(
        "p", F.round("p", 6))
