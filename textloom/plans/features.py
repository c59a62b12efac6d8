"""Counting, weighting and split queries (V-*, R-*)."""

from pyspark.ml.feature import StringIndexer
from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import constants as K
from textloom.functions import tokens as T
from textloom.operators import annotate as A
from textloom.operators import split as R
from textloom.operators import weights as V
from textloom.operators.joins import hot_lookup, hottest_in
from textloom.plans.registry import TF, TOK, dealt, query, sql_list, table
from textloom.plans.tokenizing import (
    ANN, DIM, IS_PUNCT, LEXICON, POS, SENT, docs, lexicon, term_blocks, term_counts,
    vocab_of)

N_DOCS = "(SELECT count(*) FROM documents)"


def n_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").agg(F.count("*")).scalar()


# Word n-grams of a sentence: positions are numbered and runs are joined.
_SENT_WORDS = SENT + f""", sw AS (
  SELECT doc_id, sentence_id, regexp_extract_all(lower(sentence), '{K.WORD_2PLUS}') AS w FROM sent),
gram AS (SELECT doc_id, w[i:i + n - 1] AS g FROM (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM sw), (VALUES (1), (2)) AS ns(n)
  WHERE i + n - 1 <= len(w))"""


def _sentence_words(spark, sf):
    s = A.sentences(dealt(spark, sf, "documents", "text"), ["doc_id"])
    return s.select("doc_id", T.word_tokens(F.col("sentence")).alias("tokens"))


@query("v1_sentence_ngrams", f"""
WITH {_SENT_WORDS} SELECT doc_id, array_to_string(g, ' ') AS term, count(*) AS tf
FROM gram GROUP BY ALL""")
def v1(spark, sf):
    return V.term_counts(V.sentence_ngrams(_sentence_words(spark, sf), ["doc_id"], 2), ["doc_id"])


@query("v2_stop_ngrams", f"""
WITH {_SENT_WORDS} SELECT doc_id, array_to_string(g, ' ') AS term, count(*) AS tf
FROM gram WHERE NOT list_has_any(g, {sql_list(K.STOPWORDS['en'])}) GROUP BY ALL""")
def v2(spark, sf):
    g = V.sentence_ngrams(_sentence_words(spark, sf), ["doc_id"], 2, stopwords=K.STOPWORDS["en"])
    return V.term_counts(g, ["doc_id"])


@query("v3_rebuild_sentences", f"""
WITH {ANN} SELECT doc_id, sentence_id, array_to_string(toks, ' ') AS raw,
  lower(array_to_string(toks, ' ')) AS lemmas FROM toks""")
def v3(spark, sf):
    """Sentences with one number of one document are put together; their tokens never travel alone."""
    t = A.sentence_arrays(dealt(spark, sf, "documents", "text"), ["doc_id"])
    each = F.transform("tokens", lambda t, i: F.struct(
        (i + 1).cast("long").alias("pos"), t["token"].alias("raw"), F.lower(t["token"]).alias("token")))
    s = t.filter(F.size("tokens") > 0).groupBy("doc_id", "sentence_id").agg(
        F.array_sort(F.flatten(F.collect_list(each))).alias("t"))
    return s.select("doc_id", "sentence_id",
                    F.array_join("t.raw", " ").alias("raw"),
                    F.array_join("t.token", " ").alias("lemmas"))


@query("v4_term_counts", f"WITH {TF} SELECT doc_id, term, tf FROM tf")
def v4(spark, sf):
    return term_counts(spark, sf)


PRUNED = TF + f""", pruned AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM tf GROUP BY term
  HAVING count(*) >= 0.0025 * {N_DOCS} AND count(*) <= 0.7 * {N_DOCS}
  ORDER BY n DESC, term LIMIT 5000)"""


def pruned_vocabulary(spark, sf, tf, max_features=5000):
    return V.vocabulary(tf, n_docs(spark, sf), 0.0025, 0.7, max_features)


@query("v5_pruned_vocabulary", f"WITH {PRUNED} SELECT term, df, n FROM pruned")
def v5(spark, sf):
    return pruned_vocabulary(spark, sf, term_counts(spark, sf))


@query("v6_binary_counts", f"""
WITH {TF} SELECT term, sum(1)::BIGINT AS df FROM tf GROUP BY term""")
def v6(spark, sf):
    return V.presence(term_counts(spark, sf)).groupBy("term").agg(F.sum("tf").alias("df"))


@query("v7_char_ngrams", f"""
WITH c AS (SELECT doc_id, unnest(list_zip(string_split(lower(text), ''),
    string_split(lower(text), '')[2:], string_split(lower(text), '')[3:],
    string_split(lower(text), '')[4:], string_split(lower(text), '')[5:])) AS z FROM documents),
g AS (SELECT doc_id, unnest([z[1] || z[2], z[1] || z[2] || z[3], z[1] || z[2] || z[3] || z[4],
    z[1] || z[2] || z[3] || z[4] || z[5]]) AS gram FROM c)
SELECT gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY gram
ORDER BY n DESC, gram LIMIT 3000""")
def v7(spark, sf):
    w = T.unnest(docs(spark, sf), [], T.char_windows(F.lower("text"), 5), "window")
    return V.prefix_counts(w, "window", 2, "gram").orderBy(F.desc("n"), "gram").limit(3000)


IDF = TF + f""", idf AS (SELECT term, count(*) AS df,
  1 + ln((1 + {N_DOCS}) / (1.0::DOUBLE + count(*))) AS idf FROM tf GROUP BY term),
tfidf AS (SELECT doc_id, term, tf, tf * idf / sqrt(sum(tf * idf * tf * idf)
  OVER (PARTITION BY doc_id)) AS weight FROM tf JOIN idf USING (term))"""


def tfidf(spark, sf):
    t = term_blocks(spark, sf)
    return t.weigh(V.idf_of(t.vocabulary(), n_docs(spark, sf)))


def _rounded(df):
    return df.withColumn("weight", F.round("weight", 6))


@query("v8_tfidf_smooth", f"WITH {IDF} SELECT doc_id, term, tf, round(weight, 6) AS weight FROM tfidf")
def v8(spark, sf):
    return _rounded(tfidf(spark, sf))


@query("v9_tfidf_log10", f"""
WITH {TF}, idf AS (SELECT term, log10({N_DOCS} / count(*)::DOUBLE) AS idf FROM tf GROUP BY term)
SELECT doc_id, term, tf, round(tf * idf, 6) AS weight FROM tf JOIN idf USING (term)""")
def v9(spark, sf):
    t = term_blocks(spark, sf)
    idf = V.idf_of(t.vocabulary(), n_docs(spark, sf), lambda df, n: F.log10(n / df.cast("double")))
    return _rounded(t.weigh(idf, normalize=False))


@query("v10_sublinear_tf", f"""
WITH {IDF}, w AS (SELECT doc_id, term, tf, (1 + ln(tf)) * idf AS x FROM tf JOIN idf USING (term))
SELECT doc_id, term, tf, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight
FROM w""")
def v10(spark, sf):
    t = term_blocks(spark, sf)
    return _rounded(t.weigh(V.idf_of(t.vocabulary(), n_docs(spark, sf)), sublinear=True))


@query("v11_apply_model", f"""
WITH {IDF}, b AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '{K.WORD_2PLUS}')) AS term
  FROM benchmark), btf AS (SELECT item_id, term, count(*) AS tf FROM b GROUP BY ALL),
w AS (SELECT item_id, term, tf, tf * idf AS x FROM btf JOIN idf USING (term))
SELECT item_id, term, tf, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS weight
FROM w""")
def v11(spark, sf):
    model = V.idf_table(term_counts(spark, sf), n_docs(spark, sf))
    new = T.unnest(table(spark, sf, "benchmark"), ["item_id"], T.word_tokens(F.col("text")), "term")
    return _rounded(V.weigh(V.term_counts(new, ["item_id"]), model, key="item_id"))


@query("v12_order_weights", f"""
WITH {PRUNED}, t AS (SELECT doc_id, len(w) AS n, i, w[i] AS term FROM (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(lower(text), '{K.WORD_2PLUS}') AS w FROM documents)))
SELECT doc_id, term, round(sum(pow(0.99::DOUBLE, n - i)), 6) AS weight
FROM t SEMI JOIN pruned USING (term) GROUP BY ALL""")
def v12(spark, sf):
    d = docs(spark, sf).select("doc_id", T.word_tokens(F.col("text")).alias("tokens"))
    vocab = pruned_vocabulary(spark, sf, term_counts(spark, sf))
    w = V.order_weights(d, "doc_id", "tokens", vocab=F.broadcast(vocab))  # at most 5000 rows
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


UPOS = ["VERB", "NOUN", "ADV", "ADJ", "PROPN"]
_FEATURES = f"""
WITH {LEXICON}, {TF[len(TOK) + 2:]}, {POS}, t AS (
  SELECT doc_id, tf, upos, CASE WHEN regexp_matches(term, '^[0-9]+\\z') THEN tf ELSE 0 END AS num
  FROM tf LEFT JOIN first ON form = term)
SELECT doc_id, sum(tf)::BIGINT AS n_words, round(sum(num) / sum(tf)::DOUBLE, 6) AS share_number,
  round(sum(CASE WHEN upos IS NULL THEN 0 ELSE tf END) / sum(tf)::DOUBLE, 6) AS share_dictionary,
  {", ".join(f"round(sum(CASE WHEN upos = '{u}' THEN tf ELSE 0 END) / sum(tf)::DOUBLE, 6) AS share_{u}" for u in UPOS)}
FROM t GROUP BY doc_id"""


def document_features(spark, sf):
    """Shares of numbers, dictionary words and parts of speech, and the word count."""
    first = A.first_analysis(lexicon(vocab_of(spark, sf)))
    t = term_counts(spark, sf).withColumnRenamed("term", "form")
    t = A.lookup(t, first, "form", ["upos"])
    share = lambda test: F.round(
        F.sum(F.when(test, F.col("tf")).otherwise(0)) / F.sum("tf"), 6)
    return t.groupBy("doc_id").agg(
        F.sum("tf").alias("n_words"),
        share(F.col("form").rlike(r"^[0-9]+\z")).alias("share_number"),
        share(F.col("upos").isNotNull()).alias("share_dictionary"),
        *[share(F.col("upos") == u).alias(f"share_{u}") for u in UPOS])


@query("v13_document_features", _FEATURES)
def v13(spark, sf):
    return document_features(spark, sf)


@query("v14_drop_zero_columns", f"SELECT * EXCLUDE (share_PROPN) FROM ({_FEATURES})")
def v14(spark, sf):
    return V.drop_zero_columns(document_features(spark, sf), [f"share_{u}" for u in UPOS])


CUSTOM = ["n_words", "share_number", "share_dictionary", *[f"share_{u}" for u in UPOS]]


@query("v15_concatenate_features", f"""
WITH {IDF}, custom AS ({_FEATURES})
SELECT doc_id, 'word:' || term AS feature, round(weight, 6) AS value FROM tfidf
""" + "".join(f"UNION ALL SELECT doc_id, '{c}', {c}::DOUBLE FROM custom\n" for c in CUSTOM))
def v15(spark, sf):
    words = _rounded(tfidf(spark, sf)).select(
        "doc_id", F.concat(F.lit("word:"), "term").alias("feature"), F.col("weight").alias("value"))
    custom = document_features(spark, sf).withColumn("n_words", F.col("n_words").cast("double"))
    return words.unionByName(custom.unpivot("doc_id", CUSTOM, "feature", "value"))


@query("v16_style_features", f"""
WITH {ANN}, x AS (SELECT doc_id, unnest(toks) AS t FROM toks),
{IDF}, s AS (SELECT doc_id, round(min(idf), 6) AS min_idf, round(sum(idf * tf) / sum(tf), 6)
  AS mean_idf, round(max(idf), 6) AS max_idf FROM tf JOIN idf USING (term) GROUP BY doc_id),
p AS (SELECT doc_id, round(avg(CASE WHEN regexp_matches(t, '^\\p{{Lu}}') THEN 1.0::DOUBLE ELSE 0 END), 6)
    AS capitalised, round(avg(CASE WHEN {IS_PUNCT} THEN 1.0::DOUBLE ELSE 0 END), 6) AS punctuation,
  count(*) FILTER (contains(t, '.')) AS n_stop, count(*) FILTER (contains(t, ',')) AS n_comma
  FROM x GROUP BY doc_id)
SELECT * FROM p LEFT JOIN s USING (doc_id)""")
def v16(spark, sf):
    t = A.annotate(docs(spark, sf), ["doc_id"])
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    p = t.groupBy("doc_id").agg(
        F.round(F.avg(one(F.col("raw").rlike(r"^\p{Lu}"))), 6).alias("capitalised"),
        F.round(F.avg(one(F.col("is_punct"))), 6).alias("punctuation"),
        F.count(F.when(F.col("raw").contains("."), 1)).alias("n_stop"),
        F.count(F.when(F.col("raw").contains(","), 1)).alias("n_comma"))
    tf = term_counts(spark, sf)
    idf = V.idf_table(tf, n_docs(spark, sf))
    met = hot_lookup(tf, idf, "term", ["idf"], hottest_in(tf, "term"), ["doc_id"])
    s = met.groupBy("doc_id").agg(
        F.round(F.min("idf"), 6).alias("min_idf"),
        F.round(F.sum(F.col("idf") * F.col("tf")) / F.sum("tf"), 6).alias("mean_idf"),
        F.round(F.max("idf"), 6).alias("max_idf"))
    return p.join(s, "doc_id", "left")


def categories(spark, sf):
    """Multi-label rows: language, source and, where labelled, toxicity."""
    d = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", F.array_compact(F.array(
        "lang", "source", F.when(F.col("toxic") == 1, "toxic"))).alias("categories"))


CATS = """cats AS (SELECT doc_id, list_filter([lang, source, CASE WHEN toxic = 1 THEN 'toxic' END],
  lambda x: x IS NOT NULL) AS categories FROM documents LEFT JOIN labels USING (doc_id))"""
SELECTED = ["en", "fr", "src0", "src1", "toxic"]


@query("v17_binarise", f"""
WITH {CATS} SELECT doc_id, {", ".join(
    f"list_contains(categories, '{c}')::INTEGER AS is_{c}" for c in SELECTED)} FROM cats""")
def v17(spark, sf):
    return V.binarise(categories(spark, sf), "categories", SELECTED).drop("categories")


@query("v18_category_counts", f"""
WITH {CATS}, c AS (SELECT unnest(categories) AS category FROM cats)
SELECT category, count(*) AS n FROM c GROUP BY category ORDER BY n DESC, category LIMIT 20""")
def v18(spark, sf):
    c = categories(spark, sf).select(F.explode("categories").alias("category"))
    return c.groupBy("category").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "category").limit(20)


@query("v19_label_encoding", """
WITH l AS (SELECT doc_id, source, dense_rank() OVER (ORDER BY source) - 1 AS idx FROM documents)
SELECT doc_id, source, idx, repeat('0', idx) || '1'
  || repeat('0', (SELECT max(idx) FROM l) - idx) AS one_hot FROM l""")
def v19(spark, sf):
    d = docs(spark, sf).select("doc_id", "source")
    model = StringIndexer(inputCol="source", outputCol="i", stringOrderType="alphabetAsc").fit(d)
    k = len(model.labels)
    out = model.transform(d).withColumn("idx", F.col("i").cast("long"))
    hot = F.concat(F.repeat(F.lit("0"), F.col("i").cast("int")), F.lit("1"),
                   F.repeat(F.lit("0"), (k - 1 - F.col("i")).cast("int")))
    return out.select("doc_id", "source", "idx", hot.alias("one_hot"))


@query("v22_standardise", """
WITH x AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS v FROM (
  SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)),
m AS (SELECT i, avg(v) AS mean, stddev_pop(v) AS dev FROM x GROUP BY i)
SELECT vec_id, i AS dim, round((v - mean) / dev, 4) + 0.0 AS value FROM x JOIN m USING (i)""")
def v22(spark, sf):
    s = V.standardise(table(spark, sf, "embeddings"), "embedding", DIM)
    s = s.select("vec_id", F.posexplode("scaled").alias("dim", "value"))
    return s.select("vec_id", F.col("dim").cast("long").alias("dim"),
                    F.round("value", 4).alias("value"))


def _u(seed, key="doc_id"):
    return f"(('0x' || substr(md5({key} || '|{seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("r1_random_split", f"""
SELECT doc_id, CASE WHEN {_u(13)} < 0.33 THEN 'test' ELSE 'train' END AS split FROM documents""")
def r1(spark, sf):
    return R.random_split(docs(spark, sf).select("doc_id"), "doc_id", 0.33, 13)


_RANKED = """r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang
  ORDER BY md5(doc_id || '|666'), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)"""


@query("r2_stratified_split", f"""
WITH {_RANKED} SELECT doc_id, lang, CASE WHEN k <= floor(0.7::DOUBLE * n) THEN 'train'
  ELSE 'test' END AS split FROM r""")
def r2(spark, sf):
    return R.stratified_split(docs(spark, sf).select("doc_id", "lang"), "lang", "doc_id", 0.7, 666)


@query("r3_stratified_folds",
       f"WITH {_RANKED} SELECT doc_id, lang, ((k - 1) % 5)::INTEGER AS fold FROM r")
def r3(spark, sf):
    return R.stratified_folds(docs(spark, sf).select("doc_id", "lang"), "lang", "doc_id", 5, 666)


@query("r4_contiguous_folds", """
SELECT doc_id, (ntile(7) OVER (ORDER BY doc_id) - 1)::INTEGER AS fold FROM documents""")
def r4(spark, sf):
    return R.contiguous_folds(docs(spark, sf).select("doc_id"), [F.col("doc_id")], 7)


@query("r5_group_folds", """
WITH g AS (SELECT source, ((row_number() OVER (ORDER BY source) - 1) % 5)::INTEGER AS fold
  FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, source, fold FROM documents JOIN g USING (source)""")
def r5(spark, sf):
    return R.group_folds(docs(spark, sf).select("doc_id", "source"), "source", 5)


@query("r6_positional_split", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n
  FROM documents)
SELECT doc_id, CASE WHEN k <= floor(0.6::DOUBLE * n) THEN 'train'
  WHEN k <= floor(0.6::DOUBLE * n) + floor(0.5 * floor(0.6::DOUBLE * n)) THEN 'valid'
  ELSE 'test' END AS split FROM r""")
def r6(spark, sf):
    return R.positional_split(docs(spark, sf).select("doc_id"), [F.col("doc_id")])


PAIRS = """turns AS (SELECT conv_id, turn AS a, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn)
  AS b FROM conversations), pairs AS (SELECT conv_id, a, b FROM turns WHERE b IS NOT NULL)"""


def adjacent_pairs(spark, sf):
    """Each turn with the next turn of its conversation, over any gap in the turn numbers."""
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("a"))
    following = F.lead("a").over(Window.partitionBy("conv_id").orderBy("a"))
    return c.withColumn("b", following).filter("b IS NOT NULL")


@query("r8_symmetric_pairs", f"""
WITH {PAIRS} SELECT conv_id, a, b FROM pairs UNION ALL SELECT conv_id, b, a FROM pairs""")
def r8(spark, sf):
    return R.symmetric_pairs(adjacent_pairs(spark, sf), "a", "b")


@query("r9_prior_weights", """
SELECT doc_id, quality, CASE quality WHEN 1 THEN 0.472 ELSE 1.309 END::DOUBLE AS weight FROM labels""")
def r9(spark, sf):
    return R.prior_weights(table(spark, sf, "labels").select("doc_id", "quality"), "quality",
                           {1: 0.472, 0: 1.309})
