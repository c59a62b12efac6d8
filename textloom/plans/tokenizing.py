"""Token, annotation and vocabulary queries (T-*)."""

from pyspark.sql import functions as F

from textloom.functions import clean
from textloom.functions import constants as K
from textloom.functions import snowball
from textloom.functions import tokens as T
from textloom.operators import annotate as A

from textloom.operators import order
from textloom.operators import stem
from textloom.operators.joins import hot_lookup, hottest
from textloom.operators.terms import TermBlocks
from textloom.plans.registry import STOP_CASE, TF, TOK, dealt, lit, query, sql_list, table, words
from textloom.session import stage

DIM = 64

SENT = f"""sent AS (
  SELECT doc_id, i AS sentence_id, s[i] AS sentence FROM (
    SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
      SELECT doc_id, string_split(regexp_replace(text, '{K.SENTENCE_END}', '\\1' || chr(1), 'g'),
        chr(1)) AS s FROM documents)))"""

_PIECE = f"regexp_extract_all(p, '{K.WORD_OR_PUNCT}')"
ANN = SENT + f""", ann AS (
  SELECT doc_id, sentence_id,
    flatten(list_transform(string_split(sentence, ' '), lambda p: {_PIECE})) AS toks,
    flatten(list_transform(string_split(sentence, ' '), lambda p:
      list_transform({_PIECE}, lambda t, j: CASE WHEN j > 1 THEN '1' ELSE '0' END))) AS glue
  FROM sent), toks AS (SELECT * FROM ann WHERE len(toks) > 0)"""


def docs(spark, sf):
    return table(spark, sf, "documents")


def corpus_tokens(spark, sf):
    """Lower-cased corpus words of two or more characters with their places."""
    return T.unnest(docs(spark, sf), ["doc_id"], T.word_tokens(F.col("text")), "term", "pos")


def term_counts(spark, sf):
    """(doc_id, term, tf); texts are dealt by document, so that counting shuffles no words."""
    d = dealt(spark, sf, "documents", "text")
    t = T.unnest(d, ["doc_id"], T.word_tokens(F.col("text")), "term")
    return t.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def term_blocks(spark, sf, words=None):
    """The documents' words (of `corpus_tokens`, unless given) in blocks."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return TermBlocks(d, T.word_tokens(F.col("text")) if words is None else words)


def _sentences(spark, sf):
    return A.sentence_arrays(docs(spark, sf), ["doc_id"])


def _flags(test):
    return F.array_join(
        F.transform("tokens", lambda t: F.when(test(t["token"]), "1").otherwise("0")), "")


def _flag_sql(test):
    return f"array_to_string(list_transform(toks, lambda t: CASE WHEN {test} THEN '1' ELSE '0' END), '')"


IS_EOS = f"list_contains({sql_list(K.EOS_PUNCT)}, t)"
IS_PUNCT = f"regexp_matches(t, {lit(K.ASCII_PUNCT_ONLY)})"
IS_NUMBER = f"regexp_matches(t, {lit(K.FLOAT_LITERAL)})"


@query("t1_annotate", f"""
WITH {ANN} SELECT doc_id, sentence_id, array_to_string(toks, ' ') AS tokens,
  len(toks) AS n_tokens, {_flag_sql(IS_EOS)} AS eos_punct, {_flag_sql(IS_PUNCT)} AS punct,
  {_flag_sql(IS_NUMBER)} AS number, array_to_string(glue, '') AS glued FROM toks""")
def t1(spark, sf):
    return _sentences(spark, sf).select(
        "doc_id", "sentence_id",
        F.array_join(F.transform("tokens", lambda t: t["token"]), " ").alias("tokens"),
        F.size("tokens").cast("long").alias("n_tokens"),
        _flags(T.is_eos_punct).alias("eos_punct"), _flags(T.is_punct).alias("punct"),
        _flags(T.is_number).alias("number"),
        F.array_join(F.transform("tokens", lambda t: F.when(t["glued"], "1").otherwise("0")), "")
        .alias("glued"))


def _flag_counts(spark, sf, flag):
    t = A.annotate(docs(spark, sf), ["doc_id"])
    return t.groupBy("doc_id").agg(
        F.sum(F.col(flag).cast("long")).alias("n_flagged"), F.count("*").alias("n_tokens"))


def _flag_count_sql(test):
    return f"""WITH {ANN}, x AS (SELECT doc_id, unnest(toks) AS t FROM toks)
SELECT doc_id, sum(CASE WHEN {test} THEN 1 ELSE 0 END)::BIGINT AS n_flagged,
  count(*) AS n_tokens FROM x GROUP BY doc_id"""


@query("t1a_eos_punct", _flag_count_sql(IS_EOS))
def t1a(spark, sf):
    return _flag_counts(spark, sf, "is_eos_punct")


@query("t1b_punct", _flag_count_sql(IS_PUNCT))
def t1b(spark, sf):
    return _flag_counts(spark, sf, "is_punct")


@query("t1c_number", _flag_count_sql(IS_NUMBER))
def t1c(spark, sf):
    return _flag_counts(spark, sf, "is_number")


@query("t1d_eos_token", f"""
WITH {ANN} SELECT doc_id, sentence_id, len(toks) AS pos, toks[-1] AS token FROM toks""")
def t1d(spark, sf):
    t = A.annotate(docs(spark, sf), ["doc_id"]).filter("is_eos_token")
    return t.select("doc_id", "sentence_id", "pos", F.col("raw").alias("token"))


@query("t1e_rebuild", f"""
WITH {ANN}, r AS (SELECT doc_id, sentence_id, array_to_string(list_transform(toks, lambda t, i:
    CASE WHEN i = 1 OR glue[i] = '1' THEN t ELSE ' ' || t END), '') AS rebuilt,
  len(list_filter(glue, lambda g: g = '1')) AS n_glued FROM toks)
SELECT doc_id, sentence_id, rebuilt, n_glued, rebuilt = sentence AS same
FROM r JOIN sent USING (doc_id, sentence_id)""")
def t1e(spark, sf):
    rebuilt = A.rebuild(F.col("tokens"))
    return _sentences(spark, sf).select(
        "doc_id", "sentence_id", rebuilt.alias("rebuilt"),
        F.size(F.filter("tokens", lambda t: t["glued"])).cast("long").alias("n_glued"),
        (rebuilt == F.col("sentence")).alias("same"))


@query("t2_sentences", f"WITH {SENT} SELECT doc_id, sentence_id, sentence FROM sent")
def t2(spark, sf):
    return A.sentences(docs(spark, sf), ["doc_id"])


@query("t3_word_tokens", f"""
WITH {SENT} SELECT doc_id, sentence_id, array_to_string(w, ' ') AS words, len(w) AS n_words
FROM (SELECT doc_id, sentence_id, regexp_extract_all(sentence, '{K.WORD_2PLUS}') AS w FROM sent)
WHERE len(w) > 0""")
def t3(spark, sf):
    s = A.sentences(docs(spark, sf), ["doc_id"])
    w = s.withColumn("w", T.word_tokens(F.col("sentence"), lower=False)).filter(F.col("sentence").rlike(K.WORD_2PLUS))
    return w.select("doc_id", "sentence_id", F.array_join("w", " ").alias("words"),
                    F.size("w").cast("long").alias("n_words"))


# A small suffix lexicon is read off the corpus vocabulary: a word that ends in a listed suffix and
# whose rest is a word too is analysed as that rest, with the part of speech the suffix implies.
SUFFIXES = [("ing", "VERB"), ("ed", "VERB"), ("ly", "ADV"), ("tion", "NOUN"), ("er", "ADJ"),
            ("en", "VERB"), ("es", "NOUN"), ("s", "NOUN")]
VOCAB = TOK + ", vocab AS (SELECT term, count(*) AS n FROM tok GROUP BY term)"
LEXICON = VOCAB + f""", suffixes AS (
  SELECT * FROM (VALUES {", ".join(f"({i}, '{s}', '{p}')" for i, (s, p) in enumerate(SUFFIXES))})
    AS s(analysis, suffix, upos)),
lexicon AS (
  SELECT v.term AS form, b.term AS lemma, s.upos, s.analysis FROM vocab v JOIN suffixes s
    ON ends_with(v.term, s.suffix) JOIN vocab b
    ON b.term = substr(v.term, 1, length(v.term) - length(s.suffix)))"""


def lexicon(vocab):
    """(form, lemma, upos, analysis) rows: each listed suffix whose rest is a known word."""
    listed = F.array(*[
        F.struct(F.lit(i).alias("analysis"), F.lit(s).alias("suffix"), F.lit(p).alias("upos"))
        for i, (s, p) in enumerate(SUFFIXES)])
    cut = vocab.select(F.col("term").alias("form"), F.inline(
        F.filter(listed, lambda s: F.endswith(F.col("term"), s["suffix"]))))
    cut = cut.withColumn("lemma", F.expr("substr(form, 1, length(form) - length(suffix))"))
    known = vocab.select(F.col("term").alias("lemma"))
    return cut.join(known, "lemma").select("form", "lemma", "upos", "analysis")


def vocab_of(spark, sf):
    return A.vocabulary(corpus_tokens(spark, sf))


def word_vectors(spark, sf):
    """Word vectors for the corpus: the n-th most frequent word takes the n-th embedding row."""
    numbered = order.ranked(vocab_of(spark, sf), [], [F.desc("n"), F.col("term")], "r")
    numbered = numbered.select(F.col("term").alias("word"), (F.col("r") - 1).alias("vec_id"))
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return numbered.join(e, "vec_id").select("word", "vec")


WV = VOCAB + """, wv AS (
  SELECT term AS word, embedding::DOUBLE[] AS vec FROM (
    SELECT term, row_number() OVER (ORDER BY n DESC, term) - 1 AS vec_id FROM vocab)
  JOIN embeddings USING (vec_id))"""


@query("t4_letter_tokens", LEXICON.join(["WITH ", f""", w AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), {lit(K.LETTERS_APOSTROPHE)})) AS term, lang
  FROM documents), kept AS (
  SELECT doc_id, term FROM w WHERE NOT list_contains({sql_list(K.STOPWORDS['en'])}, term)),
first AS (SELECT form, arg_min(lemma, analysis) AS lemma FROM lexicon GROUP BY form)
SELECT doc_id, coalesce(lemma, term) AS lemma, count(*) AS n FROM kept
LEFT JOIN first ON form = term GROUP BY ALL"""]))
def t4(spark, sf):
    found = T.find_all(F.lower("text"), K.LETTERS_APOSTROPHE)
    kept = term_blocks(spark, sf, F.filter(found, lambda x: ~clean.is_stopword(x)))
    first = A.first_analysis(lexicon(stage(vocab_of(spark, sf))))
    return kept.renamed(first.withColumnRenamed("form", "term"), "lemma")


@query("t5_min_length", f"""
SELECT doc_id, array_to_string(list_filter({words('lower(text)')}, lambda x: length(x) >= 2
  AND NOT list_contains({STOP_CASE}, x)), ' ') AS lowered,
  array_to_string(list_filter({words('text')}, lambda x: length(x) >= 2), ' ') AS cased
FROM documents""")
def t5(spark, sf):
    def kept(column, more=None):
        def test(x):
            ok = F.length(x) >= 2
            return ok & ~clean.is_stopword(x, F.col("lang")) if more else ok
        return F.array_join(F.filter(clean.words(column), test), " ")

    return docs(spark, sf).select(
        "doc_id", kept(F.lower("text"), True).alias("lowered"), kept(F.col("text")).alias("cased"))


def _terms_by_document(spark, sf, words):
    """(doc_id, lang, term, tf). Texts are dealt by document, so that counting shuffles them and not
    their words."""
    d = docs(spark, sf).select("doc_id", "lang", "text").repartition("doc_id")
    return T.unnest(d, ["doc_id", "lang"], words, "term").groupBy("doc_id", "lang", "term").agg(
        F.count("*").alias("tf"))


@query("t6_stemmed_terms")
def t6(spark, sf):
    kept = F.filter(clean.words(F.lower("text")), lambda x: ~clean.is_stopword(x))
    t = term_blocks(spark, sf, kept)
    s = stem.stems(t.terms)
    s = s.filter(F.col("stem").rlike("^[a-zA-Z]+") & (F.length("stem") >= 3))
    return t.renamed(s, "stem", "drop", "tf")


@query("t7_stopword_flag", f"""
WITH {ANN}, x AS (SELECT doc_id, unnest(toks) AS t FROM toks),
j AS (SELECT doc_id, t, {STOP_CASE} AS stops FROM x JOIN documents USING (doc_id))
SELECT doc_id, count(*) FILTER (list_contains(stops, t)) AS as_written,
  count(*) FILTER (list_contains(stops, lower(t))) AS lowered FROM j GROUP BY doc_id""")
def t7(spark, sf):
    t = A.annotate(docs(spark, sf), ["doc_id", "lang"])
    flag = lambda c: F.count(F.when(clean.is_stopword(c, F.col("lang")), 1))
    return t.groupBy("doc_id").agg(
        flag(F.col("raw")).alias("as_written"), flag(F.col("token")).alias("lowered"))


@query("t8_stem")
def t8(spark, sf):
    return stem.stems(vocab_of(spark, sf))


_BY_LANG = f"""bl AS (SELECT DISTINCT lang, unnest(regexp_extract_all(lower(text), '{K.WORD_2PLUS}')) AS term
  FROM documents), st AS (SELECT lang, term, {snowball.text('term', 'lang', snowball.Duck())} AS stem FROM bl)"""


@query("t8_snowball", f"WITH {_BY_LANG} SELECT lang, term, stem FROM st")
def t8_snowball(spark, sf):
    return stem.snowball_stems(T.unnest(docs(spark, sf), ["lang"], T.word_tokens(F.col("text")), "term"))


@query("t6_snowball_terms", f"""
WITH {_BY_LANG}, tf AS (SELECT doc_id, lang, term, count(*) AS tf FROM (
  SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '{K.WORD_2PLUS}')) AS term FROM documents)
  WHERE NOT list_contains({STOP_CASE}, term) GROUP BY ALL)
SELECT doc_id, stem, sum(tf)::BIGINT AS tf FROM tf JOIN st USING (lang, term)
WHERE length(stem) >= 3 GROUP BY ALL""")
def t6_snowball(spark, sf):
    """Lower-case words without the language's stop words, stemmed, stems of three letters or more."""
    t = _terms_by_document(spark, sf, T.word_tokens(F.col("text")))
    t = t.filter(~clean.is_stopword(F.col("term"), F.col("lang")))
    s = stem.snowball_tokens(t).filter(F.length("stem") >= 3)
    return s.groupBy("doc_id", "stem").agg(F.sum("tf").alias("tf"))


CHOSEN = LEXICON + WV[len(VOCAB):] + """, scored AS (
  SELECT form, lemma, analysis, coalesce(round(list_dot_product(a.vec, b.vec)
    / sqrt(list_dot_product(a.vec, a.vec)) / sqrt(list_dot_product(b.vec, b.vec)), 6), 0.0) + 0.0 AS score
  FROM lexicon LEFT JOIN wv a ON a.word = form LEFT JOIN wv b ON b.word = lemma),
chosen AS (SELECT form, lemma, score FROM scored
  QUALIFY row_number() OVER (PARTITION BY form ORDER BY score DESC, analysis DESC) = 1)"""


@query("t9_lemmatise", f"WITH {CHOSEN} SELECT form, lemma, score FROM chosen")
def t9(spark, sf):
    return A.choose_lemma(lexicon(vocab_of(spark, sf)), word_vectors(spark, sf), DIM)


@query("t10_in_dictionary", f"""
WITH {LEXICON}, {TF[len(TOK) + 2:]}, forms AS (SELECT DISTINCT form FROM lexicon)
SELECT doc_id, sum(CASE WHEN form IS NULL THEN 0 ELSE tf END)::BIGINT AS in_dictionary,
  sum(tf)::BIGINT AS n_tokens FROM tf LEFT JOIN forms ON form = term GROUP BY doc_id""")
def t10(spark, sf):
    t = term_blocks(spark, sf)
    forms = lexicon(stage(t.vocabulary())).select(F.col("form").alias("term")).distinct()
    n = t.renamed(forms.withColumn("known", F.lit("yes")), "known", "", "tf")
    return n.groupBy("doc_id").agg(F.sum(F.when(F.col("known") == "yes", F.col("tf")).otherwise(0))
                                   .alias("in_dictionary"), F.sum("tf").alias("n_tokens"))


POS = """first AS (SELECT form, arg_min(upos, analysis) AS upos FROM lexicon GROUP BY form)"""


@query("t11_pos_tags", f"""
WITH {LEXICON}, {TF[len(TOK) + 2:]}, {POS}
SELECT doc_id, coalesce(upos, '') AS upos, sum(tf)::BIGINT AS n
FROM tf LEFT JOIN first ON form = term GROUP BY ALL""")
def t11(spark, sf):
    t = term_blocks(spark, sf)
    first = A.first_analysis(lexicon(stage(t.vocabulary())))
    return t.renamed(first.withColumnRenamed("form", "term"), "upos", "")


@query("t12_pos_set", f"WITH {LEXICON}, {POS} SELECT DISTINCT upos FROM first WHERE upos <> ''")
def t12(spark, sf):
    first = A.first_analysis(lexicon(vocab_of(spark, sf)))
    return first.filter("upos <> ''").select("upos").distinct()


@query("t13_lower_tokens", f"""
WITH {ANN}, x AS (SELECT doc_id, unnest(toks) AS raw FROM toks)
SELECT raw, lower(raw) AS token, count(*) AS n FROM x GROUP BY ALL""")
def t13(spark, sf):
    t = A.annotate(docs(spark, sf), ["doc_id"])
    return t.groupBy("raw", "token").agg(F.count("*").alias("n"))


NUM_WORDS, MAX_LENGTH = 20000, 30
INDEX = VOCAB + f""", idx AS (
  SELECT term, n, row_number() OVER (ORDER BY n DESC, term) AS idx FROM vocab
  ORDER BY n DESC, term LIMIT {NUM_WORDS})"""
SEQ = INDEX + f""", pos AS (
  SELECT doc_id, w[i] AS term, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(lower(text), '{K.WORD_2PLUS}') AS w FROM documents))),
seq AS (SELECT doc_id, list(idx ORDER BY i) AS ids FROM pos JOIN idx USING (term) GROUP BY doc_id)"""


@query("t14_vocabulary_index", f"""
WITH {SEQ} SELECT doc_id, array_to_string(ids, ' ') AS ids, len(ids) AS n_ids FROM seq""")
def t14(spark, sf):
    t = corpus_tokens(spark, sf)
    seq = A.to_sequences(t, A.index_vocabulary(A.vocabulary(t), NUM_WORDS), ["doc_id"],
                         NUM_WORDS)
    return seq.select("doc_id", F.array_join("ids", " ").alias("ids"),
                      F.size("ids").cast("long").alias("n_ids"))


@query("t15_pad_sequences", f"""
WITH {SEQ} SELECT doc_id, array_to_string(list_concat(
    list_transform(range(greatest({MAX_LENGTH} - len(ids), 0)), lambda x: 0),
    CASE WHEN len(ids) > {MAX_LENGTH} THEN ids[-{MAX_LENGTH}:] ELSE ids END), ' ') AS padded
FROM seq""")
def t15(spark, sf):
    t = corpus_tokens(spark, sf)
    seq = A.to_sequences(t, A.index_vocabulary(A.vocabulary(t), NUM_WORDS), ["doc_id"],
                         NUM_WORDS)
    return seq.select("doc_id", F.array_join(T.pad_left(F.col("ids"), MAX_LENGTH), " ")
                      .alias("padded"))


MAX_WORD, WIDTH = 8, 240


@query("t16_char_ids", rf"""
WITH w AS (SELECT conv_id, turn, list_transform(string_split(array_to_string(list_filter(
    {words('lower(text)')}, lambda x: NOT regexp_matches(x, '^(\.?@|http|#)')), ' '), ' '),
  lambda w: list_transform(list_filter(string_split(w, ''), lambda c: c <> ''), lambda c:
    CASE WHEN instr({lit(K.CHAR_ALPHABET)}, c) > 0 THEN instr({lit(K.CHAR_ALPHABET)}, c)
    ELSE {K.OTHER_CHAR_ID} END)[1:{MAX_WORD}]) AS ws FROM conversations),
z AS (SELECT conv_id, turn, flatten(list_transform(ws, lambda w: list_concat(
    list_transform(range(({MAX_WORD} - len(w)) // 2), lambda x: 0), w,
    list_transform(range({MAX_WORD} - len(w) - ({MAX_WORD} - len(w)) // 2), lambda x: 0)))) AS ids
  FROM w)
SELECT conv_id, turn, array_to_string(list_concat(ids, list_transform(range({WIDTH}),
  lambda x: 0))[1:{WIDTH}], ' ') AS ids FROM z""")
def t16(spark, sf):
    c = table(spark, sf, "conversations")
    text = clean.clean_social(F.lower("text"))
    return c.select("conv_id", "turn",
                    F.array_join(T.char_ids(text, MAX_WORD, WIDTH), " ").alias("ids"))


def _grams_sql(word, low, high):
    return f"""flatten(list_transform(range({low}, {high + 1}), lambda n: list_transform(
      range(1, greatest(length({word}) - n + 2, 1)), lambda i: substr({word}, i, n))))"""


SUBWORDS = VOCAB + f""", sub AS (
  SELECT term, unnest({_grams_sql("'<' || term || '>'", 3, 6)}) AS gram FROM vocab)"""


@query("t17_subwords", f"""
WITH {SUBWORDS} SELECT gram, count(*) AS n FROM sub GROUP BY gram""")
def t17(spark, sf):
    v = corpus_tokens(spark, sf).select("term").distinct()
    g = T.unnest(v, [], T.subwords(F.col("term")), "gram")
    return g.groupBy("gram").agg(F.count("*").alias("n"))


def _fnv_sql(word):
    return f"""list_reduce(list_transform(string_split({word}, ''), lambda c: unicode(c)::BIGINT),
      lambda h, c: (xor(h, c) * {K.FNV_PRIME}) & 4294967295, {K.FNV_OFFSET}::BIGINT)"""


@query("t18_fnv_hash", f"""
WITH {VOCAB} SELECT term, {_fnv_sql('term')} AS hash,
  {_fnv_sql('term')} % {K.HASH_BUCKETS} AS bucket FROM vocab""")
def t18(spark, sf):
    v = corpus_tokens(spark, sf).select("term").distinct()
    h = v.withColumn("hash", T.fnv1a(F.col("term")))
    return h.withColumn("bucket", F.col("hash") % K.HASH_BUCKETS)


_U64 = f"(CASE WHEN {{h}} >= 2147483648 THEN 18446744069414584320::HUGEINT ELSE 0 END + {{h}})"
_STEP = f"(({{a}}) * {K.NGRAM_PRIME}::HUGEINT + {_U64}) % 18446744073709551616::HUGEINT"
_BI = _STEP.format(a=_U64.format(h="h1"), h="h2")
_TRI = _STEP.format(a=_BI, h="h3")


@query("t19_word_ngram_ids", f"""
WITH {VOCAB}, hashed AS (SELECT term, {_fnv_sql('term')} AS h FROM vocab),
pos AS (SELECT doc_id, w[i] AS term, i FROM (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(lower(text), '{K.WORD_2PLUS}') AS w FROM documents))),
runs AS (SELECT doc_id, h AS h1, lead(h) OVER p AS h2, lead(h, 2) OVER p AS h3
  FROM pos JOIN hashed USING (term) WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
ids AS (SELECT doc_id, ({_BI}) % {K.HASH_BUCKETS} AS id FROM runs WHERE h2 IS NOT NULL
  UNION ALL SELECT doc_id, ({_TRI}) % {K.HASH_BUCKETS} FROM runs WHERE h3 IS NOT NULL)
SELECT doc_id, count(*) AS n_ids, sum(id)::BIGINT AS id_sum, max(id)::BIGINT AS id_max
FROM ids GROUP BY doc_id""")
def t19(spark, sf):
    t = docs(spark, sf).select("doc_id", T.word_tokens(F.col("text")).alias("w"))
    h = t.select("doc_id", F.transform("w", T.fnv1a).alias("h"))
    ids = T.unnest(h, ["doc_id"], T.word_ngram_ids(F.col("h"), 3), "id")
    return ids.groupBy("doc_id").agg(
        F.count("*").alias("n_ids"), F.sum("id").alias("id_sum"), F.max("id").alias("id_max"))


@query("t20_min_count", f"""
WITH entries AS (
  SELECT 'word' AS kind, unnest(regexp_extract_all(lower(text), '{K.WORD_2PLUS}')) AS entry
  FROM documents UNION ALL SELECT 'label', '__label__' || source FROM documents)
SELECT kind, entry, count(*) AS n FROM entries GROUP BY ALL
HAVING count(*) >= CASE kind WHEN 'word' THEN 5 ELSE 40 END""")
def t20(spark, sf):
    d = docs(spark, sf)
    w = corpus_tokens(spark, sf).select(F.lit("word").alias("kind"), F.col("term").alias("entry"))
    lab = d.select(F.lit("label").alias("kind"), F.concat(F.lit("__label__"), "source")
                   .alias("entry"))
    n = w.unionByName(lab).groupBy("kind", "entry").agg(F.count("*").alias("n"))
    return n.filter(F.col("n") >= F.when(F.col("kind") == "word", 5).otherwise(40))


THRESHOLD = 1e-3


@query("t21_subsample", f"""
WITH {TF}, v AS (SELECT term, sum(tf)::DOUBLE AS n FROM tf GROUP BY term),
p AS (SELECT term, sqrt({THRESHOLD}::DOUBLE / (n / (SELECT sum(n) FROM v)))
  + {THRESHOLD}::DOUBLE / (n / (SELECT sum(n) FROM v)) AS keep FROM v),
u AS (SELECT doc_id, term, tf, keep, ('0x' || substr(md5(doc_id || '|' || term || '|0'), 1, 8))
  ::BIGINT / 4294967296.0::DOUBLE AS u FROM tf JOIN p USING (term))
SELECT doc_id, count(*) AS n_terms, count(*) FILTER (u <= keep) AS n_kept,
  round(avg(least(keep, 1.0::DOUBLE)), 6) AS mean_keep FROM u GROUP BY doc_id""")
def t21(spark, sf):
    tf = term_counts(spark, sf)
    v = tf.groupBy("term").agg(F.sum("tf").cast("double").alias("n"))
    total = v.agg(F.sum("n")).scalar()
    p = v.select("term", A.keep_probability(F.col("n"), total, F.lit(THRESHOLD)).alias("keep"))
    met = hot_lookup(tf, p, "term", ["keep"], hottest(v, "term", "n"), ["doc_id"])
    u = met.withColumn("u", order.uniform("doc_id", "term", seed=0))
    return u.groupBy("doc_id").agg(
        F.count("*").alias("n_terms"), F.count(F.when(F.col("u") <= F.col("keep"), 1))
        .alias("n_kept"),
        F.round(F.avg(F.least(F.col("keep"), F.lit(1.0))), 6).alias("mean_keep"))
