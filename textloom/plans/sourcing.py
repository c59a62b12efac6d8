"""Source, sink, selection and sampling queries (S-*, F-*)."""

import uuid

from pyspark.sql import functions as F

from textloom.functions import clean
from textloom.functions import tokens as T
from textloom.operators import order, select
from textloom.plans.registry import query, table, words
from textloom.plans.tokenizing import DIM, LEXICON, TF, TOK, docs
from textloom.session import shared_dir
from textloom.sources import readers, writers


def scratch(spark, name):
    """New folder under the session's shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s1_class_folders", """
SELECT source || '/' || doc_id || '.txt' AS path, text,
  CASE source WHEN 'src0' THEN 'real' WHEN 'src1' THEN 'fake' ELSE 'other' END AS label
FROM documents""")
def s1(spark, sf):
    d = docs(spark, sf).withColumn("path", F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")))
    label = readers.folder_label(F.concat(F.lit("/"), "path"), {"src0": "real", "src1": "fake"})
    return d.select("path", "text", F.coalesce(label, F.lit("other")).alias("label"))


@query("s2_skip_header", r"""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10))[2:],
  lambda x: regexp_replace(x, '\s+\z', '')), lambda x: x <> ''), ' ') AS body FROM documents""")
def s2(spark, sf):
    return docs(spark, sf).select("doc_id", clean.skip_first_line(F.col("text")).alias("body"))


# Documents hold no blank line, so the break after the first line is doubled.
@query("s3_mail_body", r"""
WITH m AS (SELECT doc_id, regexp_replace(text, '\n', chr(10) || chr(10)) AS t FROM documents)
SELECT doc_id, CASE WHEN instr(t, chr(10) || chr(10)) > 0
  THEN substr(t, instr(t, chr(10) || chr(10)) + 2) ELSE '' END AS body FROM m""")
def s3(spark, sf):
    mail = F.regexp_replace("text", r"^([^\n]*)\n", "$1\n\n")
    return docs(spark, sf).select("doc_id", clean.mail_body(mail).alias("body"))


@query("s4_name_label", """
SELECT doc_id, CASE WHEN contains(source, '1') THEN 1 WHEN contains(source, '2') THEN -1 ELSE 0 END
  AS label FROM documents""")
def s4(spark, sf):
    return docs(spark, sf).select(
        "doc_id", readers.name_label(F.col("source"), [("1", 1), ("2", -1)]).alias("label"))


# Targets are the labels table written as one sorted list; texts are the labelled documents.
@query("s5_targets_by_position", """
SELECT doc_id, n_chars, quality::DOUBLE AS target FROM documents JOIN labels USING (doc_id)""")
def s5(spark, sf):
    lab = table(spark, sf, "labels")
    d = docs(spark, sf).join(lab.select("doc_id"), "doc_id", "left_semi")
    y = lab.select(F.col("doc_id").alias("y_id"), F.col("quality").cast("double").alias("target"))
    z = readers.zip_by_position(d.select("doc_id", "n_chars"), y, ["doc_id"], ["y_id"])
    return z.select("doc_id", "n_chars", "target")


# Annotated files are built from the corpus: one token per line, a blank line between sentences.
@query("s6_annotated_tokens", r"""
WITH s AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS sentence_id, l FROM (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
t AS (SELECT doc_id, sentence_id, unnest(list_filter(string_split(l[sentence_id], ' '),
  lambda x: x <> '')) AS raw FROM s)
SELECT doc_id, sentence_id, lower(raw) AS lemma, count(*) AS n FROM t GROUP BY ALL""")
def s6(spark, sf):
    tsv = annotated_lines(F.col("text"))
    d = docs(spark, sf).select("doc_id", tsv.alias("file"))
    t = T.unnest(d, ["doc_id"], readers.parse_annotated(F.col("file")), "t")
    return t.groupBy("doc_id", "t.sentence_id", "t.lemma").agg(F.count("*").alias("n"))


# The same sources as files: written to the shared folder and read back by the readers. Where a file
# is a document, the benchmark's items are the documents, so that there are few files.
@query("s1_read_class_folders", r"""
SELECT CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS label, array_to_string(list_filter(
  list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s+\z', '')), lambda x: x <> ''), ' ')
  AS text FROM benchmark""")
def s1_read(spark, sf):
    path = scratch(spark, "folders")
    kind = F.when(F.pmod("item_id", F.lit(2)) == 0, "a").otherwise("b")
    b = table(spark, sf, "benchmark").select(
        kind.alias("kind"), F.concat(F.lit("Title\n"), "text").alias("value"))
    b.write.option("maxRecordsPerFile", 1).partitionBy("kind").text(path)
    read = readers.read_class_folders(spark, path, {"kind=a": "even", "kind=b": "odd"})
    return read.select("label", "text")


@query("s5_read_targets", """
SELECT item_id, text, item_id * 1.5::DOUBLE AS target FROM benchmark""")
def s5_read(spark, sf):
    texts, target = scratch(spark, "texts"), scratch(spark, "targets")
    b = table(spark, sf, "benchmark").withColumn("name", F.lpad(F.col("item_id").cast("string"), 12, "0"))
    b.select("name", F.col("text").alias("value")).write.partitionBy("name").text(texts)
    y = b.repartitionByRange(4, "name").sortWithinPartitions("name")
    y.select((F.col("item_id") * 1.5).cast("string").alias("value")).write.text(target)
    read = readers.read_with_targets(spark, f"{texts}/*", target)
    item = F.regexp_extract("path", "name=([0-9]+)/", 1).cast("long")
    return read.select(item.alias("item_id"), F.regexp_replace("text", r"\n\z", "").alias("text"), "target")


def annotated_lines(text):
    """A document in the annotated form: a token a line, a blank line after every sentence (line)."""
    def sentence(line):
        toks = F.filter(F.split(line, " "), lambda t: t != "")
        return F.array_join(F.transform(toks, lambda t, i: F.concat_ws(
            "\t", (i + 1).cast("string"), t, F.lower(t), F.lit("X"))), "\n")

    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(
        x.rlike("[^ ]"), F.concat(sentence(x), F.lit("\n"))).otherwise("")), "\n")


@query("s6_read_annotated", r"""
WITH s AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, l FROM (
  SELECT doc_id, string_split(regexp_replace(text, '[\t\r]', ' ', 'g'), chr(10)) AS l FROM documents)),
t AS (SELECT doc_id, i, unnest(list_filter(string_split(l[i], ' '), lambda x: x <> '')) AS raw FROM s)
SELECT lower(raw) AS lemma, count(*) AS n_tokens, count(DISTINCT (doc_id, i)) AS n_sentences FROM t GROUP BY ALL""")
def s6_read(spark, sf):
    path = scratch(spark, "annotated")
    text = F.regexp_replace("text", r"[\t\r]", " ")
    docs(spark, sf).select(annotated_lines(text).alias("value")).write.text(path)
    return readers.lemma_counts(readers.annotated_ranges(spark, path))


@query("s8_read_groups", r"""
SELECT source AS grp, doc_id::VARCHAR AS id, regexp_replace(text, '[\t\r\n]+', ' ', 'g') AS text, quality AS label
FROM documents JOIN labels USING (doc_id)""")
def s8_read(spark, sf):
    path = scratch(spark, "groups")
    d = _flat(docs(spark, sf).join(table(spark, sf, "labels"), "doc_id"))
    writers.write_groups(d.select("source", "doc_id", "text", "quality"), "source", path)
    return readers.read_groups(spark, f"{path}/*.tsv").select("grp", "id", "text", "label")


_FLAT = r"regexp_replace(text, '[\t\r\n]+', ' ', 'g')"


def _flat(df):
    return df.withColumn("text", F.regexp_replace("text", r"[\t\r\n]+", " "))


@query("s7_tsv_header", f"SELECT conv_id, turn, role, {_FLAT} AS text FROM conversations")
def s7(spark, sf):
    path = scratch(spark, "tsv")
    _flat(table(spark, sf, "conversations")).write.csv(
        path, sep="\t", header=True, quote="", escapeQuotes=False)
    return readers.read_tsv(spark, path, "conv_id long, turn long, role string, text string")


@query("s8_group_files", f"""
SELECT source AS grp, doc_id::VARCHAR AS id, {_FLAT} AS text, quality AS label
FROM documents JOIN labels USING (doc_id)""")
def s8(spark, sf):
    path = scratch(spark, "groups")
    d = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    rows = _flat(d).select("source", "doc_id", "text", "quality")
    rows.write.partitionBy("source").csv(path, sep="\t", quote="", escapeQuotes=False)
    read = readers.read_tsv(spark, f"{path}/*", "id string, text string, label int", header=False)
    grp = F.regexp_extract(F.col("_metadata.file_path"), r"source=([^/]+)/", 1)
    return read.withColumn("grp", grp)


@query("s9_labelled_lines", f"""
SELECT doc_id, lang AS label, len({words(_FLAT)}) AS n_tokens,
  array_to_string({words(_FLAT)}, ' ') AS tokens FROM documents""")
def s9(spark, sf):
    d = _flat(docs(spark, sf)).select("doc_id", F.concat_ws("\t", "lang", "text").alias("line"))
    p = d.select("doc_id", readers.parse_labelled_line(F.col("line")).alias("p"))
    return p.select("doc_id", "p.label", F.size("p.tokens").cast("long").alias("n_tokens"),
                    F.array_join("p.tokens", " ").alias("tokens"))


@query("s10_prefixed_lines", f"""
SELECT doc_id, lang || ',' || source AS labels, array_to_string({words('text')}, ' ') AS words
FROM documents""")
def s10(spark, sf):
    pre = readers.LABEL_PREFIX
    line = F.concat(F.lit(pre), "lang", F.lit(f" {pre}"), "source", F.lit(" "), "text")
    p = docs(spark, sf).select("doc_id", readers.parse_prefixed_line(line).alias("p"))
    return p.select("doc_id", F.array_join("p.labels", ",").alias("labels"),
                    F.array_join("p.words", " ").alias("words"))


@query("s11_vector_text", """
SELECT 'word ' || vec_id AS word, round(list_sum(embedding::DOUBLE[]), 3) + 0.0 AS total,
  round(embedding[1]::DOUBLE, 8) + 0.0 AS first FROM embeddings""")
def s11(spark, sf):
    path = scratch(spark, "vec")
    e = table(spark, sf, "embeddings")
    e.select(F.concat(F.lit("word "), "vec_id", F.lit(" "), F.array_join(
        F.transform("embedding", lambda x: x.cast("string")), " ")).alias("value")).write.text(path)
    v = readers.read_vectors(spark, path, DIM)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return v.select("word", F.round(total, 3).alias("total"),
                    F.round(F.col("vec")[0].cast("double"), 8).alias("first"))


@query("s12_records", r"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<article(?:\s[^>]*)?>(.*?)</article>',
    1) AS bodies FROM pages),
r AS (SELECT page_id, i AS record, bodies[i + 1] AS body FROM (
  SELECT page_id, bodies, unnest(range(len(bodies)))::INTEGER AS i FROM a)),
c AS (SELECT page_id, record, unnest(list_concat(
    list_transform(regexp_extract_all(body, '(?is)<h1(?:\s[^>]*)?>(.*?)</h1>', 1), lambda x:
      'to_' || regexp_replace(regexp_replace(x, '<[^<]+?>', '', 'g'), '^\s+|\s+\z', '', 'g')),
    list_transform(regexp_extract_all(body, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1), lambda x:
      'pl_' || regexp_replace(regexp_replace(x, '<[^<]+?>', '', 'g'), '^\s+|\s+\z', '', 'g'))))
  AS category FROM r)
SELECT page_id, record, category, count(*) AS n FROM c GROUP BY ALL""")
def s12(spark, sf):
    r = readers.read_records(table(spark, sf, "pages"), "html", "article",
                             {"to_": "h1", "pl_": "p"}, ["page_id"])
    c = r.select("page_id", "record", F.explode("categories").alias("category"))
    return c.groupBy("page_id", "record", "category").agg(F.count("*").alias("n"))


@query("s13_write_predictions", """
SELECT doc_id, CASE WHEN n_chars >= 1000 THEN 'joke' ELSE 'mix' END AS label FROM documents""")
def s13(spark, sf):
    path = scratch(spark, "predictions")
    p = docs(spark, sf).withColumn(
        "label", F.when(F.col("n_chars") >= 1000, "joke").otherwise("mix"))
    writers.write_predictions(p, path, "doc_id", "label", sort=True)
    return spark.read.csv(path, header=True, schema="doc_id long, label string")


@query("s14_stage_cache", f"""
WITH {TOK} SELECT doc_id, count(*) AS n_tokens FROM tok GROUP BY doc_id""")
def s14(spark, sf):
    from textloom.plans.tokenizing import corpus_tokens

    folder = scratch(spark, "stage")
    build = lambda: corpus_tokens(spark, sf).groupBy("doc_id").agg(
        F.count("*").alias("n_tokens"))
    writers.cached(spark, folder, "tokens", {"min_length": 2}, build)
    return writers.cached(spark, folder, "tokens", {"min_length": 2}, build)


@query("s15_export_lines", f"""
SELECT array_to_string({words(r"regexp_replace(lower(text), '[!-/:-@\[-`{-~]', ' ', 'g')")}, ' ')
  AS value FROM documents""")
def s15(spark, sf):
    path = scratch(spark, "lines")
    cleaned = F.array_join(clean.words(F.regexp_replace(
        F.lower("text"), r"[!-/:-@\[-`{-~]", " ")), " ")
    writers.export_lines(docs(spark, sf).select(cleaned.alias("text")), "text", path)
    return spark.read.text(path)


@query("f1_min_chars", "SELECT doc_id, n_chars FROM documents WHERE length(text) >= 1000")
def f1(spark, sf):
    return select.min_chars(docs(spark, sf)).select("doc_id", "n_chars")


@query("f2_word_range", f"""
SELECT doc_id, len({words('text')}) AS n_words FROM documents
WHERE len({words('text')}) > 50 AND len({words('text')}) < 1000""")
def f2(spark, sf):
    kept = select.word_range(docs(spark, sf))
    return kept.select("doc_id", F.size(clean.words(F.col("text"))).cast("long").alias("n_words"))


_LETTERS_ONLY = r"regexp_replace(text, '[^\p{L}]+', ' ', 'g')"


@query("f3_drop_empty", rf"""
SELECT doc_id, lang FROM documents WHERE regexp_matches({_LETTERS_ONLY}, '\S')""")
def f3(spark, sf):
    d = docs(spark, sf).withColumn("text", F.regexp_replace("text", r"[^\p{L}]+", " "))
    return select.drop_empty(d).select("doc_id", "lang")


@query("f4_require_class_size", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def f4(spark, sf):
    return select.require_class_size(docs(spark, sf), "lang", 5)


@query("f5_drop_nulls", """
SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id)""")
def f5(spark, sf):
    d = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", "source", "quality", "toxic").dropna()


@query("f6_balance", """
WITH c AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM documents GROUP BY lang)),
r AS (SELECT doc_id, lang, row_number() OVER (
  PARTITION BY lang ORDER BY md5(doc_id || '|balance'), doc_id) AS k FROM documents)
SELECT doc_id, lang FROM r, c WHERE k <= m""")
def f6(spark, sf):
    return select.balance(docs(spark, sf).select("doc_id", "lang"), "lang", "doc_id", "balance")


@query("f7_permute", """
SELECT doc_id, md5(doc_id || '|7') AS key FROM documents""")
def f7(spark, sf):
    d = docs(spark, sf).select("doc_id", order.shuffle_key("doc_id", seed=7).alias("key"))
    return select.permute(d, "doc_id", 7)


@query("f8_class_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def f8(spark, sf):
    return select.class_counts(docs(spark, sf), "source").orderBy(F.desc("n"), "source")


@query("f9_corpus_size", """
SELECT count(*) AS n_docs, sum(len(string_split(text, ' ')))::BIGINT AS n_words FROM documents""")
def f9(spark, sf):
    return select.corpus_size(docs(spark, sf))


@query("f10_joint_vocabulary", f"""
WITH t AS (SELECT text FROM documents UNION ALL SELECT text FROM conversations
  UNION ALL SELECT text FROM benchmark)
SELECT DISTINCT unnest({words('lower(text)')}) AS term FROM t""")
def f10(spark, sf):
    names = ["documents", "conversations", "benchmark"]
    return select.joint_vocabulary([table(spark, sf, n) for n in names])


# Curation: corpus words carry a compound marker before the listed suffixes.
_MARKED = LEXICON + """, marked AS (
  SELECT form AS raw, arg_min(lemma || '#' || substr(form, length(lemma) + 1), analysis) AS lemma
  FROM lexicon GROUP BY form)"""


@query("c19_curate_lemmas", f"""
WITH {_MARKED}, {TF[len(TOK) + 2:]}, list AS (
  SELECT raw, CASE WHEN length(raw) % 2 = 0 THEN 'NULL' ELSE split_part(lemma, '#', 1) END AS repl
  FROM marked)
SELECT term AS raw, replace(CASE WHEN length(term) > 1 AND contains(coalesce(lemma, term), '#')
    THEN coalesce(nullif(repl, 'NULL'), term) ELSE coalesce(lemma, term) END, '#', '') AS lemma,
  sum(tf)::BIGINT AS n
FROM tf LEFT JOIN marked ON marked.raw = term LEFT JOIN list ON list.raw = term GROUP BY ALL""")
def c19(spark, sf):
    from textloom.operators import curate
    from textloom.plans.tokenizing import term_counts

    m = marked(spark, sf)
    listed = m.select("raw", F.when(F.length("raw") % 2 == 0, "NULL").otherwise(
        F.split_part("lemma", F.lit("#"), F.lit(1))).alias("replacement"))
    n = term_counts(spark, sf).groupBy(F.col("term").alias("raw")).agg(F.sum("tf").alias("n"))
    t = n.join(m, "raw", "left").withColumn("lemma", F.coalesce("lemma", "raw"))
    return curate.apply_list(t, listed).select("raw", "lemma", "n")


def marked(spark, sf):
    from textloom.plans.tokenizing import lexicon, vocab_of

    lex = lexicon(vocab_of(spark, sf))
    joined = F.expr("concat(lemma, '#', substr(form, length(lemma) + 1))")
    return lex.groupBy(F.col("form").alias("raw")).agg(F.min_by(joined, "analysis").alias("lemma"))


@query("c20_curation_list", f"""
WITH {_MARKED} SELECT raw, lemma, 'NULL' AS replacement FROM marked WHERE contains(lemma, '#')""")
def c20(spark, sf):
    from textloom.operators import curate

    return curate.build_list(marked(spark, sf))
