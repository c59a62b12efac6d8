"""Cleaning queries (C-*)."""

from pyspark.sql import functions as F

from textloom.functions import clean
from textloom.functions import constants as K
from textloom.functions import tokens
from textloom.plans.registry import (
    STOP_CASE, lit, query, rewrite, sql_list, table, words)


def _docs(spark, sf, **columns):
    d = table(spark, sf, "documents")
    return d.select("doc_id", *[fn(F.col("text")).alias(n) for n, fn in columns.items()])


def _pages(spark, sf, **columns):
    d = table(spark, sf, "pages")
    return d.select("page_id", *[fn(F.col("html")).alias(n) for n, fn in columns.items()])


STRIP = r"regexp_replace(x, '^\s+|\s+\z', '', 'g')"
SPECIAL = "array_to_string(list_filter(list_transform({words}, lambda x: regexp_replace(x, {p}, '', 'g')), lambda x: x <> ''), ' ')"
UNESCAPE_BASIC = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def special(expr):
    return SPECIAL.format(words=words(expr), p=lit(K.ASCII_PUNCT))


def unescape(expr, entities=K.ENTITIES):
    for name, text in entities:
        expr = f"replace({expr}, {lit(name)}, {lit(text)})"
    return expr


@query("c1_lower_split", rf"""
SELECT doc_id, array_to_string(list_transform(string_split(lower(text), ' '),
       lambda x: {STRIP}), '|') AS tokens FROM documents""")
def c1(spark, sf):
    return _docs(spark, sf, tokens=lambda t: F.array_join(clean.lower_split(t), "|"))


@query("c2_remove_special", f"SELECT doc_id, {special('text')} AS cleaned FROM documents")
def c2(spark, sf):
    return _docs(spark, sf, cleaned=clean.remove_special_characters)


def no_stops(expr):
    return f"array_to_string(list_filter({words(expr)}, lambda x: NOT list_contains({STOP_CASE}, x)), ' ')"


@query("c3_remove_stopwords", f"SELECT doc_id, {no_stops('text')} AS cleaned FROM documents")
def c3(spark, sf):
    return _docs(spark, sf, cleaned=lambda t: clean.remove_stopwords(t, F.col("lang")))


# The corpus is turned into contractions ("is" to "it's") so that there is something to expand.
CONTRACTED = [(r"\bis\b", "It's"), (r"\bnot\b", "don't"), (r"\bthat\b", "CAN'T've")]
_MAP = ("map(" + sql_list(K.CONTRACTIONS) + ", " + sql_list(K.CONTRACTIONS.values()) + ")")
EXPANDED = f"""replace(list_reduce(list_transform(
    range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(
      CASE WHEN found[i][1:1] = '''' THEN {_MAP}[lower(found[i])]
        ELSE found[i][1:1] || substr({_MAP}[lower(found[i])], 2) END, '')), lambda a, b: a || b), '''', '')"""
CONTRACT_CTE = f"""c AS (SELECT doc_id, lang, {rewrite('text', CONTRACTED)} AS body FROM documents),
p AS (SELECT doc_id, lang, regexp_split_to_array(body, {lit(K.CONTRACTION_PATTERN)}) AS gaps,
      regexp_extract_all(body, {lit(K.CONTRACTION_PATTERN)}) AS found FROM c),
e AS (SELECT doc_id, lang, {EXPANDED} AS body FROM p)"""


def _contracted(text):
    return clean._rewrite(text, CONTRACTED)


@query("c4_expand_contractions",
       f"WITH {CONTRACT_CTE} SELECT doc_id, body AS cleaned FROM e")
def c4(spark, sf):
    return _docs(spark, sf, cleaned=lambda t: clean.expand_contractions(_contracted(t)))


@query("c5_normalize_corpus", f"""
WITH {CONTRACT_CTE}, s AS (SELECT doc_id, lang, {special('body')} AS body FROM e)
SELECT doc_id, {no_stops('body')} AS cleaned, len({words(no_stops('body'))}) AS n_tokens FROM s""")
def c5(spark, sf):
    done = table(spark, sf, "documents").select(
        "doc_id", clean.normalize(_contracted(F.col("text")), F.col("lang")).alias("cleaned"))
    return done.withColumn("n_tokens", F.size(clean.words(F.col("cleaned"))).cast("long"))


_HTML = unescape(rewrite("html", [(r"(?s)<!--.*?-->", ""), (r"<[^>]*>", "")]))
HTML_WORDS = words(f"lower(regexp_replace({_HTML}, '[^a-zA-Z]', ' ', 'g'))")


@query("c6_html_words",
       f"SELECT page_id, array_to_string({HTML_WORDS}, ' ') AS cleaned FROM pages")
def c6(spark, sf):
    return _pages(spark, sf, cleaned=lambda h: F.array_join(clean.html_words(h), " "))


_SENTS = f"""unnest(string_split(regexp_replace(html, '{K.SENTENCE_END}', '\\1' || chr(1), 'g'), chr(1)))"""


@query("c7_html_sentences", f"""
WITH s AS (SELECT page_id, {_SENTS} AS html FROM pages),
w AS (SELECT page_id, array_to_string({HTML_WORDS}, ' ') AS sentence FROM s)
SELECT page_id, sentence, count(*) AS n FROM w WHERE sentence <> '' GROUP BY ALL""")
def c7(spark, sf):
    s = tokens.unnest(table(spark, sf, "pages"), ["page_id"], tokens.sentences(F.col("html")), "s")
    w = s.select("page_id", F.array_join(clean.html_words(F.col("s")), " ").alias("sentence"))
    return w.filter("sentence <> ''").groupBy("page_id", "sentence").agg(F.count("*").alias("n"))


_VIS = rewrite(unescape(rewrite("html", [
    (r"(?is)<script[^>]*>.*?</script>", " "), (r"(?is)<style[^>]*>.*?</style>", " "),
    (r"(?s)<!--.*?-->", " "), (r"<[^>]*>", " ")])), [(r"\s+", " "), (r"^\s+|\s+\z", "")])


@query("c8_visible_text", f"SELECT page_id, {_VIS} AS cleaned FROM pages")
def c8(spark, sf):
    return _pages(spark, sf, cleaned=clean.visible_text)


@query("c9_strip_tags", f"""
SELECT page_id, regexp_replace(html, '<.*?>', '', 'g') AS sgml_free,
  {unescape(rewrite("html", [("<[^<]+?>", ""), (r"^\s+|\s+\z", "")]), UNESCAPE_BASIC)} AS plain
FROM pages""")
def c9(spark, sf):
    return _pages(
        spark, sf,
        sgml_free=lambda h: clean.strip_tags(h, r"<.*?>"),
        plain=lambda h: clean.unescape(clean.strip(clean.strip_tags(h)), UNESCAPE_BASIC))


@query("c10_clean_question", f"""
SELECT doc_id, {rewrite(f"array_to_string({words('lower(text)')}, ' ')", K.QUESTION_REWRITES)}
  AS cleaned FROM documents""")
def c10(spark, sf):
    return _docs(spark, sf, cleaned=clean.clean_question)


_SENT_RULES = [(r"['\"-]", ""), (rf"([^{K.WORD_CHARS}]+)", r" $1 "), (r"\s\S\s", " "), (r"\s+", " ")]


@query("c11_clean_sentence",
       f"SELECT doc_id, {rewrite('lower(text)', _SENT_RULES)} AS cleaned FROM documents")
def c11(spark, sf):
    return _docs(spark, sf, cleaned=clean.clean_sentence)


@query("c12_stop_sentences", r"""
SELECT doc_id, i AS sentence_id, s[i] AS sentence FROM (
  SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
    SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([!?])', ' \1 .', 'g'),
      '[().*\n]+\z', ''), '.') AS s FROM documents))""")
def c12(spark, sf):
    d = table(spark, sf, "documents")
    s = tokens.unnest(d, ["doc_id"], clean.split_on_stops(F.col("text")), "sentence", "i")
    return s.select("doc_id", (F.col("i") + 1).cast("long").alias("sentence_id"), "sentence")


@query("c13_clean_social", rf"""
SELECT doc_id, array_to_string(list_filter({words('text')},
  lambda x: NOT regexp_matches(x, '^(\.?@|http|#)')), ' ') AS cleaned FROM documents""")
def c13(spark, sf):
    return _docs(spark, sf, cleaned=clean.clean_social)


_RULES = [
    (r"[)(?:/.;!\[\]\"=]", ""), (r"(^|\s),+|,+(\s|\z)", "$1$2"), (r"([^0-9\s]),+", "$1 "),
    (r",+([^0-9\s])", " $1"), ("i'm", "i am"), ("'ve", " have"), ("n't", " not"),
    ("'ll", " will"), (r"'s(\s|\z)", " 's$1"), (r"s'(\s|\z)", "s 's$1"), ("-", " ")]


@query("c14_rule_tokens", f"""
WITH c AS (SELECT doc_id, {rewrite('text', CONTRACTED)} AS body FROM documents)
SELECT doc_id, array_to_string({words(rewrite('lower(body)', _RULES))}, ' ') AS tokens FROM c""")
def c14(spark, sf):
    return _docs(spark, sf,
                 tokens=lambda t: F.array_join(clean.rule_tokens(_contracted(t)), " "))


@query("c15_isolate_punctuation",
       f"SELECT doc_id, {rewrite('lower(text)', K.LINE_REWRITES)} AS cleaned FROM documents")
def c15(spark, sf):
    return _docs(spark, sf, cleaned=clean.isolate_punctuation)


_DIGITS = [(str(i), f" {w} ") for i, w in enumerate(K.DIGIT_WORDS)]


def _wiki(expr):
    return "trim(" + rewrite(rewrite(f"lower({rewrite(expr, K.WIKI_REWRITES)})", _DIGITS),
                             [("[^a-z]+", " ")]) + ", ' ')"


@query("c16_strip_wiki", f"SELECT page_id, {_wiki('html')} AS cleaned FROM pages")
def c16(spark, sf):
    return _pages(spark, sf, cleaned=clean.strip_wiki)


@query("c17_remove_bracketed")
def c17(spark, sf):
    return _pages(spark, sf, cleaned=clean.remove_bracketed)


# HTML title and heading elements stand in for the document tags.
_TAGS = {"title": "TITLE_WORD", "h1": "HEAD_WORD", "b": "BOLD_WORD"}


def _tagged(use_word):
    expr = "html"
    for tag, word in _TAGS.items():
        expr = rewrite(expr, [(f"(?s)<{tag}>(.*?)</{tag}>", word if use_word else "$1")])
    return expr


# Pages close none of their <b> elements, so the marker is closed first.
@query("c18_inline_tags", f"""
WITH p AS (SELECT page_id, regexp_replace(html, '<b>([^<]*)', '<b>\\1</b>', 'g') AS html FROM pages)
SELECT page_id, {_tagged(True)} AS replaced, {_tagged(False)} AS unmarked FROM p""")
def c18(spark, sf):
    def close(h):
        return F.regexp_replace(h, "<b>([^<]*)", "<b>$1</b>")

    return _pages(
        spark, sf,
        replaced=lambda h: clean.replace_inline_tags(close(h), _TAGS),
        unmarked=lambda h: clean.replace_inline_tags(close(h), _TAGS, use_word=False))
