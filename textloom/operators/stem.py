"""Porter stemming as a column expression, applied once per distinct word."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import snowball
from textloom.operators.joins import hot_lookup, hottest_in

# Consonant and vowel runs of the published algorithm; "y" is a vowel after a consonant.
_MARK = "\x02"
_V = "[aeiouy]"
_CC = "[^aeiou][^aeiouy]*"
_VV = "[aeiouy][aeiou]*"
_MEASURE_1 = f"^({_CC})?{_VV}{_CC}"
_MEASURE_EXACT_1 = rf"^({_CC})?{_VV}{_CC}({_VV})?\z"
_MEASURE_2 = f"^({_CC})?{_VV}{_CC}{_VV}{_CC}"
_HAS_VOWEL = f"^({_CC})?{_V}"
_DOUBLE = r"([^aeiou])\1\z"
_CVC = rf"^{_CC}{_V}[^aeiouwxy]\z"

# Suffix tables of the published algorithm: "suffix=replacement", longest match first.
_STEP2 = """ational=ate tional=tion enci=ence anci=ance izer=ize bli=ble alli=al entli=ent eli=e
ousli=ous ization=ize ation=ate ator=ate alism=al iveness=ive fulness=ful ousness=ous aliti=al
iviti=ive biliti=ble logi=log"""
_STEP3 = "icate=ic ative= alize=al iciti=ic ical=ic ful= ness="
_STEP4 = """al= ance= ence= er= ic= able= ible= ant= ement= ment= ent= ion= ou= ism= ate= iti=
ous= ive= ize="""


def _table(text):
    pairs = [p.split("=") for p in text.split()]
    return sorted(pairs, key=lambda p: -len(p[0]))


def _cut(word, suffix):
    return F.substring(word, F.lit(1), F.length(word) - len(suffix))


def _suffix_step(word, table, condition):
    """Only the longest matching suffix counts, whether or not its condition holds."""
    out = word
    for suffix, repl in reversed(table):
        stem = _cut(word, suffix)
        ok = stem.rlike(condition)
        if suffix == "ion":
            ok = ok & stem.rlike(r"[st]\z")
        out = F.when(
            word.endswith(suffix), F.when(ok, F.concat(stem, F.lit(repl))).otherwise(word)
        ).otherwise(out)
    return out


def _plural(w):
    return (
        F.when(w.endswith("sses") | w.endswith("ies"), _cut(w, "es"))
        .when(w.endswith("ss"), w)
        .when(w.endswith("s"), _cut(w, "s"))
        .otherwise(w)
    )


def _past(w):
    """Cut "ed" and "ing"; the mark tells the next step that one was cut."""
    return (
        F.when(w.endswith("eed"),
               F.when(_cut(w, "eed").rlike(_MEASURE_1), _cut(w, "d")).otherwise(w))
        .when(w.endswith("ed") & _cut(w, "ed").rlike(_HAS_VOWEL),
              F.concat(_cut(w, "ed"), F.lit(_MARK)))
        .when(w.endswith("ing") & _cut(w, "ing").rlike(_HAS_VOWEL),
              F.concat(_cut(w, "ing"), F.lit(_MARK)))
        .otherwise(w)
    )


def _restore(w):
    bare = F.replace(w, F.lit(_MARK), F.lit(""))
    return (
        F.when(~w.endswith(_MARK), w)
        .when(bare.rlike(r"(at|bl|iz)\z"), F.concat(bare, F.lit("e")))
        .when(bare.rlike(_DOUBLE) & ~bare.rlike(r"[lsz]\z"), _cut(bare, "x"))
        .when(bare.rlike(_MEASURE_EXACT_1) & bare.rlike(_CVC), F.concat(bare, F.lit("e")))
        .otherwise(bare)
    )


def _final_y(w):
    return F.when(
        w.endswith("y") & _cut(w, "y").rlike(_HAS_VOWEL), F.concat(_cut(w, "y"), F.lit("i"))
    ).otherwise(w)


def _final_e(w):
    e = _cut(w, "e")
    drop = e.rlike(_MEASURE_2) | (e.rlike(_MEASURE_1) & ~e.rlike(_CVC))
    return F.when(w.endswith("e") & drop, e).otherwise(w)


def _final_l(w):
    return F.when(w.endswith("ll") & w.rlike(_MEASURE_2), _cut(w, "l")).otherwise(w)


_STEPS = [
    _plural,
    _past,
    _restore,
    _final_y,
    lambda w: _suffix_step(w, _table(_STEP2), _MEASURE_1),
    lambda w: _suffix_step(w, _table(_STEP3), _MEASURE_1),
    lambda w: _suffix_step(w, _table(_STEP4), _MEASURE_2),
    _final_e,
    _final_l,
]


def porter(word):
    """Stem of a lower-case word; words of one or two letters stay as they are.

    Each step binds the word once as a lambda variable, so the expression stays small.
    """
    bound = F.array(word)
    for step in _STEPS:
        bound = F.transform(bound, step)
    return F.when(F.length(word) <= 2, word).otherwise(F.get(bound, F.lit(0)))


def stems(words: DataFrame, word="term", out="stem") -> DataFrame:
    """Distinct words with their stems."""
    return words.select(word).distinct().withColumn(out, porter(F.lower(F.col(word))))


def stem_tokens(tokens: DataFrame, term="term", out="stem", spread_by=("doc_id",)) -> DataFrame:
    """Tokens with their stems; the words with most rows are met by broadcast."""
    return hot_lookup(tokens, stems(tokens, term, out), term, [out], hottest_in(tokens, term), spread_by)


def snowball_stems(words: DataFrame, term="term", lang="lang", out="stem") -> DataFrame:
    """Distinct words of each language with their stems, by the language's own algorithm."""
    words = words.select(lang, term).distinct()
    return words.withColumn("_lower", F.lower(F.col(term))).withColumn(
        out, snowball.stem("_lower", lang)).drop("_lower")


def snowball_tokens(tokens: DataFrame, term="term", lang="lang", out="stem", spread_by=("doc_id",)):
    """Tokens with the stems of their language. Every distinct word is stemmed once; the words with
    most rows are met by broadcast, so none of them fills a task."""
    word = F.concat_ws(" ", F.coalesce(lang, F.lit("")), term)
    rest = [c for c in tokens.columns if c not in (term, lang)]
    # Language and word travel as one string and are parted again after the join.
    named = tokens.select(*rest, word.alias("_word"))
    found = snowball_stems(tokens, term, lang, out).select(word.alias("_word"), out)
    met = hot_lookup(named, found, "_word", [out], hottest_in(named, "_word"), spread_by)
    code = F.substring_index("_word", " ", 1)
    return met.select(*rest, F.when(code != "", code).alias(lang),
                      F.substr("_word", F.length(code) + 2).alias(term), out)
