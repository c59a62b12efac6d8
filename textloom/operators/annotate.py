"""Annotated tokens: sentences, token flags, lexicon lookups."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import tokens as T
from textloom.operators.joins import hot_lookup, hottest, hottest_in, keep_top



def sentences(df: DataFrame, keys, text="text") -> DataFrame:
    """One row per sentence, numbered from 1."""
    out = T.unnest(df, keys, T.sentences(F.col(text)), "sentence", "_i")
    return out.select(*keys, (F.col("_i") + 1).cast("long").alias("sentence_id"), "sentence")


def sentence_arrays(df: DataFrame, keys, text="text") -> DataFrame:
    """One row per non-empty sentence with its token structs; nothing is shuffled."""
    out = sentences(df, keys, text).filter(F.col("sentence").rlike(r"\S"))
    return out.withColumn("tokens", T.sentence_tokens(F.col("sentence")))


def annotate(df: DataFrame, keys, text="text") -> DataFrame:
    """Long token table: sentence, place in the sentence, token and its flags."""
    s = sentence_arrays(df, keys, text)
    s = s.select(*keys, "sentence_id", F.size("tokens").alias("_n"), "tokens")
    t = T.unnest(s, [*keys, "sentence_id", "_n"], F.col("tokens"), "_t", "_i")
    token = F.col("_t.token")
    return t.select(
        *keys,
        "sentence_id",
        (F.col("_i") + 1).cast("long").alias("pos"),
        F.lower(token).alias("token"),
        token.alias("raw"),
        T.is_eos_punct(token).alias("is_eos_punct"),
        T.is_punct(token).alias("is_punct"),
        T.is_number(token).alias("is_number"),
        (F.col("_i") == F.col("_n") - 1).alias("is_eos_token"),
        F.col("_t.glued").alias("skip_space"),
    )


def rebuild(tokens):
    """Text of a token struct array: a space before each token that is not glued."""
    pieces = F.transform(
        tokens,
        lambda t, i: F.when(t["glued"] | (i == 0), t["token"]).otherwise(
            F.concat(F.lit(" "), t["token"])),
    )
    return F.array_join(pieces, "")


def vocabulary(tokens: DataFrame, term="term", count="n") -> DataFrame:
    return tokens.groupBy(term).agg(F.count("*").alias(count))


def lookup(tokens: DataFrame, lexicon: DataFrame, on: str, values, default=None, hot=None):
    """Left equi-join to a lexicon with one row per form; the most frequent forms are met by
    broadcast."""
    others = [c for c in tokens.columns if c != on]
    hot = hottest_in(tokens, on) if hot is None else hot
    out = hot_lookup(tokens, lexicon, on, values, hot, others, "left")
    if default is not None:
        out = out.fillna(default, list(values))
    return out


def first_analysis(lexicon: DataFrame, form="form", order="analysis") -> DataFrame:
    """Keep the first listed analysis of each form."""
    cols = [c for c in lexicon.columns if c not in (form, order)]
    best = lexicon.groupBy(form).agg(F.min_by(F.struct(*cols), order).alias("_best"))
    return best.select(form, *[F.col(f"_best.{c}").alias(c) for c in cols])


def choose_lemma(candidates: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Per form the candidate nearest to the form's own vector; ties and unknowns take the last.

    `candidates` has (form, lemma, analysis); `vectors` has (word, vec). A candidate without a
    vector, or of a form without one, scores 0.
    """
    own = vectors.select(F.col("word").alias("form"), F.col("vec").alias("_form_vec"))
    other = vectors.select(F.col("word").alias("lemma"), F.col("vec").alias("_lemma_vec"))
    scored = candidates.join(own, "form", "left").join(other, "lemma", "left")
    a, b = F.col("_form_vec"), F.col("_lemma_vec")
    dot = lambda x, y: sum((x[i].cast("double") * y[i] for i in range(dim)), F.lit(0.0))
    cosine = F.round(dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b)), 6)
    scored = scored.withColumn("score", F.coalesce(cosine, F.lit(0.0)))
    best = scored.groupBy("form").agg(
        F.max_by(F.struct("lemma", "score"), F.struct("score", "analysis")).alias("_best"))
    return best.select("form", "_best.lemma", "_best.score")


def index_vocabulary(vocab: DataFrame, num_words: int, term="term", count="n") -> DataFrame:
    """Index 1.. by falling count, then term; `num_words` is the operator's own top-k size, so
    the final numbering never holds more rows than that."""
    top = keep_top(vocab, count, term, num_words)
    w = Window.orderBy(F.desc(count), term)
    return top.withColumn("idx", F.row_number().over(w).cast("long"))


def to_sequences(tokens: DataFrame, index: DataFrame, keys, num_words, pos="pos", term="term"):
    """Ids of the known tokens of each document in order; documents without any get none.

    The most frequent words of the index are met by broadcast, the rest by the usual join.
    """
    hits = hot_lookup(tokens, index, term, ["idx"], hottest(index, term, "n"), [*keys, pos])
    seq = hits.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(pos, "idx"))), lambda s: s["idx"])
        .alias("ids"))
    return seq


def keep_probability(count, total, t):
    """Chance that a word survives frequent-word subsampling: sqrt(t/f) + t/f."""
    f = count / total
    return F.sqrt(t / f) + t / f
