"""Counting and weighting: n-grams, term counts, vocabularies, TF-IDF, document features."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import tokens as T
from textloom.operators.joins import hot_lookup, hottest, keep_top
from textloom.session import checkpoint


def sentence_ngrams(sentences: DataFrame, keys, n: int, tokens="tokens", stopwords=None):
    """Word n-grams 1..n that never cross a sentence. With `stopwords`, n-grams are formed first
    and any that holds a stop word is discarded."""
    gram = T.ngrams(F.col(tokens), 1, n, sep=" ")
    if stopwords:
        gram = F.filter(gram, lambda g: ~F.exists(
            F.split(g, " "), lambda t: t.isin(list(stopwords))))
    return T.unnest(sentences, keys, gram, "term")


def term_counts(terms: DataFrame, keys, term="term") -> DataFrame:
    return terms.groupBy(*keys, term).agg(F.count("*").alias("tf"))


def presence(tf: DataFrame) -> DataFrame:
    return tf.withColumn("tf", F.lit(1).cast("long"))


def vocabulary(tf: DataFrame, n_docs, min_df=0.0, max_df=1.0, max_features=None, term="term"):
    """Terms with their document and corpus counts, pruned by share of documents, then by count."""
    v = tf.groupBy(term).agg(F.count("*").alias("df"), F.sum("tf").alias("n"))
    v = v.filter((F.col("df") >= min_df * n_docs) & (F.col("df") <= max_df * n_docs))
    return keep_top(v, "n", term, max_features) if max_features else v


def smooth_idf(df, n_docs):
    return F.lit(1.0) + F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df))


def idf_table(tf: DataFrame, n_docs, idf=smooth_idf, term="term") -> DataFrame:
    """(term, df, idf): the fitted model, one row per term.

    It is kept in reliable storage, since a look-up reads it for its frequent terms and for the
    rest; the corpus is read once to fit it."""
    return idf_of(tf.groupBy(term).agg(F.count("tf").alias("df")), n_docs, idf)


def idf_of(vocabulary: DataFrame, n_docs, idf=smooth_idf) -> DataFrame:
    """The same model from the terms' document counts `df`."""
    return checkpoint(vocabulary.withColumn("idf", idf(F.col("df"), n_docs)))


def weigh(tf: DataFrame, idf: DataFrame, key="doc_id", term="term", sublinear=False,
          normalize=True, out="weight") -> DataFrame:
    """tf * idf per document and term; terms outside the model are ignored.

    Counts are one row per document and term, and the terms that most documents hold are met by
    broadcast, so a frequent term fills no task of its own."""
    count = F.lit(1.0) + F.log("tf") if sublinear else F.col("tf").cast("double")
    w = hot_lookup(tf, idf, term, ["idf"], hottest(idf, term, "df"), [key])
    w = w.withColumn(out, count * F.col("idf"))
    if normalize:
        norm = F.sqrt(F.sum(F.col(out) * F.col(out)).over(Window.partitionBy(key)))
        w = w.withColumn(out, F.col(out) / norm)
    return w.select(key, term, "tf", out)


def prefix_counts(windows: DataFrame, window, low: int, name, count="n") -> DataFrame:
    """Counts of all prefixes of at least `low` characters, from the counts of the distinct windows.

    With the windows of a text at every position these are its character n-grams, at one row a character.
    """
    n = windows.groupBy(window).agg(F.count("*").alias("_n")).filter(F.length(window) >= low)
    prefixes = F.transform(F.sequence(F.lit(low), F.length(window)), lambda k: F.substr(window, F.lit(1), k))
    return T.unnest(n, ["_n"], prefixes, name).groupBy(name).agg(F.sum("_n").alias(count))


def order_weights(docs: DataFrame, key, tokens, alpha=0.99, vocab=None) -> DataFrame:
    """Fixed-size order encoding: a term weighs the sum of alpha^(words that follow it). Words
    outside the table `vocab` still hold their place but leave the rows before they are summed."""
    sized = docs.select(key, F.col(tokens), F.size(tokens).alias("_n"))
    t = T.unnest(sized, [key, "_n"], F.col(tokens), "term", "_i")
    if vocab is not None:
        t = t.join(vocab, "term", "left_semi")
    return t.groupBy(key, "term").agg(
        F.sum(F.pow(F.lit(float(alpha)), F.col("_n") - F.col("_i") - 1)).alias("weight"))


def drop_zero_columns(df: DataFrame, features) -> DataFrame:
    """Drop feature columns that are zero everywhere; one row of sums comes to the driver."""
    sums = df.agg(*[F.sum(F.abs(F.col(f"`{c}`"))).alias(c) for c in features]).first()
    return df.drop(*[c for c in features if not sums[c]])


def shares(flags: DataFrame, key, value, names, total) -> DataFrame:
    """Wide table of each name's share of `total` per key, from (key, value, n) counts."""
    wide = flags.groupBy(key).agg(*[
        F.sum(F.when(F.col(value) == n, F.col("n")).otherwise(0)).alias(f"_{n}") for n in names],
        F.sum(total).alias("_total"))
    return wide.select(key, *[(F.col(f"_{n}") / F.col("_total")).alias(f"share_{n}")
                              for n in names])


def binarise(df: DataFrame, categories: str, selected) -> DataFrame:
    """One 0/1 column per selected category of an array column."""
    return df.withColumns({
        f"is_{c}": F.array_contains(categories, c).cast("int") for c in selected})


def standardise(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Subtract the mean and divide by the population deviation, per dimension."""
    x = [F.col(vec)[i].cast("double") for i in range(dim)]
    mean = df.agg(F.array(*[F.avg(c) for c in x])).scalar()
    dev = df.agg(F.array(*[F.stddev_pop(c) for c in x])).scalar()
    fitted = df.withColumn("_mean", mean).withColumn("_dev", dev)
    scaled = F.transform(vec, lambda v, i: F.try_divide(
        v.cast("double") - F.col("_mean")[i], F.col("_dev")[i]))
    return fitted.withColumn("scaled", scaled).drop("_mean", "_dev")
