"""Row selection, class balance, corpus counts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import clean
from textloom.functions.tokens import unnest
from textloom.operators import order


def min_chars(df: DataFrame, n=1000, text="text") -> DataFrame:
    return df.filter(F.length(text) >= n)


def word_range(df: DataFrame, low=50, high=1000, text="text") -> DataFrame:
    n = F.size(clean.words(F.col(text)))
    return df.filter((n > low) & (n < high))


def drop_empty(df: DataFrame, text="text") -> DataFrame:
    return df.filter(F.col(text).rlike(r"\S"))


def require_class_size(df: DataFrame, label: str, least=50) -> DataFrame:
    """Class counts; reading them fails when a class has fewer than `least` rows."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    message = F.concat(F.lit("class "), F.col(label).cast("string"),
                       F.lit(f" has fewer than {least} rows"))
    return n.withColumn("n", F.when(F.col("n") < least, F.raise_error(message).cast("long"))
                        .otherwise(F.col("n")))


def balance(df: DataFrame, label: str, ids, seed="") -> DataFrame:
    """Keep as many rows of each class as the smallest class has, picked by shuffled rank.

    The rank is counted in 4096 slices of each class, so one large class is never sorted whole.
    """
    least = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).scalar()
    kept = order.shuffled_rank(df, [label], ids, "_rank", seed=seed)
    return kept.filter(F.col("_rank") <= least).drop("_rank")


def permute(df: DataFrame, ids, seed="") -> DataFrame:
    """Rows in a repeatable random order, sorted across the cluster by a hash of their id."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    return df.orderBy(order.shuffle_key(*ids, seed=seed), *ids)


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def corpus_size(df: DataFrame, text="text") -> DataFrame:
    """Number of documents and of space-separated words."""
    return df.agg(F.count("*").alias("n_docs"),
                  F.sum(F.size(F.split(text, " ")).cast("long")).alias("n_words"))


def joint_vocabulary(corpora, text="text") -> DataFrame:
    """Distinct lower-cased words of several corpora."""
    parts = [unnest(c, [], clean.words(F.lower(text)), "term") for c in corpora]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
