"""Repeatable splits. Order comes from a hash of the row id, so any partitioning gives the same
split, and ranks are counted in slices so that a large class is never sorted in one task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import order


def random_split(df: DataFrame, ids, test=0.33, seed="") -> DataFrame:
    ids = [ids] if isinstance(ids, str) else list(ids)
    is_test = order.uniform(*ids, seed=seed) < test
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def stratified_split(df: DataFrame, label, ids, train=0.7, seed="") -> DataFrame:
    """The first floor(train * n) rows of each class, in shuffled order, are for training."""
    r = order.shuffled_rank(df, [label], ids, "_rank", total="_n", seed=seed)
    is_train = F.col("_rank") <= F.floor(F.lit(train) * F.col("_n"))
    return r.withColumn("split", F.when(is_train, "train").otherwise("test")).drop("_rank", "_n")


def shuffled_shares(df: DataFrame, label, ids, rank, total, seed="") -> DataFrame:
    """Add the shuffled rank of every row in its class and the class's row count (once)."""
    return order.shuffled_rank(df, [label], ids, rank, total=None if total in df.columns else total, seed=seed)


def stratified_folds(df: DataFrame, label, ids, k=5, seed="") -> DataFrame:
    r = order.shuffled_rank(df, [label], ids, "_rank", seed=seed)
    return r.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def contiguous_folds(df: DataFrame, order_by, k=5) -> DataFrame:
    """Folds of neighbouring rows; the first n mod k folds hold one row more."""
    r = order.ranked(df, [], order_by, "_rank", total="_n")
    at, small = F.col("_rank") - 1, F.floor(F.col("_n") / k)
    more = F.col("_n") % k
    border = more * (small + 1)
    fold = F.when(at < border, F.floor(at / (small + 1))).otherwise(
        more + F.floor((at - border) / F.greatest(small, F.lit(1))))
    return r.withColumn("fold", fold.cast("int")).drop("_rank", "_n")


def group_folds(df: DataFrame, group, k=5) -> DataFrame:
    """Whole groups per fold: groups are numbered by name and dealt out in turn."""
    g = order.ranked(df.select(group).distinct(), [], [F.col(group)], "_rank")
    g = g.select(group, ((F.col("_rank") - 1) % k).cast("int").alias("fold"))
    return df.join(g, group)


def positional_split(df: DataFrame, order_by, test=0.4) -> DataFrame:
    """First int((1 - test) n) rows train; half that many validate; the rest test."""
    r = order.ranked(df, [], order_by, "_rank", total="_n")
    train = F.floor(F.lit(1.0 - test) * F.col("_n"))
    valid = F.floor(F.lit(0.5) * train)
    name = F.when(F.col("_rank") <= train, "train").when(
        F.col("_rank") <= train + valid, "valid").otherwise("test")
    return r.withColumn("split", name).drop("_rank", "_n")


def symmetric_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Every pair in both orders, from one scan."""
    both = F.array(F.struct(F.col(a).alias(a), F.col(b).alias(b)),
                   F.struct(F.col(b).alias(a), F.col(a).alias(b)))
    rest = [c for c in df.columns if c not in (a, b)]
    return df.select(*rest, F.inline(both))


def prior_weights(df: DataFrame, label: str, weights: dict) -> DataFrame:
    """Row weights that move the classes to a target prior."""
    w = F.lit(1.0)
    for value, weight in weights.items():
        w = F.when(F.col(label) == value, F.lit(float(weight))).otherwise(w)
    return df.withColumn("weight", w)


def target_prior(positive_now, positive_target):
    """(positive, negative) weights that turn one positive share into another."""
    return positive_target / positive_now, (1 - positive_target) / (1 - positive_now)
