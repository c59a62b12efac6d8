"""Pairwise comparison inside groups, counted by rank instead of listing pairs.

A group of n items has n(n-1)/2 pairs; a hot group would emit far more rows than the table holds.
Everything the pairs are used for is a count, and the counts follow from ranks and class sizes.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import order


def pair_counts(items: DataFrame, group, item) -> DataFrame:
    """Items and unordered pairs of different items per group."""
    n = items.groupBy(group, item).agg(F.count("*").alias("_c"))
    same = F.col("_c") * (F.col("_c") - 1) / 2
    return n.groupBy(group).agg(
        F.sum("_c").alias("n"),
        (F.sum("_c") * (F.sum("_c") - 1) / 2 - F.sum(same)).cast("long").alias("n_pairs"))


def labelled_pair_counts(items: DataFrame, group, level, levels=(0, 1, 2)) -> DataFrame:
    """Pairs per group and (higher, lower) level, levels differing."""
    sizes = items.groupBy(group).agg(
        *[F.count(F.when(F.col(level) == v, 1)).alias(f"_n{v}") for v in levels])
    combos = F.array(*[
        F.struct(F.lit(hi).alias("winner"), F.lit(lo).alias("loser"),
                 (F.col(f"_n{hi}") * F.col(f"_n{lo}")).alias("n_pairs"))
        for hi in levels for lo in levels if hi > lo])
    return sizes.select(group, F.inline(combos)).filter("n_pairs > 0")


def gold_levels(ranked: DataFrame, group, order_by, first=1, second=9) -> DataFrame:
    """Level 2 for the best item of a group, 1 for the next nine, 0 for the rest.

    Only the top ten are ranked: Spark keeps ten rows per group and task before the shuffle, so a
    hot group is never sorted whole.
    """
    keys = [c for c in ranked.columns if c != group]
    w = Window.partitionBy(group).orderBy(*order_by)
    top = ranked.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= first + second)
    level = F.when(F.col("_r") <= first, 2).otherwise(1)
    top = top.select(group, *keys[:1], level.alias("_level"))
    return ranked.join(top, [group, keys[0]], "left").withColumn(
        "level", F.coalesce("_level", F.lit(0))).drop("_level")


def tournament(items: DataFrame, group, score, place) -> DataFrame:
    """Wins of each item over all others of its group: the higher score wins, the later item on
    equal scores. An item's wins are its rank from below."""
    r = order.ranked(items, [group], [F.col(score), F.col(place)], "_rank")
    return r.withColumn("wins", F.col("_rank") - 1).drop("_rank")


def concordance(items: DataFrame, group, level, score, place) -> DataFrame:
    """Per group the gold pairs (levels differ) and those a score orders rightly, each unordered
    pair once. Items ranked below an item and of a lower level are counted by running totals."""
    at = lambda v: F.when(F.col(level) == v, 1).otherwise(0).cast("long")
    run = order.running_totals(items, [group], [F.col(score), F.col(place)],
                               {"_below0": at(0), "_below1": at(1)}, {"_below0": "_n0",
                                                                     "_below1": "_n1"})
    hit = F.when(F.col(level) == 2, F.col("_below0") + F.col("_below1")).when(
        F.col(level) == 1, F.col("_below0")).otherwise(0)
    gold = F.when(F.col(level) == 2, F.col("_n0") + F.col("_n1")).when(
        F.col(level) == 1, F.col("_n0")).otherwise(0)
    return run.groupBy(group).agg(F.sum(hit).alias("correct"), F.sum(gold).alias("total"))


def score_predicted_pairs(pairs: DataFrame, gold: DataFrame, keys, a="a", b="b") -> DataFrame:
    """Judge listed predictions (label 1: the first wins) by two look-ups into the gold levels.

    A pair counts once whichever way round it is listed, and only when the levels differ.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    once = pairs.groupBy(*keys, lo.alias("_lo"), hi.alias("_hi")).agg(
        F.min_by("label", F.struct(a, b)).alias("label"),
        F.min(F.struct(a, b)).alias("_first"))
    g = gold.select(*keys, F.col("item"), F.col("level"))
    first = g.select(*keys, F.col("item").alias("_a"), F.col("level").alias("_la"))
    second = g.select(*keys, F.col("item").alias("_b"), F.col("level").alias("_lb"))
    once = once.select(*keys, F.col(f"_first.{a}").alias("_a"), F.col(f"_first.{b}").alias("_b"),
                       "label")
    j = once.join(first, [*keys, "_a"]).join(second, [*keys, "_b"]).filter("_la <> _lb")
    right = (F.col("label") == 1) == (F.col("_la") > F.col("_lb"))
    return j.groupBy(*keys).agg(F.count(F.when(right, 1)).alias("correct"),
                                F.count("*").alias("total"))


def symmetric_scores(pairs: DataFrame, keys, a, b, p) -> DataFrame:
    """Mean of p(a, b) and p(b, a) for each unordered pair."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    return pairs.groupBy(*keys, lo.alias(a), hi.alias(b)).agg(F.avg(p).alias(p))
