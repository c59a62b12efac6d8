"""Scores from (label, prediction[, score]) tables, all by aggregation."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import order


def ratio(a, b):
    """a / b, and 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, y="y", pred="pred", by=()) -> DataFrame:
    return df.groupBy(*by, y, pred).agg(F.count("*").alias("n"))


def confusion_shares(df: DataFrame, y="y", pred="pred") -> DataFrame:
    """Confusion counts with each row's share of its true class."""
    c = confusion(df, y, pred)
    total = F.sum("n").over(Window.partitionBy(y))
    return c.withColumn("share", F.round(F.col("n") / total, 6))


def class_counts(conf: DataFrame, y="y", pred="pred", by=()) -> DataFrame:
    """Per class the true positives, predicted rows and support, from confusion counts."""
    hit = F.when(F.col(y).eqNullSafe(F.col(pred)), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col(y).alias("cls"), hit.alias("tp"), F.lit(0).cast("long").alias("predicted"),
                 F.col("n").alias("support")),
        F.struct(F.col(pred).alias("cls"), F.lit(0).cast("long").alias("tp"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("support")))
    return conf.select(*by, F.inline(sides)).groupBy(*by, "cls").agg(
        *[F.sum(c).alias(c) for c in ("tp", "predicted", "support")])


def class_report(conf: DataFrame, y="y", pred="pred", by=()) -> DataFrame:
    c = class_counts(conf, y, pred, by)
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return c.select(*by, "cls", "support", "tp", p.alias("precision"), r.alias("recall"),
                    ratio(2 * p * r, p + r).alias("f1"))


def weighted_scores(df: DataFrame, y="y", pred="pred", by=(), digits=3) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    r = class_report(confusion(df, y, pred, by), y, pred, by)
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("support")) / F.sum("support"), digits)
    return r.groupBy(*by).agg(
        F.round(F.sum("tp") / F.sum("support"), digits).alias("accuracy"),
        *[mean(c).alias(c) for c in ("precision", "recall", "f1")])


def positive_scores(df: DataFrame, positive, y="y", pred="pred", digits=2) -> DataFrame:
    """Counts and scores with one class taken as positive."""
    a, b = F.col(y) == positive, F.col(pred) == positive
    n = lambda c: F.count(F.when(c, 1))
    counts = df.agg(n(a & b).alias("tp"), n(~a & b).alias("fp"), n(a & ~b).alias("fn"),
                    n(~a & ~b).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.select(
        "tp", "fp", "fn", "tn",
        F.round((tp + tn) / (tp + fp + fn + tn), digits).alias("accuracy"),
        F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"),
        F.round(ratio(2 * p * r, p + r), digits).alias("f1"))


def multilabel_scores(truth: DataFrame, predicted: DataFrame, keys, label="label") -> DataFrame:
    """Micro and macro precision, recall and F1 from two (key, label) tables."""
    t = truth.select(*keys, label).distinct().withColumn("_t", F.lit(1))
    p = predicted.select(*keys, label).distinct().withColumn("_p", F.lit(1))
    both = t.join(p, [*keys, label], "full")
    per = both.groupBy(label).agg(
        F.count(F.when(F.col("_t").isNotNull() & F.col("_p").isNotNull(), 1)).alias("tp"),
        F.count("_p").alias("predicted"), F.count("_t").alias("support"))
    p_, r_ = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    per = per.select("tp", "predicted", "support", p_.alias("p"), r_.alias("r"),
                     ratio(2 * p_ * r_, p_ + r_).alias("f"))
    sums = per.agg(
        F.sum("tp").alias("tp"), F.sum("predicted").alias("pr"), F.sum("support").alias("su"),
        F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"),
        F.avg("f").alias("macro_f1"))
    mp, mr = ratio(F.col("tp"), F.col("pr")), ratio(F.col("tp"), F.col("su"))
    return sums.select(
        mp.alias("micro_precision"), mr.alias("micro_recall"),
        ratio(2 * mp * mr, mp + mr).alias("micro_f1"), "macro_precision", "macro_recall",
        "macro_f1")


def roc_auc(df: DataFrame, y="y", score="score") -> DataFrame:
    """Area under the ROC curve with ties at half. Rows are counted per distinct score first, then
    running totals are taken in ordered parts."""
    n = df.groupBy(score).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("_neg"))
    run = order.running_totals(n, [], [F.col(score)], {"_upto": F.col("_neg")})
    below = F.col("_upto") - F.col("_neg") / 2.0
    out = run.agg(F.sum(F.col("_pos") * below).alias("_u"), F.sum("_pos").alias("n_pos"),
                  F.sum("_neg").alias("n_neg"))
    return out.select(ratio(F.col("_u"), F.col("n_pos") * F.col("n_neg")).alias("auc"), "n_pos",
                      "n_neg")


def precision_at(predictions: DataFrame, truth: DataFrame, key, k, label="label", score="score"):
    """P@k over k * N and R@k over all true labels; documents without labels are left out."""
    labelled = truth.select(key).distinct()
    w = Window.partitionBy(key).orderBy(F.desc(score), label)
    top = predictions.join(labelled, key, "left_semi").withColumn("_r", F.row_number().over(w))
    hits = top.filter(F.col("_r") <= k).join(truth.select(key, label), [key, label], "left_semi")
    n_hits = hits.agg(F.count("*")).scalar()
    n_docs = labelled.agg(F.count("*")).scalar()
    return truth.agg(F.count("*").alias("n_labels")).select(
        n_docs.alias("n_docs"), "n_labels", (n_hits / (k * n_docs)).alias("precision"),
        (n_hits / F.col("n_labels")).alias("recall"))


def misclassified(df: DataFrame, y="y", pred="pred") -> DataFrame:
    return df.filter(~F.col(y).eqNullSafe(F.col(pred)))


def rank_distance(gold: DataFrame, predicted: DataFrame, keys, group) -> DataFrame:
    """Per group the label distance: moves are |predicted - gold|, or |gold - 2| where there is no
    prediction; the distance is n * moves / 22."""
    j = gold.join(predicted, keys, "left")
    moves = F.when(F.col("predicted").isNull(), F.abs(F.col("level") - 2)).otherwise(
        F.abs(F.col("predicted") - F.col("level")))
    g = j.groupBy(group).agg(
        F.count("*").alias("n"), F.sum(moves).cast("long").alias("moves"),
        F.count(F.when(F.col("predicted") == F.col("level"), 1)).alias("correct"))
    return g.withColumn("distance", F.col("n") * F.col("moves") / 22.0)


def mean_interval(df: DataFrame, value, z=1.959964) -> DataFrame:
    half = z * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.agg(F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"),
                  (F.avg(value) + half).alias("high"))


def losses(df: DataFrame, y="y", p="p", eps=1e-7) -> DataFrame:
    """Mean losses of one prediction column; hinge losses read y as -1 / 1."""
    t, x = F.col(y).cast("double"), F.col(p).cast("double")
    clip = lambda c, hi=None: F.greatest(c, F.lit(eps)) if hi is None else F.least(
        F.greatest(c, F.lit(eps)), F.lit(hi))
    sign = 2 * t - 1
    inside = clip(x, 1 - eps)
    log_gap = F.log(clip(x) + 1.0) - F.log(clip(t) + 1.0)
    terms = {
        "mse": F.avg((x - t) * (x - t)),
        "mae": F.avg(F.abs(x - t)),
        "mape": 100 * F.avg(F.abs((t - x) / clip(F.abs(t)))),
        "msle": F.avg(log_gap * log_gap),
        "squared_hinge": F.avg(F.pow(F.greatest(1 - sign * x, F.lit(0.0)), 2)),
        "hinge": F.avg(F.greatest(1 - sign * x, F.lit(0.0))),
        "cross_entropy": -F.avg(t * F.log(inside) + (1 - t) * F.log(1 - inside)),
        "kl": F.sum(clip(t, 1.0) * F.log(clip(t, 1.0) / clip(x, 1.0))),
        "poisson": F.avg(x - t * F.log(x + eps)),
        "cosine": -F.sum(t * x) / F.sqrt(F.sum(t * t)) / F.sqrt(F.sum(x * x)) / F.count("*"),
    }
    return df.agg(*[e.alias(n) for n, e in terms.items()])


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
