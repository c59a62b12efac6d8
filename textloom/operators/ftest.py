"""Analysis of variance per term, from sums over the cells that are not zero."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.bayes import class_sizes
from textloom.operators.joins import hot_lookup, hottest_in
from textloom.session import stage


def f_values(cells: DataFrame, docs: DataFrame, label: str, value="weight", key="doc_id", term="term"):
    """(term, f_value) of the one-way test of each term's values against the classes.

    `cells` is (key, term, value) without its zeros; `docs` is (key, label). Zeros add nothing to
    sums and squares and enter through the class sizes alone. A term whose values do not vary inside
    classes has an infinite value if its class means differ, and null if they do not.
    """
    docs = docs.filter(F.col(label).isNotNull()).select(key, label)
    sizes = class_sizes(docs, label)
    n, k = sum(m for _, m in sizes), len(sizes)
    x = F.col(value).cast("double")
    part = cells.join(docs, key).groupBy(term, label).agg(F.sum(x).alias("_s"), F.sum(x * x).alias("_q"))
    size = F.lit(None).cast("double")
    for c, m in sizes:
        size = F.when(F.col(label) == c, F.lit(float(m))).otherwise(size)
    sums = part.groupBy(term).agg(
        F.sum("_q").alias("_q"), F.sum("_s").alias("_s"), F.sum(F.col("_s") * F.col("_s") / size).alias("_b"))
    between = F.greatest(F.col("_b") - F.col("_s") * F.col("_s") / n, F.lit(0.0))
    within = F.greatest(F.col("_q") - F.col("_b"), F.lit(0.0))
    # Differences of sums below their own rounding error are zero.
    none = lambda d: d <= F.col("_q") * 1e-12
    f = F.when(none(within), F.when(~none(between), F.lit(math.inf))).otherwise(
        between / (k - 1) / (within / (n - k))) if k > 1 and n > k else F.lit(None).cast("double")
    return sums.select(term, f.alias("f_value")), (k - 1, n - k)


def beta_tail(x, a, b, rounds=500):
    """Regularised incomplete beta function I_x(a, b) of an array, by its continued fraction."""
    x = np.asarray(x, np.float64)
    flip = x > (a + 1.0) / (a + b + 2.0)
    y = np.where(flip, 1.0 - x, x)
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(y)
    d = 1.0 / safe(1.0 - (p + q) * y / (p + 1.0))
    h = d.copy()
    for m in range(1, rounds):
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
                     -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1.0 / safe(1.0 + step * d)
            c = safe(1.0 + step / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    with np.errstate(divide="ignore"):
        front = p * np.log(y) + q * np.log1p(-y) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    out = np.exp(front) * h / p
    return np.where(flip, 1.0 - out, out)


def with_p_values(found: DataFrame, freedom, f="f_value") -> DataFrame:
    """Adds the probability of a value at least as large if the classes did not differ."""
    d1, d2 = freedom
    names = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in found.schema.fields)

    def run(batches):
        for pdf in batches:
            v = pdf[f].to_numpy(np.float64)
            p = np.full(len(v), np.nan)
            p[np.isposinf(v)] = 0.0
            ok = np.isfinite(v)
            p[ok] = beta_tail(d2 / (d2 + d1 * v[ok]), d2 / 2.0, d1 / 2.0)
            yield pdf.assign(p_value=pd.Series(p, pdf.index))

    out = found.mapInPandas(run, f"{names}, p_value double")
    return out.withColumn("p_value", F.nanvl("p_value", F.lit(None).cast("double")))


def select_terms(cells: DataFrame, docs: DataFrame, label: str, threshold=0.05, value="weight", key="doc_id",
                 term="term") -> DataFrame:
    """The cells of terms whose test is significant."""
    kept = stage(with_p_values(*f_values(cells, docs, label, value, key, term)).filter(
        F.col("p_value") < threshold))
    hot = hottest_in(cells, term)
    return hot_lookup(cells, kept, term, ["p_value"], hot, [key])
