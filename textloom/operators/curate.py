"""Curation lists for compound lemmas."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_list(tokens: DataFrame) -> DataFrame:
    """One row per raw token whose lemma holds a compound marker; "NULL" means keep."""
    marked = tokens.filter(F.col("lemma").contains("#") & (F.length("raw") > 1))
    best = marked.groupBy("raw").agg(F.min("lemma").alias("lemma"))
    return best.withColumn("replacement", F.lit("NULL"))


def apply_list(tokens: DataFrame, listed: DataFrame) -> DataFrame:
    """Replace marked lemmas by the listed word, or by the raw token; then drop the markers."""
    joined = tokens.join(listed.select("raw", "replacement"), "raw", "left")
    chosen = F.coalesce(F.nullif(F.col("replacement"), F.lit("NULL")), F.col("raw"))
    marked = (F.length("raw") > 1) & F.col("lemma").contains("#")
    lemma = F.when(marked, chosen).otherwise(F.col("lemma"))
    return joined.withColumn("lemma", F.replace(lemma, F.lit("#"), F.lit(""))).drop("replacement")
