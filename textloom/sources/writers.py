"""Writers and the stage cache."""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_predictions(df: DataFrame, path: str, id_col: str, value_col: str, sort=False):
    """CSV with a header: id and prediction, sorted by id on request."""
    out = df.select(id_col, value_col)
    if sort:
        out = out.repartitionByRange(id_col).sortWithinPartitions(id_col)
    out.write.mode("overwrite").csv(path, header=True)


def export_lines(df: DataFrame, text: str, path: str):
    """One cleaned document per line."""
    df.select(F.regexp_replace(text, r"[\r\n]+", " ").alias("value")).write.mode(
        "overwrite").text(path)


def write_groups(df: DataFrame, group: str, path: str):
    """Headerless tab-separated files named after their group: `<group>.<part>.tsv`.

    Tasks write their share of every group, so a large group has several parts; only names pass through
    the driver. Group names should hold no characters that file names escape.
    """
    spark = df.sparkSession
    df.write.partitionBy(group).csv(path, sep="\t", quote="", escapeQuotes=False)
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in files.listStatus(root):
        name = folder.getPath().getName()
        if folder.isDirectory() and name.startswith(f"{group}="):
            parts = sorted(f.getPath().getName() for f in files.listStatus(folder.getPath()))
            for k, part in enumerate(parts):
                target = hadoop.Path(root, f"{name.split('=', 1)[1]}.{k}.tsv")
                if not files.rename(hadoop.Path(folder.getPath(), part), target):
                    raise OSError(f"cannot name {target}")


def _finished(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def cached(spark: SparkSession, folder: str, name: str, params: dict, build) -> DataFrame:
    """Stage result keyed by its parameters: read it when a finished write exists, else build it."""
    digest = hashlib.sha256(repr(sorted(params.items())).encode()).hexdigest()[:16]
    path = f"{folder}/{name}-{digest}"
    if not _finished(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
