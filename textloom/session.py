"""Session settings and the shared checkpoint folder."""

import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus="8", **conf):
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("textloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark) -> str:
    """Folder every executor can reach, as the session names it in spark.checkpoint.dir."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="textloom-")


def checkpoint(df):
    """Cut the lineage through reliable storage, so lost executors cannot change the rows."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stage(df):
    """The rows as a table written to the shared folder: a fitted model, or rows that several steps read.

    A written table has a known size, so Spark can choose the join by it, which a checkpoint does not
    allow; and it survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def cleaned(spark):
    """Once a table is written in here nothing reads the write's shuffles again, so Spark may remove
    their files then; the session's own choice is put back."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def drop(staged):
    """Remove the files of a table that `stage` has written, once nothing reads it any more."""
    spark = staged.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged.inputFiles()[0]).getParent()
    if not folder.getName().startswith("stage-"):
        raise ValueError(f"{folder} is not a staged table")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df, *keys):
    """Split an input of few files over the cluster by row key.

    Text work is heavy per row, so fewer input splits than cores would leave cores idle. An input
    of many splits (any large table) is left alone. Rows that are spread by key keep that
    partitioning, so grouping by the key or by (key, term) later needs no other shuffle.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, *keys) if df.rdd.getNumPartitions() < n else df


def ship(spark):
    """Send this package to the Python workers, once per session, wherever the driver started."""
    context = spark.sparkContext
    if getattr(context, "_textloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="textloom-")) / "textloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(target))
    context._textloom_shipped = True
