"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (session, documents, table folder) and works on all that the stage before kept; it is
written as Parquet in the shared folder and read again. All but the last return the columns of
`documents`, with texts and lengths as the stage left them. A document whose words were all removed
goes with them; a document that came in without words stays.
"""

import os
import sys
import uuid

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textloom.llm import decontam, jaccard, packing, quality, substring  # noqa: E402
from textloom.session import shared_dir, ship  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_bad(spark, docs, sf_dir):
    """Documents under their language's perplexity cut."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs.select(*COLUMNS), labels)


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of every group of linked ones."""
    ship(spark)
    return jaccard.keep_one(docs.select(*COLUMNS))


def cut_repeats(spark, docs, sf_dir):
    """Texts without the passages that an earlier document has."""
    ship(spark)
    cut = substring.substring_dedup(docs, "lang", "source")
    cut = cut.filter((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def cut_benchmark(spark, docs, sf_dir):
    """Texts without the benchmark's passages."""
    ship(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.scan(docs.select(*COLUMNS), benchmark, "text", "lang", "source", "n_chars")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    found = found.filter((hit < F.col("n_words")) | (F.col("n_words") == 0))
    changed = F.col("cleaned").isNotNull()
    return found.withColumns({
        "text": F.coalesce("cleaned", "text"),
        "n_chars": F.when(changed, F.char_length("cleaned").cast("long")).otherwise(
            F.col("n_chars"))}).select(*COLUMNS)


def pack_sequences(spark, docs, sf_dir):
    """The kept documents as pieces of training sequences, with their ids."""
    ship(spark)
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality classifier", reject_bad),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", cut_benchmark),
    ("packing", pack_sequences),
]

#: Trained perplexities and tokenizers are beyond SQL; tests/llm holds the stages to brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of a table folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
