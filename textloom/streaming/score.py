"""Scoring a stream of documents against a fitted count model."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import clean
from textloom.functions import tokens as T
from textloom.session import spread


def document_terms(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """Term counts of cleaned documents."""
    cleaned = clean.remove_special_characters(F.col(text))
    t = T.unnest(docs, [key], T.word_tokens(cleaned), "term")
    return t.groupBy(key, "term").agg(F.count("*").alias("tf"))


def read_documents(spark: SparkSession, folder: str, schema, pattern="*.parquet", max_files=None):
    """Stream of the documents in a folder's files; `max_files` limits one micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def score_stream(docs: DataFrame, model, out: str, progress: str, key="doc_id", trigger=None):
    """Score every micro-batch with the batch operators and write it under its own number.

    No state is kept between batches. A batch that is replayed after a failure overwrites its own
    folder, so each document is written once.
    """

    def write(batch: DataFrame, number: int):
        scored = model.predict(document_terms(spread(batch, key), key)).select(key, "pred", "score")
        scored.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        docs.writeStream.foreachBatch(write)
        .option("checkpointLocation", progress)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
