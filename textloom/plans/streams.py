"""Streaming query (X-1)."""

from pyspark.sql import functions as F

from textloom.functions import constants as K
from textloom.plans.cleaning import special
from textloom.plans.probability import COUNTS, count_model
from textloom.plans.registry import TF, query, table
from textloom.plans.sourcing import scratch
from textloom.streaming import score


@query("x1_stream_scoring", f"""
WITH {TF}, {COUNTS}, ct AS (
  SELECT doc_id, unnest(regexp_extract_all(lower({special('text')}), '{K.WORD_2PLUS}')) AS term
  FROM documents), ctf AS (SELECT doc_id, term, count(*) AS tf FROM ct GROUP BY ALL),
s AS (SELECT doc_id, c.y AS cls, any_value(ln(prior))
    + sum(tf * (ln(coalesce(n, 0) + 1.0::DOUBLE) - ln((n_words + v.v)::DOUBLE))) AS s
  FROM ctf CROSS JOIN totals c JOIN prior ON prior.y = c.y CROSS JOIN v
  LEFT JOIN train_tf t ON t.term = ctf.term AND t.y = c.y GROUP BY ALL)
SELECT doc_id, arg_max(cls, (round(s, 6), -cls)) AS pred, round(max(round(s, 6)), 3) AS score
FROM s GROUP BY doc_id""")
def x1(spark, sf):
    model, _, _ = count_model(spark, sf)
    schema = table(spark, sf, "documents").schema
    # A pattern meets the table as one file and as a folder of files.
    stream = score.read_documents(spark, f"{sf}/[d]ocuments.parquet", schema)
    out = scratch(spark, "scored")
    running = score.score_stream(stream, model, out, scratch(spark, "progress"))
    running.awaitTermination()
    return spark.read.parquet(out).select("doc_id", "pred", F.round("score", 3).alias("score"))
