"""The flagship query: clean, tokenise, count, weigh, rank."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import clean
from textloom.functions import constants as K
from textloom.functions import tokens as T
from textloom.operators import weights as V
from textloom.operators.terms import TermBlocks
from textloom.plans.cleaning import special
from textloom.plans.registry import query


@query("top_terms", f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower({special('text')}), '{K.WORD_2PLUS}'))
  AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
idf AS (SELECT term, 1 + ln((1 + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + count(*))) AS idf
  FROM tf GROUP BY term),
w AS (SELECT doc_id, term, round(tf * idf / sqrt(sum(tf * idf * tf * idf)
  OVER (PARTITION BY doc_id)), 6) AS weight FROM tf JOIN idf USING (term)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term)::INTEGER AS rank
  FROM w) SELECT doc_id, term, weight, rank FROM r WHERE rank <= 5""")
def top_terms(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    cleaned = clean.remove_special_characters(F.col("text"))
    t = TermBlocks(d, T.word_tokens(cleaned))
    n = d.agg(F.count("*")).scalar()
    w = t.weigh(V.idf_of(t.vocabulary(), n)).withColumn("weight", F.round("weight", 6))
    best = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term")
    ranked = w.withColumn("rank", F.row_number().over(best)).filter("rank <= 5")
    return ranked.select("doc_id", "term", "weight", "rank")
