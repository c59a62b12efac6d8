"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from textloom.llm import (
    chat,
    clustering,
    decontam,
    jaccard,
    katz,
    neighbours,
    packing,
    quality,
    substring,
    tokencount,
    toxicity,
    turns,
    urlfilter,
)

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_pack_sequences")
def pack_sequences(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


@query("op2_katz_backoff")
def katz_backoff(spark, sf_dir):
    return katz.train_and_score(table(spark, sf_dir, "documents"))[0]


@query("op3_chat_round_trip", chat.SQL)
def chat_round_trip(spark, sf_dir):
    turns = chat.with_probe(table(spark, sf_dir, "conversations"))
    return chat.digest(chat.format_chats(turns))


@query("op4_quality_kneser_ney")
def quality_kneser_ney(spark, sf_dir):
    judged = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.drop("row_key")


@query("op5_toxicity_crf")
def toxicity_crf(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_nn_descent")
def nn_descent(spark, sf_dir):
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


@query("op7_substring_dedup", substring.SQL)
def substring_dedup(spark, sf_dir):
    return substring.substring_dedup(table(spark, sf_dir, "documents")).drop("text")


@query("op8_token_counts")
def token_counts(spark, sf_dir):
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


@query("op9_jaccard_components", jaccard.SQL)
def jaccard_components(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query("op10_benchmark_decontamination", decontam.SQL)
def benchmark_decontamination(spark, sf_dir):
    return decontam.digest(decontam.scan(table(spark, sf_dir, "documents"),
                                         table(spark, sf_dir, "benchmark")))


@query("op11_url_filter", urlfilter.SQL)
def url_filter(spark, sf_dir):
    return urlfilter.judge(table(spark, sf_dir, "pages")).drop("terms")


@query("op12_turn_repair", turns.SQL)
def turn_repair(spark, sf_dir):
    return turns.repair(turns.damage(table(spark, sf_dir, "conversations")))


@query("op13_centroid_clustering", clustering.SQL)
def centroid_clustering(spark, sf_dir):
    return clustering.summary(*clustering.cluster(table(spark, sf_dir, "embeddings")))
