"""Headline timings: prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textloom.operators.select import corpus_size  # noqa: E402
from textloom.plans.registry import load, table  # noqa: E402
from textloom.session import local_session  # noqa: E402

HEADLINE = [
    "top_terms", "c2_remove_special", "c10_clean_question", "t1_annotate", "t14_vocabulary_index",
    "t17_subwords", "v1_sentence_ngrams", "v7_char_ngrams", "v8_tfidf_smooth", "v12_order_weights",
    "e4_mean_vectors", "e13_self_rank", "j6_distance_summary", "m1_multinomial_bayes",
    "m11_knn_cosine", "m20_tournament", "m6_logistic", "m14_linear_text_classifier", "q4_roc_auc",
    "r3_stratified_folds", "x1_stream_scoring",
]
#: Queries that read no document text have no words per second; these read labelled documents only.
NO_TEXT = {"e13_self_rank", "j6_distance_summary", "m11_knn_cosine", "m20_tournament",
           "r3_stratified_folds"}
LABELLED = {"m6_logistic", "m14_linear_text_classifier", "q4_roc_auc"}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    picked = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    queries, _ = load()
    queries["v4_term_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in picked:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    docs = table(spark, sf_dir, "documents")
    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    words, labelled_words = (corpus_size(d).first()["n_words"] for d in (docs, labelled))
    rates = {n: round((labelled_words if n in LABELLED else words) / s / int(cpus))
             for n, s in seconds.items() if n not in NO_TEXT}
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": int(cpus), "words": words,
        "labelled_words": labelled_words, "words_per_sec_per_core": rates}))


if __name__ == "__main__":
    main()
