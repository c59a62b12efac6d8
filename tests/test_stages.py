from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from textloom.operators import stages


def test_named_functions_in_a_saved_pipeline(spark, tmp_path):
    stages.register("shout", F.upper)
    df = spark.createDataFrame([(1, "It's the Dog, ok")], "doc_id long, text string")
    model = Pipeline(stages=[
        stages.TextStage("text", "clean", "normalize"),
        stages.TextStage("clean", "loud", "shout"),
        stages.TextStage("clean", "tokens", "word_tokens"),
    ]).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    row = PipelineModel.load(str(tmp_path / "m")).transform(df).first()
    assert (row.clean, row.loud, row.tokens) == ("It Dog ok", "IT DOG OK", ["it", "dog", "ok"])


def test_mean_vectors_feed_a_classifier(spark):
    wv = spark.createDataFrame([("up", [1.0, 0.0]), ("down", [0.0, 1.0])],
                               "word string, vec array<double>")
    df = spark.createDataFrame([(i, "up x" if i % 2 else "down y", float(i % 2)) for i in range(8)],
                               "doc_id long, text string, label double")
    p = Pipeline(stages=[stages.TextStage(), stages.MeanVectors(wv, 2), LogisticRegression()])
    out = p.fit(df).transform(df).collect()
    assert len(out) == 8 and all(r.prediction == r.label for r in out)


def test_stream_reads_a_table_of_many_files(spark, tmp_path):
    from textloom.plans import registry

    docs = [(i, f"alpha beta w{i % 3} again w{i % 3}") for i in range(12)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr(
        "*", "'en' AS lang", "'a' AS source", "length(text) AS n_chars")
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    x1 = registry.load()[0]["x1_stream_scoring"]
    found = []
    for files in (1, 3):
        sf = tmp_path / f"t{files}"
        lab.write.parquet(f"{sf}/labels.parquet")
        if files > 1:
            d.repartition(files).write.parquet(f"{sf}/documents.parquet")
        else:
            d.coalesce(1).write.parquet(f"{sf}/parts")
            next((sf / "parts").glob("*.parquet")).rename(sf / "documents.parquet")
        found.append(sorted(map(tuple, x1(spark, str(sf)).collect())))
    assert len(found[0]) == 12 and found[0] == found[1]
