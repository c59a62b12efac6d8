"""Classifiers, decompositions and selections with pyspark.ml."""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.clustering import LDA
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    IDF, PCA, CountVectorizer, HashingTF, Normalizer, PolynomialExpansion, StringIndexer,
    VectorAssembler, Word2Vec)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.mllib.classification import LogisticRegressionWithSGD, SVMWithSGD
from pyspark.mllib.regression import LabeledPoint
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import tokens as T
from textloom.operators import split
from textloom.session import checkpoint


def with_tokens(df: DataFrame, text="text", n=1) -> DataFrame:
    """Add the array of word n-grams 1..n that the hashing stages read."""
    return df.withColumn("tokens", T.ngrams(T.word_tokens(F.col(text)), 1, n))


def text_stages(n_features=4096, idf=True, binary=False, out="features"):
    """Hashed counts, weighted and scaled to unit length. Hashing keeps no vocabulary anywhere."""
    if not idf:
        return [HashingTF(inputCol="tokens", outputCol=out, numFeatures=n_features, binary=binary)]
    return [
        HashingTF(inputCol="tokens", outputCol="counts", numFeatures=n_features, binary=binary),
        IDF(inputCol="counts", outputCol="weighted"),
        Normalizer(inputCol="weighted", outputCol=out),
    ]


def fit_predict(stages, train: DataFrame, test: DataFrame, label="y") -> DataFrame:
    """Predictions of a pipeline on the test rows, with an integer `pred`."""
    model = Pipeline(stages=stages).fit(train)
    return model.transform(test).withColumn("pred", F.col("prediction").cast("int"))


def by_fold(stages, folded: DataFrame, k: int) -> DataFrame:
    """Out-of-fold predictions: one fit per fold, results appended."""
    parts = [fit_predict(stages, folded.filter(F.col("fold") != i),
                         folded.filter(F.col("fold") == i)) for i in range(k)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def grid_search(df: DataFrame, classifier, grid: dict, k: int, stages=(), label="y"):
    """Mean cross-validated F1 per setting, on the folds of the `fold` column; the best first."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(classifier.getParam(name), values)
    maps = builder.build()
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="f1")
    cv = CrossValidator(
        estimator=Pipeline(stages=[*stages, classifier]), estimatorParamMaps=maps, evaluator=judge,
        numFolds=k, foldCol="fold", parallelism=4)
    model = cv.fit(df)
    rows = [(*[float(m[classifier.getParam(n)]) for n in grid], float(s))
            for m, s in zip(maps, model.avgMetrics)]
    schema = ", ".join(f"`{n}` double" for n in grid) + ", f1 double"
    scores = df.sparkSession.createDataFrame(rows, schema).orderBy(F.desc("f1"), *grid)
    return scores, model.bestModel


def one_vs_rest(stages, classifier_for, train, test, labels, key="doc_id") -> DataFrame:
    """One binary model per label column; (key, label) rows that were predicted."""
    train, test = checkpoint(train), checkpoint(test)
    parts = []
    for label in labels:
        p = fit_predict([*stages, classifier_for(label)], train, test, label)
        parts.append(p.filter("pred = 1").select(key, F.lit(label).alias("label")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def prepared(df: DataFrame, stages, columns):
    """(rows, the other stages): the leading stages that need no fit are applied once, and only `columns` and
    what the other stages read are kept. Hashed counts are far smaller than their tokens."""
    n = next((i for i, s in enumerate(stages) if not isinstance(s, Transformer)), len(stages))
    rest = stages[n:]
    made = PipelineModel(stages=stages[:n]).transform(df)
    read = [s.getOrDefault(p) for s in rest for p in ("inputCol", "featuresCol") if s.hasParam(p) and (
        s.isSet(p) or s.hasDefault(p))]
    return checkpoint(made.select(*dict.fromkeys([*columns, *[c for c in read if c in made.columns]]))), rest


def stack(base_models: dict, folded: DataFrame, k: int, stages, key="doc_id", label="y"):
    """Out-of-fold probabilities of the base models as features of a logistic model, with their
    degree-2 products."""
    ready, stages = prepared(folded, [*stages, *base_models.values()], [key, label, "fold"])
    stages = stages[:len(stages) - len(base_models)]
    found = {name: [] for name in base_models}
    for i in range(k):  # the models of a fold share its fitted features
        train, test = ready.filter(F.col("fold") != i), ready.filter(F.col("fold") == i)
        features = Pipeline(stages=stages).fit(train)
        for name, model in base_models.items():
            p = model.fit(features.transform(train)).transform(features.transform(test))
            found[name].append(p.select(key, vector_to_array("probability")[1].alias(name)))
    joined = ready.select(key, label, "fold")
    for parts in found.values():
        joined = joined.join(checkpoint(reduce(lambda a, b: a.unionByName(b), parts)), key)
    joined = checkpoint(joined)  # every fit below reads the probabilities again
    features = [
        VectorAssembler(inputCols=list(base_models), outputCol="probas"),
        PolynomialExpansion(degree=2, inputCol="probas", outputCol="features"),
        LogisticRegression(labelCol=label, regParam=0.01, maxIter=10),
    ]
    return by_fold(features, joined, k)


def learning_curve(df: DataFrame, stages_for: dict, sizes, repeats, key="doc_id", label="y"):
    """Accuracy of each model when `n` labelled rows train it: mean over stratified shuffles."""
    n_all, parts = None, []
    for name, stages in stages_for.items():
        ready, rest = prepared(df.withColumn("_row", F.monotonically_increasing_id()), stages, [key, label, "_row"])
        n_all = ready.count() if n_all is None else n_all
        # Shuffles rank narrow rows; a document's features move once, for all of them.
        ranks = checkpoint(ready.select("_row", key, label))
        for r in range(repeats):
            ranks = split.shuffled_shares(ranks, label, key, f"_rank{r}", "_n", seed=f"curve{r}")
        placed = checkpoint(ready.join(ranks.drop(key, label), "_row"))
        for r in range(repeats):
            for n in sizes:
                is_train = F.col(f"_rank{r}") <= F.floor(F.lit(n / n_all) * F.col("_n"))
                p = fit_predict(rest, placed.filter(is_train), placed.filter(~is_train))
                parts.append(p.select(
                    F.lit(name).alias("model"), F.lit(n).alias("train_size"),
                    F.lit(r).alias("repeat"), (F.col("pred") == F.col(label)).cast("int")
                    .alias("hit")))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    each = every.groupBy("model", "train_size", "repeat").agg(F.avg("hit").alias("accuracy"))
    return each.groupBy("model", "train_size").agg(F.avg("accuracy").alias("accuracy"))


def pca(df: DataFrame, vec: str, k: int) -> DataFrame:
    as_vector = df.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(as_vector)
    return model.transform(as_vector).withColumn("components", vector_to_array("_p")).drop(
        "_v", "_p")


def polynomial(df: DataFrame, features: str, degree=2, out="expanded") -> DataFrame:
    return PolynomialExpansion(degree=degree, inputCol=features, outputCol=out).transform(df)


def train_word_vectors(df: DataFrame, dim=100, window=5, min_count=5, epochs=1, partitions=None):
    """Skip-gram word vectors; the vocabulary that passes `min_count` must fit on the driver.

    Each partition shuffles its own copy of the vectors, so by default there are no more than run at once."""
    spark = df.sparkSession
    partitions = partitions or min(int(spark.conf.get("spark.sql.shuffle.partitions")),
                                   spark.sparkContext.defaultParallelism)
    return Word2Vec(
        vectorSize=dim, windowSize=window, minCount=min_count, maxIter=epochs, seed=1,
        numPartitions=partitions, inputCol="tokens", outputCol="vec").fit(df)


def topics(df: DataFrame, k: int, top=10, vocab_size=5000, min_df=2.0, iterations=5) -> DataFrame:
    """Top words of each topic."""
    counts = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=vocab_size,
                             minDF=min_df).fit(df)
    model = LDA(k=k, maxIter=iterations, seed=1, optimizer="online").fit(counts.transform(df))
    words = df.sparkSession.createDataFrame(
        list(enumerate(counts.vocabulary)), "termIndices int, term string")
    t = model.describeTopics(top).select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
    return t.select("topic", "rank", "t.*").join(words, "termIndices").select(
        "topic", "rank", "term", F.col("termWeights").alias("weight"))


def coefficients(df: DataFrame, label="y", vocab_size=5000, min_df=2.0) -> DataFrame:
    """(term, idf, coefficient) of a logistic model on word counts times idf."""
    model = Pipeline(stages=[
        CountVectorizer(inputCol="tokens", outputCol="counts", vocabSize=vocab_size, minDF=min_df),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(labelCol=label, regParam=0.1, maxIter=10),
    ]).fit(df)
    fitted = zip(model.stages[0].vocabulary, model.stages[1].idf.toArray(),
                 model.stages[2].coefficients.toArray())
    return df.sparkSession.createDataFrame(
        [(t, float(i), float(c)) for t, i, c in fitted],
        "term string, idf double, coefficient double")


def slice_codes(x, centres, rows=512):
    """Nearest centre of every row's slices: x is (rows, slices, sub), centres (slices, k, sub)."""
    norms = (centres ** 2).sum(2)
    codes = [(norms - 2 * np.einsum("nsd,skd->nsk", x[a:a + rows], centres)).argmin(2)
             for a in range(0, len(x), rows)]
    return np.concatenate(codes) if codes else np.zeros((0, len(centres)), int)


def product_codes(df: DataFrame, vec: str, dim: int, sub: int, k=256, iterations=25,
                  key="vec_id") -> DataFrame:
    """Code of each slice of `sub` dimensions: its nearest among the slice's `k` k-means centres.

    All slices are fitted together: a step is one job that sums, by slice and centre, the rows
    nearest to it. Centres (dim * k numbers) start from the k rows of least key hash; only they
    and their sums pass through the driver. A centre that no row is nearest to stays. Vectors that
    are null, of another length or hold null or non-finite components have no code.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.transform(vec, lambda x: x.cast("double")).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | x.isNaN() | (F.abs(x) == float("inf")))
    rows = checkpoint(rows.filter((F.size("v") == dim) & ~bad))
    first = rows.orderBy(F.xxhash64(key), key).limit(k).collect()
    shape = (-1, dim // sub, sub)
    centres = np.array([r.v for r in first]).reshape(shape).transpose(1, 0, 2).copy()

    def slices(pdf):
        return np.array(pdf["v"].tolist()).reshape(shape)

    def summing(now):
        def run(batches):
            total, n = np.zeros_like(now), np.zeros(now.shape[:2], np.int64)
            for pdf in batches:
                x = slices(pdf)
                codes = slice_codes(x, now)
                for s in range(len(now)):
                    np.add.at(total[s], codes[:, s], x[:, s])
                    np.add.at(n[s], codes[:, s], 1)
            s, c = np.nonzero(n)
            if len(s):  # a part of the table may have no rows
                yield pd.DataFrame({"slice": s, "centre": c, "n": n[s, c], "total": list(total[s, c])})
        return run

    sums = [F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(sub)]
    for _ in range(iterations if first else 0):
        parts = rows.select("v").mapInPandas(
            summing(centres), "slice int, centre int, n long, total array<double>")
        moved = centres.copy()
        for r in parts.groupBy("slice", "centre").agg(F.sum("n").alias("n"), *sums).collect():
            moved[r.slice, r.centre] = [r[f"t{j}"] / r.n for j in range(sub)]
        if np.allclose(moved, centres, rtol=0, atol=1e-12):
            break
        centres = moved

    def coded(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "codes": list(slice_codes(slices(pdf), centres))})

    return rows.mapInPandas(coded, f"`{key}` {kind}, codes array<int>")


def sgd(train: DataFrame, test: DataFrame, loss: str, label="y", key="doc_id",
        features="features", steps=100, share=0.1, l2=0.01) -> DataFrame:
    """(key, pred) of a linear model fitted by mini-batch gradient steps on log or hinge loss."""
    trainer = {"log": LogisticRegressionWithSGD, "hinge": SVMWithSGD}[loss]
    points = MLUtils.convertVectorColumnsFromML(train.select(label, features), features)
    model = trainer.train(
        points.rdd.map(lambda r: LabeledPoint(r[0], r[1])), iterations=steps,
        miniBatchFraction=share, regParam=l2, regType="l2", intercept=True)
    rows = MLUtils.convertVectorColumnsFromML(test.select(key, features), features)
    kind = test.schema[key].dataType.simpleString()
    found = rows.rdd.map(lambda r: (r[0], int(model.predict(r[1]))))
    return test.sparkSession.createDataFrame(found, f"`{key}` {kind}, pred int")


def top_labels(predicted: DataFrame, names, k: int, key="doc_id", probability="probability"):
    """The k likeliest labels of each row with their probabilities; ties in the order of `names`."""
    each = F.transform(vector_to_array(probability), lambda p, i: F.struct(
        (-p).alias("below"), i.alias("i")))
    best = predicted.select(key, F.posexplode(F.slice(F.array_sort(each), 1, k)).alias("r", "b"))
    return best.select(
        key, (F.col("r") + 1).alias("rank"),
        F.get(F.array(*map(F.lit, names)), F.col("b.i")).alias("label"),
        (-F.col("b.below")).alias("probability"))


CLASSIFIERS = {
    "logistic": lambda y: LogisticRegression(labelCol=y, regParam=0.01, maxIter=10),
    "svm": lambda y: LinearSVC(labelCol=y, regParam=0.01, maxIter=10),
    "bayes": lambda y: NaiveBayes(labelCol=y, modelType="multinomial"),
}


def label_indexer(label: str, out="y") -> StringIndexer:
    return StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc")
