"""Queries over pyspark.ml estimators; their results are checked by invariants, not by SQL."""

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes,
    RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import tokens as T
from textloom.operators import embed, evaluate, ftest, learn, split
from textloom.operators import weights as V
from textloom.operators.svd import TruncatedSVD
from textloom.operators.terms import TermBlocks
from textloom.plans.features import n_docs
from textloom.plans.ranking import top_and_bottom
from textloom.plans.registry import TF, query, table
from textloom.plans.tokenizing import DIM, docs, term_blocks, word_vectors
from textloom.session import checkpoint, drop, stage

SIZE = 1 << 15
TERMS = 50_000


def labelled_texts(spark, sf):
    """Labelled documents with y as a double and a 70/30 split."""
    lab = table(spark, sf, "labels")
    d = docs(spark, sf).join(lab, "doc_id").withColumn("y", F.col("quality").cast("double"))
    return split.random_split(d.select("doc_id", "text", "lang", "y", "toxic"), "doc_id", 0.3, "ml")


def labelled_docs(spark, sf, n=1):
    """The same with tokens in place of texts."""
    return learn.with_tokens(labelled_texts(spark, sf), n=n).drop("text")


def _parts(df):
    return df.filter("split = 'train'"), df.filter("split = 'test'")


def _predict(spark, sf, classifier, idf=True, binary=False, stages=None):
    train, test = _parts(labelled_docs(spark, sf))
    stages = stages or learn.text_stages(SIZE, idf, binary)
    p = learn.fit_predict([*stages, classifier], train, test)
    return p.select("doc_id", F.col("y").cast("int").alias("y"), "pred")


@query("m2_bernoulli_bayes")
def m2(spark, sf):
    return _predict(spark, sf, NaiveBayes(labelCol="y", modelType="bernoulli"), idf=False,
                    binary=True)


@query("m6_logistic")
def m6(spark, sf):
    return _predict(spark, sf, LogisticRegression(
        labelCol="y", elasticNetParam=0.5, regParam=0.005, maxIter=15))


@query("m7_linear_svm")
def m7(spark, sf):
    return _predict(spark, sf, LinearSVC(labelCol="y", regParam=0.01, maxIter=15))


@query("m8_sgd_losses")
def m8(spark, sf):
    """Mini-batch gradient steps on log and hinge loss with an L2 penalty, side by side."""
    train, test = _parts(labelled_docs(spark, sf))
    model = Pipeline(stages=learn.text_stages(SIZE)).fit(train)
    train, test = (checkpoint(model.transform(p).select("doc_id", "y", "features"))
                   for p in (train, test))
    out = test.select("doc_id", F.col("y").cast("int").alias("y"))
    for loss in ("log", "hinge"):
        found = learn.sgd(train, test, loss)
        out = out.join(found.withColumnRenamed("pred", f"pred_{loss}"), "doc_id")
    return out


def _small():
    return learn.text_stages(256)


@query("m9_random_forest")
def m9(spark, sf):
    return _predict(spark, sf, RandomForestClassifier(labelCol="y", numTrees=20, seed=1),
                    stages=_small())


@query("m10_decision_tree")
def m10(spark, sf):
    return _predict(spark, sf, DecisionTreeClassifier(labelCol="y", seed=1), stages=_small())


@query("m10_boosted_trees")
def m10_gbt(spark, sf):
    return _predict(spark, sf, GBTClassifier(labelCol="y", maxIter=5, seed=1), stages=_small())


@query("m12_one_vs_rest")
def m12(spark, sf):
    d = labelled_docs(spark, sf)
    names = ["is_en", "is_fr", "is_toxic"]
    d = d.withColumns({
        "is_en": (F.col("lang") == "en").cast("double"),
        "is_fr": (F.col("lang") == "fr").cast("double"),
        "is_toxic": F.col("toxic").cast("double")})
    train, test = _parts(d)
    found = learn.one_vs_rest(learn.text_stages(SIZE), learn.CLASSIFIERS["svm"], train, test, names)
    listed = F.array_compact(F.array(*[F.when(F.col(n) == 1, F.lit(n)) for n in names]))
    true = test.select("doc_id", F.explode(listed).alias("label"))
    return evaluate.multilabel_scores(true, found, ["doc_id"])


@query("m13_stacking")
def m13(spark, sf):
    d = split.stratified_folds(labelled_docs(spark, sf), "y", "doc_id", 3, "stack")
    base = {"p_logistic": learn.CLASSIFIERS["logistic"]("y"),
            "p_bayes": learn.CLASSIFIERS["bayes"]("y")}
    p = learn.stack(base, d, 3, learn.text_stages(SIZE))
    return p.select("doc_id", F.col("y").cast("int").alias("y"), "pred", "p_logistic", "p_bayes")


@query("m14_linear_text_classifier")
def m14(spark, sf):
    """Hashed word uni- and bigrams into a multinomial linear model; P@1 and R@1 for language."""
    d = checkpoint(labelled_docs(spark, sf, n=2).drop("y"))
    train, test = _parts(d)
    p = learn.fit_predict([
        learn.label_indexer("lang"), *learn.text_stages(SIZE, idf=False),
        LogisticRegression(labelCol="y", family="multinomial", regParam=0.001, maxIter=10)],
        train, test)
    hits = p.select((F.col("pred") == F.col("y").cast("int")).cast("int").alias("hit"))
    return hits.agg(F.count("*").alias("n"), F.avg("hit").alias("p_at_1"),
                    F.avg("hit").alias("r_at_1"))


@query("m23_top_labels")
def m23(spark, sf):
    """The three likeliest languages of each test document with their probabilities."""
    train, test = _parts(labelled_docs(spark, sf).drop("y"))
    model = Pipeline(stages=[
        learn.label_indexer("lang"), *learn.text_stages(SIZE, idf=False),
        LogisticRegression(labelCol="y", family="multinomial", regParam=0.001, maxIter=10),
    ]).fit(train)
    return learn.top_labels(model.transform(test), model.stages[0].labels, 3)


@query("m16_topics")
def m16(spark, sf):
    d = learn.with_tokens(docs(spark, sf).select("doc_id", "text")).drop("text")
    return learn.topics(d, 5, 10, vocab_size=TERMS, min_df=2.0, iterations=5)


@query("m19_informative_features")
def m19(spark, sf):
    c = learn.coefficients(labelled_docs(spark, sf), vocab_size=TERMS, min_df=2.0)
    return top_and_bottom(c.drop("idf"), "coefficient", "term", 20)


@query("m19_contributions")
def m19_contributions(spark, sf):
    """Ten strongest terms of each labelled document: tf times idf times coefficient."""
    d = labelled_docs(spark, sf)
    c = learn.coefficients(d, vocab_size=TERMS, min_df=2.0)
    tf = V.term_counts(d.select("doc_id", F.explode("tokens").alias("term")), ["doc_id"])
    w = tf.join(c, "term").withColumn("weight", F.col("tf") * F.col("idf") * F.col("coefficient"))
    best = Window.partitionBy("doc_id").orderBy(F.desc(F.abs("weight")), "term")
    return w.withColumn("rank", F.row_number().over(best)).filter("rank <= 10").select(
        "doc_id", "rank", "term", "weight")


@query("m22_grid_search")
def m22(spark, sf):
    d = split.stratified_folds(labelled_docs(spark, sf), "y", "doc_id", 3, "grid")
    scores, _ = learn.grid_search(
        d.select("tokens", "y", "fold"), LogisticRegression(labelCol="y", maxIter=5),
        {"regParam": [0.01, 0.1], "elasticNetParam": [0.0, 1.0]}, 3, learn.text_stages(SIZE))
    return scores


@query("r7_learning_curve")
def r7(spark, sf):
    models = {"bayes": [*learn.text_stages(SIZE, idf=False), learn.CLASSIFIERS["bayes"]("y")]}
    d = labelled_docs(spark, sf).select("doc_id", "tokens", "y")
    return learn.learning_curve(d, models, [20, 40, 60], 3)


def labelled_counts(spark, sf, lab):
    """Term counts of the documents in `lab`; other texts are left out before they are tokenised."""
    d = docs(spark, sf).select("doc_id", "text").join(lab.select("doc_id"), "doc_id", "left_semi")
    return V.term_counts(T.unnest(d, ["doc_id"], T.word_tokens(F.col("text")), "term"), ["doc_id"])


@query("v20_truncated_svd")
def v20(spark, sf):
    """100 components of every document's TF-IDF weights over the whole vocabulary."""
    t = term_blocks(spark, sf)
    cells = t.weighed(V.idf_of(t.vocabulary(), n_docs(spark, sf)))
    drop(t.blocks)
    return TruncatedSVD(cells, 100).transform(cells)


@query("v21_pca")
def v21(spark, sf):
    p = learn.pca(table(spark, sf, "embeddings"), "embedding", 5)
    return p.select("vec_id", F.posexplode("components").alias("component", "value"))


def labelled_quality(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"))


@query("v23_f_values", f"""
WITH {TF}, lab AS (SELECT doc_id, quality AS y FROM labels WHERE quality IS NOT NULL),
size AS (SELECT y, count(*)::DOUBLE AS m FROM lab GROUP BY y),
p AS (SELECT term, y, sum(tf)::DOUBLE AS s, sum(tf * tf)::DOUBLE AS q FROM tf JOIN lab USING (doc_id) GROUP BY ALL),
t AS (SELECT term, sum(q) AS q, sum(s) AS s, sum(s * s / m) AS b FROM p JOIN size USING (y) GROUP BY term),
n AS (SELECT sum(m) AS n, count(*) AS k FROM size),
f AS (SELECT term, q, greatest(b - s * s / n, 0) AS b, greatest(q - b, 0) AS w, n, k FROM t, n)
SELECT term, CASE WHEN w <= q * 1e-12 THEN CASE WHEN b > q * 1e-12 THEN 'Infinity'::DOUBLE END
  ELSE round(b / (k - 1) / (w / (n - k)), 5) END AS f_value FROM f""")
def v23_f(spark, sf):
    lab = labelled_quality(spark, sf)
    found, _ = ftest.f_values(labelled_counts(spark, sf, lab), lab, "y", "tf")
    return found.select("term", F.round("f_value", 5).alias("f_value"))


@query("v23_select_fpr")
def v23(spark, sf):
    """TF-IDF weights of the labelled documents, of terms whose F-test is below 0.05."""
    lab = labelled_quality(spark, sf)
    tf = labelled_counts(spark, sf, lab)
    weights = stage(V.weigh(tf, V.idf_table(tf, F.lit(lab.count()))))
    return ftest.select_terms(weights, lab, "y")


@query("v24_polynomial")
def v24(spark, sf):
    p = table(spark, sf, "embeddings").withColumn(
        "v", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    return learn.polynomial(p, "v").select("vec_id", vector_to_array("expanded").alias("expanded"))


@query("e3_train_word_vectors")
def e3(spark, sf):
    d = learn.with_tokens(docs(spark, sf).select("text")).drop("text")
    model = learn.train_word_vectors(d, dim=100, min_count=5)
    return model.getVectors().select(
        "word", F.posexplode(vector_to_array("vector")).alias("dim", "value"))


@query("e12_document_vectors")
def e12(spark, sf):
    d = learn.with_tokens(docs(spark, sf).select("doc_id", "text")).drop("text")
    model = learn.train_word_vectors(d, dim=100, min_count=5)
    return model.transform(d).select(
        "doc_id", F.posexplode(vector_to_array("vec")).alias("dim", "value"))


@query("e17_product_codes")
def e17(spark, sf):
    c = learn.product_codes(table(spark, sf, "embeddings").select("vec_id", "embedding"),
                            "embedding", DIM, 2)
    return c.select("vec_id", F.posexplode("codes").alias("slice", "code"))


@query("model_comparison")
def model_comparison(spark, sf):
    """The textbook comparison: two classifiers on counts, TF-IDF and averaged word vectors."""
    d = stage(labelled_texts(spark, sf).drop("lang", "toxic"))
    rows = d.drop("text")
    mine = docs(spark, sf).select("doc_id", "text").join(rows.select("doc_id"), "doc_id", "left_semi")
    t = TermBlocks(mine, T.word_tokens(F.col("text")))
    wv = stage(word_vectors(spark, sf))
    idf = V.idf_of(t.vocabulary(), n_docs(spark, sf))
    means = {
        "mean_vectors": embed.block_means(t, wv, DIM),
        "tfidf_vectors": embed.block_means(t, wv, DIM, idf),
    }
    # Tokens are hashed as they are read and kept nowhere; both classifiers read the same counts.
    tokens, names, runs = learn.with_tokens(d), ("bayes", "svm"), []
    for kind, use_idf in (("counts", False), ("tfidf", True)):
        models = [learn.CLASSIFIERS[name]("y") for name in names]
        ready, stages = learn.prepared(tokens, [*learn.text_stages(SIZE, use_idf), *models], rows.columns)
        stages = stages[:len(stages) - len(models)]
        runs += [(name, kind, [*stages, model], ready) for name, model in zip(names, models)]
    for kind, m in means.items():
        x = checkpoint(rows.join(m, "doc_id").select(*rows.columns, array_to_vector("vec").alias("features")))
        runs.append(("svm", kind, [learn.CLASSIFIERS["svm"]("y")], x))
    parts = []
    for name, kind, stages, data in runs:
        train, test = _parts(data)
        p = learn.fit_predict(stages, train, test)
        parts.append(p.select(F.lit(name).alias("model"), F.lit(kind).alias("features"),
                              F.col("y").cast("int").alias("y"), "pred"))
    return evaluate.weighted_scores(evaluate.union_all(parts), by=["model", "features"])
