"""Pipeline stages around the column functions, for use with pyspark.ml pipelines."""

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import functions as F

from textloom.functions import clean
from textloom.functions import tokens as T
from textloom.operators import embed, weights

# Column functions a stage can name; user functions are added with `register`.
FUNCTIONS = {
    "lower_split": clean.lower_split,
    "remove_special_characters": clean.remove_special_characters,
    "remove_stopwords": clean.remove_stopwords,
    "expand_contractions": clean.expand_contractions,
    "normalize": clean.normalize,
    "html_words": clean.html_words,
    "visible_text": clean.visible_text,
    "clean_question": clean.clean_question,
    "clean_social": clean.clean_social,
    "rule_tokens": clean.rule_tokens,
    "isolate_punctuation": clean.isolate_punctuation,
    "strip_wiki": clean.strip_wiki,
    "remove_bracketed": clean.remove_bracketed,
    "sentences": T.sentences,
    "word_tokens": T.word_tokens,
}


def register(name: str, fn):
    """Make a Column -> Column function available to stages under a name."""
    FUNCTIONS[name] = fn
    return fn


class TextStage(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable,
                DefaultParamsWritable):
    """Apply one named column function: an analyser or tokeniser as a pipeline stage."""

    function = Param(Params._dummy(), "function", "name of the column function",
                     TypeConverters.toString)

    def __init__(self, inputCol="text", outputCol="tokens", function="word_tokens"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, function=function)

    def _transform(self, dataset):
        fn = FUNCTIONS[self.getOrDefault(self.function)]
        return dataset.withColumn(self.getOutputCol(), fn(F.col(self.getInputCol())))


class MeanVectorModel(Model, HasInputCol, HasOutputCol):
    """Averages the fitted word vectors of a token column, weighted by idf where it was fitted."""

    def __init__(self, vectors, idf, dim, key, inputCol, outputCol):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)
        self.vectors, self.idf, self.dim, self.key = vectors, idf, dim, key

    def _transform(self, dataset):
        tf = weights.term_counts(
            T.unnest(dataset, [self.key], F.col(self.getInputCol()), "term"), [self.key])
        weighted = weights.weigh(tf, self.idf, key=self.key)
        means = embed.mean_vectors(weighted, self.vectors, self.dim, key=self.key,
                                   weight=F.col("weight"))
        means = means.withColumnRenamed("vec", "_vec")
        zeros = F.array_repeat(F.lit(0.0), self.dim)
        out = dataset.join(means, self.key, "left")
        vec = array_to_vector(F.coalesce("_vec", zeros))
        return out.withColumn(self.getOutputCol(), vec).drop("_vec")


class MeanVectors(Estimator, HasInputCol, HasOutputCol):
    """Fit idf on a token column; the model gives TF-IDF weighted mean word vectors.

    `vectors` is a (word, vec) table and stays a table: nothing is collected. `key` is the row id.
    """

    def __init__(self, vectors, dim, key="doc_id", inputCol="tokens", outputCol="features"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)
        self.vectors, self.dim, self.key = vectors, dim, key

    def _fit(self, dataset):
        tf = weights.term_counts(
            T.unnest(dataset, [self.key], F.col(self.getInputCol()), "term"), [self.key])
        n = dataset.agg(F.count("*")).scalar()
        return MeanVectorModel(self.vectors, weights.idf_table(tf, n), self.dim, self.key,
                               self.getInputCol(), self.getOutputCol())
