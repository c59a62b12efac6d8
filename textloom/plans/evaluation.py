"""Evaluation queries (Q-*) over labelled documents and a text-quality score."""

from pyspark.sql import functions as F

from textloom.functions import constants as K
from textloom.functions import tokens as T
from textloom.operators import evaluate as Q
from textloom.operators import pairs, split
from textloom.plans.ranking import (
    GOLD, LANGS, PREDICTED, _HIT, _hits, gold, predicted_pairs)
from textloom.plans.registry import query, table
from textloom.plans.tokenizing import docs

# The score is the share of letters and spaces; a document is called good above 0.92.
SCORED = r"""scored AS (SELECT doc_id, quality AS y,
    round(length(regexp_replace(text, '[^\p{L} ]', '', 'g')) / length(text)::DOUBLE, 6) AS score
  FROM documents JOIN labels USING (doc_id)),
judged AS (SELECT doc_id, y, score, CASE WHEN score >= 0.92 THEN 1 ELSE 0 END AS pred FROM scored),
folds AS (SELECT *, ((row_number() OVER (PARTITION BY y ORDER BY md5(doc_id || '|cv'), doc_id) - 1)
  % 5)::INTEGER AS fold FROM judged)"""

REPORT = """cls AS (SELECT {by} c AS cls, count(*) FILTER (y = c AND pred = c) AS tp,
    count(*) FILTER (pred = c) AS predicted, count(*) FILTER (y = c) AS support
  FROM {src}, (VALUES (0), (1)) AS k(c) GROUP BY ALL),
report AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted::DOUBLE ELSE 0 END AS p,
    CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS r FROM cls),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM report)"""


def judged(spark, sf):
    d = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    score = F.round(F.length(F.regexp_replace("text", r"[^\p{L} ]", "")) / F.length("text"), 6)
    s = d.select("doc_id", F.col("quality").alias("y"), score.alias("score"))
    return s.withColumn("pred", F.when(F.col("score") >= 0.92, 1).otherwise(0))


def folded(spark, sf):
    return split.stratified_folds(judged(spark, sf), "y", "doc_id", 5, "cv")


@query("q1_weighted_scores", f"""
WITH {SCORED}, {REPORT.format(by='', src='judged')}
SELECT round(sum(tp) / sum(support)::DOUBLE, 3) AS accuracy,
  round(sum(p * support) / sum(support), 3) AS precision,
  round(sum(r * support) / sum(support), 3) AS recall,
  round(sum(f1 * support) / sum(support), 3) AS f1 FROM f""")
def q1(spark, sf):
    return Q.weighted_scores(judged(spark, sf))


@query("q2_positive_scores", f"""
WITH {SCORED}, c AS (SELECT count(*) FILTER (y = 1 AND pred = 1) AS tp,
  count(*) FILTER (y <> 1 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred <> 1) AS fn,
  count(*) FILTER (y <> 1 AND pred <> 1) AS tn FROM judged),
r AS (SELECT *, tp / (tp + fp)::DOUBLE AS p, tp / (tp + fn)::DOUBLE AS r FROM c)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 2) AS accuracy,
  round(p, 2) AS precision, round(r, 2) AS recall, round(2 * p * r / (p + r), 2) AS f1 FROM r""")
def q2(spark, sf):
    return Q.positive_scores(judged(spark, sf), 1)


# Languages whose stop words make up a tenth of a document are predicted for it.
GUESSED = f"""w AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '{K.WORD_2PLUS}') AS w
  FROM documents), h AS (SELECT doc_id, lang, len(w) AS n, {_HIT} FROM w),
truth AS (SELECT doc_id, lang AS label FROM documents),
guess AS ({" UNION ALL ".join(f"SELECT doc_id, '{c}' AS label, round(h_{c} / (n + 1), 6) AS score FROM h" for c in LANGS)})"""


def guesses(spark, sf):
    d = docs(spark, sf).select("doc_id", T.word_tokens(F.col("text")).alias("w"))
    scored = F.array(*[
        F.struct(F.lit(c).alias("label"), F.round(_hits("w", c) / (F.size("w") + 1), 6)
                 .alias("score")) for c in LANGS])
    return d.select("doc_id", F.inline(scored))


def truth(spark, sf):
    return docs(spark, sf).select("doc_id", F.col("lang").alias("label"))


@query("q3_multilabel_scores", f"""
WITH {GUESSED}, g AS (SELECT doc_id, label FROM guess WHERE score >= 0.1),
l AS (SELECT label, count(t.doc_id) FILTER (g.doc_id IS NOT NULL) AS tp, count(g.doc_id) AS pr,
  count(t.doc_id) AS su FROM (SELECT doc_id, label, doc_id AS k FROM truth) t
  FULL JOIN (SELECT doc_id, label FROM g) g USING (doc_id, label) GROUP BY label),
r AS (SELECT *, CASE WHEN pr > 0 THEN tp / pr::DOUBLE ELSE 0 END AS p,
  CASE WHEN su > 0 THEN tp / su::DOUBLE ELSE 0 END AS r FROM l),
m AS (SELECT sum(tp) / sum(pr)::DOUBLE AS mp, sum(tp) / sum(su)::DOUBLE AS mr, avg(p) AS ap,
  avg(r) AS ar, avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS af FROM r)
SELECT round(mp, 6) AS micro_precision, round(mr, 6) AS micro_recall,
  round(2 * mp * mr / (mp + mr), 6) AS micro_f1, round(ap, 6) AS macro_precision,
  round(ar, 6) AS macro_recall, round(af, 6) AS macro_f1 FROM m""")
def q3(spark, sf):
    s = Q.multilabel_scores(truth(spark, sf), guesses(spark, sf).filter("score >= 0.1"), ["doc_id"])
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query("q4_roc_auc", f"""
WITH {SCORED}, r AS (SELECT y, rank() OVER (ORDER BY score)
    + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS k FROM scored),
s AS (SELECT sum(k) FILTER (y = 1) AS k, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS n
  FROM r)
SELECT round((k - p * (p + 1) / 2.0::DOUBLE) / (p * n), 6) AS auc, p AS n_pos, n AS n_neg FROM s""")
def q4(spark, sf):
    a = Q.roc_auc(judged(spark, sf))
    return a.select(F.round("auc", 6).alias("auc"), "n_pos", "n_neg")


@query("q5_precision_at_k", f"""
WITH {GUESSED}, top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label)
  AS k FROM guess), hit AS (SELECT count(*) AS n FROM top SEMI JOIN truth USING (doc_id, label)
  WHERE k <= 2)
SELECT n_docs, n_labels, round(n / (2.0::DOUBLE * n_docs), 6) AS precision,
  round(n / n_labels::DOUBLE, 6) AS recall FROM hit,
  (SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_labels FROM truth)""")
def q5(spark, sf):
    p = Q.precision_at(guesses(spark, sf), truth(spark, sf), "doc_id", 2)
    return p.select("n_docs", "n_labels", F.round("precision", 6).alias("precision"),
                    F.round("recall", 6).alias("recall"))


_FOLD_F = REPORT.format(by="fold,", src="folds")


@query("q6_fold_scores", f"""
WITH {SCORED}, {_FOLD_F}
SELECT fold, round(sum(tp) / sum(support)::DOUBLE, 3) AS accuracy,
  round(sum(p * support) / sum(support), 3) AS precision,
  round(sum(r * support) / sum(support), 3) AS recall,
  round(sum(f1 * support) / sum(support), 3) AS f1 FROM f GROUP BY fold""")
def q6(spark, sf):
    return Q.weighted_scores(folded(spark, sf), by=["fold"])


@query("q6_misclassified", f"WITH {SCORED} SELECT doc_id, fold, y, pred FROM folds WHERE y <> pred")
def q6_ids(spark, sf):
    return Q.misclassified(folded(spark, sf)).select("doc_id", "fold", "y", "pred")


@query("q6_summed_confusion", f"""
WITH {SCORED} SELECT y, pred, count(*) AS n, count(DISTINCT fold) AS n_folds FROM folds GROUP BY ALL""")
def q6_confusion(spark, sf):
    c = Q.confusion(folded(spark, sf), by=["fold"])
    return c.groupBy("y", "pred").agg(F.sum("n").alias("n"), F.count("*").alias("n_folds"))


@query("q7_listed_pairs", f"""
WITH {GOLD}, {PREDICTED}, j AS (SELECT p.conv_id, p.label, a.level AS la, b.level AS lb
  FROM predicted p JOIN gold a ON a.conv_id = p.conv_id AND a.item = p.a
  JOIN gold b ON b.conv_id = p.conv_id AND b.item = p.b WHERE a.level <> b.level)
SELECT conv_id, count(*) FILTER ((label = 1) = (la > lb)) AS correct, count(*) AS total
FROM j GROUP BY conv_id""")
def q7(spark, sf):
    return pairs.score_predicted_pairs(predicted_pairs(spark, sf), gold(spark, sf), ["conv_id"])


@query("q7_pairwise_accuracy", f"""
WITH {GOLD}, h AS (SELECT conv_id, turn AS item, ('0x' || substr(md5(text), 1, 8))::BIGINT AS s
  FROM conversations), g AS (SELECT * FROM gold JOIN h USING (conv_id, item))
SELECT conv_id, coalesce(sum(CASE WHEN (a.s, a.item) > (b.s, b.item) THEN 1 ELSE 0 END), 0)::BIGINT
  AS correct, count(b.item) AS total
FROM g a LEFT JOIN g b USING (conv_id) WHERE a.level > b.level GROUP BY conv_id""")
def q7_all(spark, sf):
    c = table(spark, sf, "conversations").select(
        "conv_id", F.col("turn").alias("item"),
        F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long").alias("s"))
    g = gold(spark, sf).join(c, ["conv_id", "item"])
    out = pairs.concordance(g.select("conv_id", "item", "level", "s"), "conv_id", "level", "s",
                            "item")
    return out.filter("total > 0")


@query("q8_rank_distance", f"""
WITH {GOLD}, p AS (SELECT conv_id, turn AS item, row_number() OVER (PARTITION BY conv_id
    ORDER BY md5(text), turn) AS r FROM conversations WHERE role = 'user'),
j AS (SELECT g.conv_id, level, CASE WHEN r = 1 THEN 2 WHEN r <= 10 THEN 1 WHEN r > 10 THEN 0 END AS b
  FROM gold g LEFT JOIN p USING (conv_id, item)),
d AS (SELECT conv_id, count(*) AS n, sum(CASE WHEN b IS NULL THEN abs(level - 2)
  ELSE abs(b - level) END)::BIGINT AS moves, count(*) FILTER (b = level) AS correct
  FROM j GROUP BY conv_id)
SELECT conv_id, n, moves, correct, round(n * moves / 22.0::DOUBLE, 6) AS distance FROM d""")
def q8(spark, sf):
    u = table(spark, sf, "conversations").filter("role = 'user'").select(
        F.col("turn").alias("item"), "conv_id", F.md5("text").alias("h"))
    p = pairs.gold_levels(u, "conv_id", [F.col("h"), F.col("item")])
    p = p.select("conv_id", "item", F.col("level").alias("predicted"))
    d = Q.rank_distance(gold(spark, sf), p, ["conv_id", "item"], "conv_id")
    return d.withColumn("distance", F.round("distance", 6))


@query("q9_mean_interval", f"""
WITH {SCORED}, a AS (SELECT fold, avg(CASE WHEN y = pred THEN 1.0::DOUBLE ELSE 0 END) AS acc
  FROM folds GROUP BY fold)
SELECT round(avg(acc), 6) AS mean, round(avg(acc) - 1.959964 * stddev_samp(acc) / sqrt(count(*)), 6)
  AS low, round(avg(acc) + 1.959964 * stddev_samp(acc) / sqrt(count(*)), 6) AS high FROM a""")
def q9(spark, sf):
    a = folded(spark, sf).groupBy("fold").agg(
        F.avg(F.when(F.col("y") == F.col("pred"), 1.0).otherwise(0.0)).alias("acc"))
    m = Q.mean_interval(a, "acc")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("q10_class_report", f"""
WITH {SCORED}, {REPORT.format(by='', src='judged')}
SELECT cls, support, tp, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f""")
def q10(spark, sf):
    r = Q.class_report(Q.confusion(judged(spark, sf)))
    return r.select("cls", "support", "tp", *[F.round(c, 6).alias(c)
                                              for c in ("precision", "recall", "f1")])


_X = "least(greatest(score, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE)"
_T = "least(greatest(y::DOUBLE, 1e-7::DOUBLE), 1)"
_LG = "(ln(greatest(score, 1e-7::DOUBLE) + 1) - ln(greatest(y::DOUBLE, 1e-7::DOUBLE) + 1))"


@query("q11_losses", f"""
WITH {SCORED}, t AS (SELECT y::DOUBLE AS y, score, 2.0::DOUBLE * y - 1 AS s FROM scored)
SELECT round(avg((score - y) * (score - y)), 6) AS mse, round(avg(abs(score - y)), 6) AS mae,
  round(100 * avg(abs((y - score) / greatest(abs(y), 1e-7::DOUBLE))), 2) AS mape,
  round(avg({_LG} * {_LG}), 6) AS msle, round(avg(pow(greatest(1 - s * score, 0), 2)), 6)
  AS squared_hinge, round(avg(greatest(1 - s * score, 0)), 6) AS hinge,
  round(-avg(y * ln({_X}) + (1 - y) * ln(1 - {_X})), 6) AS cross_entropy,
  round(sum({_T} * ln({_T} / least(greatest(score, 1e-7::DOUBLE), 1))), 4) AS kl,
  round(avg(score - y * ln(score + 1e-7::DOUBLE)), 6) AS poisson,
  round(-sum(y * score) / sqrt(sum(y * y)) / sqrt(sum(score * score)) / count(*), 8) AS cosine
FROM t""")
def q11(spark, sf):
    out = Q.losses(judged(spark, sf), "y", "score")
    digits = {"mape": 2, "kl": 4, "cosine": 8}
    return out.select(*[F.round(c, digits.get(c, 6)).alias(c) for c in out.columns])
