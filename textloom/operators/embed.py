"""Word and document vectors by joins and sums, in blocks of bounded size; no Python runs per row."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import tokens as T
from textloom.operators import index, order
from textloom.operators.joins import hot_lookup, hottest, hottest_in
from textloom.operators.terms import TermBlocks, unpacked
from textloom.session import stage

#: Facts of a block, facts that are summed at a time, and sums that a task hands on at a time.
BLOCK_FACTS = 1_000_000
ROWS_AT_ONCE = 1 << 16
ROWS_SENT = 1 << 14


def dot(a, b):
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a):
    return F.sqrt(dot(a, a))


def cosine(a, b):
    return dot(a, b) / norm(a) / norm(b)


def scale(a, by):
    return F.transform(a, lambda x: x.cast("double") * by)


def unit(a):
    """Vector of length one; a zero vector stays zero."""
    return F.when(norm(a) > 0, scale(a, F.lit(1.0) / norm(a))).otherwise(scale(a, F.lit(1.0)))


def restrict(vectors: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows of the vector table whose word is in the vocabulary."""
    return vectors.join(vocabulary.select("word"), "word", "left_semi")


def weighted_sum(rows: DataFrame, key, vec, weight, dim: int, extra=()):
    """Per key the sum of weight * vec as an array. It is one partial aggregate per dimension, so
    map tasks send one row per key and never the vectors."""
    return rows.groupBy(key).agg(
        F.array(*[F.sum(weight * F.col(vec)[i].cast("double")) for i in range(dim)]).alias("_sum"),
        *extra)


def _sum_block(facts: pa.Table, vectors: pa.Table, dim: int) -> pa.Table:
    """Sums of one block, from its facts (_k, _t, _w, _b) and its vectors (_t, _v)."""
    encoded = lambda column: pc.dictionary_encode(column.combine_chunks(), "encode")
    keys, words = encoded(facts["_k"]), encoded(vectors["_t"])
    n, place = len(keys.dictionary), words.indices.to_numpy()
    flat = vectors["_v"].combine_chunks().flatten()
    value = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    given = pc.is_valid(flat).to_numpy(zero_copy_only=False).reshape(-1, dim) if flat.null_count else None
    copies = np.bincount(place, minlength=len(words.dictionary)).astype(np.float64)
    if len(copies) < len(place):  # a word that the table has twice counts twice
        first = np.zeros((len(copies), dim))
        np.add.at(first, place, value)
        value, held = first, np.zeros((len(copies), dim))
        if given is not None:
            np.add.at(held, place, given)
            given = held > 0
    at = pc.index_in(facts["_t"], words.dictionary, skip_nulls=True)
    group = keys.indices.to_numpy()
    ok = np.flatnonzero(pc.is_valid(at).to_numpy())
    ok = ok[np.argsort(group[ok], kind="stable")]
    group, at = group[ok], pc.fill_null(at, 0).to_numpy()[ok]
    w, b = (pc.fill_null(facts[c], 0.0).to_numpy()[ok] for c in ("_w", "_b"))
    total, seen = np.zeros((n, dim)), np.zeros((n, dim), bool)
    for a in range(0, len(ok), ROWS_AT_ONCE):
        mine, spot = group[a:a + ROWS_AT_ONCE], at[a:a + ROWS_AT_ONCE]
        starts = np.flatnonzero(np.diff(mine, prepend=-1))
        total[mine[starts]] += np.add.reduceat(value[spot] * w[a:a + ROWS_AT_ONCE, None], starts)
        seen[mine[starts]] |= True if given is None else np.logical_or.reduceat(given[spot], starts)
    known = np.bincount(group, minlength=n) > 0
    out = pa.array(total.ravel(), mask=None if given is None else ~seen.ravel())
    sums = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), out, mask=pa.array(~known))
    by = pa.array(np.bincount(group, b * copies[at], minlength=n), mask=~known)
    found = pa.table({"_k": keys.dictionary, "_sum": sums, "_by": by})
    return pa.concat_tables([found.slice(a, ROWS_SENT) for a in range(0, max(n, 1), ROWS_SENT)])


def _of_length(vec: str, dim: int):
    """The vector's first `dim` places; places that it lacks are null."""
    places = F.sequence(F.lit(0), F.lit(dim - 1))
    return F.when(F.size(vec) == dim, F.col(vec)).otherwise(F.transform(places, lambda i: F.get(vec, i)))


def block_sums(facts: DataFrame, key: str, on: str, table: DataFrame, dim: int, merge=False) -> DataFrame:
    """(key, _sum, _by): the sums of _w * vector and of _b over a key's facts that have a vector; null without.

    `facts` is a stored table (key, on, _w, _b), `table` is (on, _v). Facts are dealt to blocks of about
    BLOCK_FACTS and never carry a vector: a block gets each vector that its facts name once, so at most as
    many as it has facts. Blocks are dealt by `key`; with `merge` by `on`, so that each vector goes to one
    block only, and the blocks' sums are added.
    """
    kind = facts.schema[key].dataType.simpleString()
    n = max(1, -(-facts.count() // BLOCK_FACTS))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias("_block")
    cut = facts.select(block(on if merge else key), F.col(key).alias("_k"), F.col(on).alias("_t"), "_w", "_b")
    words = table.filter(F.col("_v").isNotNull()).select(F.col(on).alias("_t"), _of_length("_v", dim).alias("_v"))
    if merge:
        words = words.filter(F.col("_t").isNotNull()).select(block("_t"), "_t", "_v")
    else:
        words = cut.select("_block", "_t").distinct().join(words, "_t")

    words = words.select(*[F.col(c).alias(c) for c in words.columns])  # fresh ids: both sides read the facts

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _sum_block(left, right, dim)

    sums = cut.groupBy("_block").cogroup(words.groupBy("_block")).applyInArrow(
        run, f"_k {kind}, _sum array<double>, _by double")
    if merge:
        sums = weighted_sum(sums.filter(F.col("_by").isNotNull()), "_k", "_sum", F.lit(1.0), dim,
                            [F.sum("_by").alias("_by")])
    return sums.withColumnRenamed("_k", key)


def mean_vectors(tf: DataFrame, vectors: DataFrame, dim: int, key="doc_id", weight=None,
                 by_count=False, l2=None) -> DataFrame:
    """Mean vector of each document's known words; zeros where no word is known.

    `tf` is (key, term, tf[, columns used by `weight`]), one row per document and term. `weight`
    multiplies tf. The sum is divided by the weights, or with `by_count` by the number of words.
    `l2="words"` uses unit word vectors; `l2="both"` also scales the mean to unit length.
    """
    vec = unit(F.col("vec")) if l2 else F.col("vec")
    words = vectors.select(F.col("word").alias("term"), vec.alias("_v"))
    w = (F.col("tf") * weight if weight is not None else F.col("tf")).cast("double")
    by = F.col("tf").cast("double") if by_count else w
    facts = stage(tf.select(key, "term", w.alias("_w"), by.alias("_b")))
    return _means(block_sums(facts, key, "term", words, dim), key, dim, l2)


def _means(sums: DataFrame, key: str, dim: int, l2=None) -> DataFrame:
    mean = F.when(F.col("_by") != 0, scale(F.col("_sum"), F.lit(1.0) / F.col("_by"))).otherwise(
        F.array_repeat(F.lit(0.0), dim))
    return sums.select(key, (unit(mean) if l2 == "both" else mean).alias("vec"))


def block_means(blocks: TermBlocks, vectors: DataFrame, dim: int, idf=None) -> DataFrame:
    """`mean_vectors` of documents' words that lie in blocks: of their counts, or with `idf` of the counts that
    `TermBlocks.weigh` has weighed by it. Facts stay packed, and a group of blocks is sent a vector once."""
    key = blocks.key
    words = vectors.filter(F.col("vec").isNotNull()).select(F.col("word").alias("term"), _of_length("vec", dim).alias("_v"))
    weighed, table = idf is not None, words.withColumn("idf", F.lit(1.0))
    if weighed:
        table = idf.select("term", F.col("idf").cast("double")).join(words, "term", "left").select("term", "_v", "idf")

    def run(block: pa.Table, rows: pa.Table) -> pa.Table:
        doc, term, tf, keys, names = unpacked(block)
        w, words = tf.astype(np.float64), rows["term"].combine_chunks()
        if weighed:  # terms outside the model are ignored
            value = rows["idf"].combine_chunks().take(pc.index_in(names, words))
            ok = pc.is_valid(value).to_numpy(zero_copy_only=False)[term]
            doc, term, w = doc[ok], term[ok], w[ok]
            weight = w * pc.fill_null(value, 0.0).to_numpy()[term]
            norm = np.sqrt(np.bincount(doc, weight * weight, len(keys)))[doc]
            w = w * np.divide(weight, norm, out=np.zeros(len(norm)), where=norm > 0)
        known = pa.table({"_t": pc.index_in(words, names), "_v": rows["_v"]})
        known = known.filter(pc.and_(pc.is_valid(known["_t"]), pc.is_valid(known["_v"])))
        found = _sum_block(pa.table({"_k": doc, "_t": term, "_w": w, "_b": w}), known, dim)
        return found.set_column(0, "_k", keys.take(found["_k"].combine_chunks()))

    sums = blocks.meet(stage(table), run, f"_k {blocks.kind}, _sum array<double>, _by double")
    return _means(sums.withColumnRenamed("_k", key), key, dim)


def subword_vectors(words: DataFrame, grams: DataFrame, dim: int, low=3, high=6) -> DataFrame:
    """Vector of an unknown word: the mean of its known n-gram vectors, counted with repeats.

    `words` is (word); `grams` is (gram, vec). Words without a known n-gram are left out; see
    `missing_words`."""
    cut = T.unnest(words, ["word"], T.subwords(F.col("word"), low, high), "gram")
    n = cut.groupBy("word", "gram").agg(F.count("*").alias("_n"))
    known = hot_lookup(n, grams, "gram", ["vec"], hottest_in(n, "gram"), ["word"])
    sums = weighted_sum(known, "word", "vec", F.col("_n"), dim, [F.sum("_n").alias("_by")])
    return sums.select("word", scale(F.col("_sum"), F.lit(1.0) / F.col("_by")).alias("vec"))


def missing_words(words: DataFrame, found: DataFrame) -> DataFrame:
    return words.join(found, "word", "left_anti")


def fixed_sequence(tokens: DataFrame, vectors: DataFrame, key, width: int, keep_unknown=False):
    """First `width` words of each document as rows (key, slot, vec) of a fixed matrix.

    Known words fill the slots from the last one backwards and unknown words are skipped; with
    `keep_unknown` a word keeps its own slot from the front and unknown words stay zero. Slots
    that no row names are zero.
    """
    first = tokens.filter(F.col("pos") < width)
    words = vectors.select(F.col("word").alias("term"), "vec")
    hits = hot_lookup(first, words, "term", ["vec"], hottest_in(first, "term"), [key, "pos"])
    if keep_unknown:
        return hits.select(key, F.col("pos").cast("long").alias("slot"), "vec")
    # A window over one document's first `width` words: bounded by the operator's own size.
    place = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return hits.select(key, (F.lit(width) - place).cast("long").alias("slot"), "vec")


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add the rank of a value, ties sharing their mean rank. Equal values are counted first and
    the running count is taken in ordered parts."""
    n = df.groupBy(value).agg(F.count("*").alias("_n"))
    upto = order.running_totals(n, [], [F.col(value)], {"_upto": F.col("_n")})
    ranks = upto.select(value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))
    return hot_lookup(df, ranks, value, [name], hottest(n, value, "_n"), df.columns)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = average_ranks(average_ranks(df, a, "_ra"), b, "_rb")
    return both.agg(F.corr("_ra", "_rb").alias("spearman"), F.count("*").alias("n"))


def relaxed_transport(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Lower bound of the word mover's distance: each side moves every word to the nearest word of
    the other side; the larger of the two costs counts.

    `a` and `b` are arrays of (weight, vec) of one document each, so a row holds two documents.
    """
    rest = [c for c in pairs.columns if c not in (a, b)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                      for f in pairs.schema.fields if f.name in rest)

    def side(words):
        w = np.array([x["weight"] for x in words], dtype=np.float64)
        return w / w.sum(), np.stack([np.asarray(x["vec"], dtype=np.float64) for x in words])

    def cost(left, right):
        (wa, va), (wb, vb) = side(left), side(right)
        d = (va * va).sum(1)[:, None] + (vb * vb).sum(1)[None, :] - 2.0 * va @ vb.T
        d = np.sqrt(np.maximum(d, 0.0))
        return max(float(wa @ d.min(axis=1)), float(wb @ d.min(axis=0)))

    def run(batches):
        for pdf in batches:
            out = pdf[rest].copy()
            out["distance"] = [cost(x, y) for x, y in zip(pdf[a], pdf[b])]
            yield out

    return pairs.mapInPandas(run, f"{kinds}, distance double")


def nearest_words(vectors: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """(query_id, word, score, rank): the k words of highest cosine to each asked word, without itself.

    `vectors` is (word, vec), `words` is (word); words without a vector have no row."""
    asked = vectors.join(words.select("word").distinct(), "word", "left_semi").select(
        F.col("word").alias("query_id"), "vec", F.array("word").alias("banned"))
    found = index.nearest(asked, vectors.select(F.col("word").alias("base_id"), "vec"), k)
    return found.withColumnRenamed("base_id", "word")


def word_analogies(vectors: DataFrame, triples: DataFrame, key: str, k: int) -> DataFrame:
    """(key, word, score, rank): the k words nearest to a - b + c, without a, b and c themselves.

    `triples` is (key, a, b, c); triples with an unknown word have no row."""
    rows = triples.select(key, "a", "b", "c")
    for c in "abc":
        named = vectors.select(F.col("word").alias(c), F.transform("vec", lambda x: x.cast("double")).alias(f"v{c}"))
        rows = rows.join(named, c)
    vec = F.zip_with(F.zip_with("va", "vb", lambda x, y: x - y), "vc", lambda x, y: x + y)
    asked = rows.select(F.col(key).alias("query_id"), vec.alias("vec"), F.array("a", "b", "c").alias("banned"))
    found = index.nearest(asked, vectors.select(F.col("word").alias("base_id"), "vec"), k)
    return found.withColumnsRenamed({"base_id": "word", "query_id": key})
