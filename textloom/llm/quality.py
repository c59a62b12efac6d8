"""Quality classifier: interpolated modified Kneser-Ney perplexity with quantile cuts by language.

Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. A word bigram model is trained on rows that are labelled
as good: on all of them that fall in one half by hash, and on the VOCABULARY most frequent of their
words that occur twice; any other word is the unknown word, spelled out at SPELLING nats a
byte. This bound is what lets the vocabulary and its vectors travel to every task. The bigram
counts stay a table of packed shards: each block of documents asks the shards for the counts of its
distinct bigrams, and adds up its documents' probabilities with the answers. Training texts and shards
are removed once the counts and the scores are stored.

The cut is the QUANTILE of the length-adjusted negative log probability per word over all good rows
that the model was not fitted on, by language; a language without such rows uses the cut of all.
With fewer than FEW such rows a language's quantile is only the maximum of a handful, so its cut is at
least the cut of all, and at least its own mean raised by the share by which the QUANTILE of all rows
exceeds their languages' means, widened by sqrt(1 + 1/rows) for the mean of few. Below 1 / (1 - QUANTILE) rows the
quantile is still their maximum, and passes about rows / (rows + 1) of a language's clean documents.
Short documents are drawn to their language's mean by PRIOR pseudo-words, so that one rare word
condemns none. Rows meet the values of their language by a look-up that spreads frequent languages.

Nulls: a null text is empty; a null or unseen language uses the overall cut; a null id is passed on.
Repeated rows get equal scores. An empty table gives no rows. Without good rows nothing is rejected.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C
from textloom.operators import joins
from textloom.session import checkpoint

#: None: the model is fitted on the whole half; a number bounds it.
TRAIN_ROWS = None
VOCABULARY = 200_000
LONGEST = 64
SPELLING = 2.5
QUANTILE = 0.995
ACCURACY = 10_000
PRIOR = 20.0
FEW = 20
UNKNOWN, START, END = 0, 1, 2


class Vocabulary(dict):
    """Word to number; unknown words are 0."""

    def __init__(self, words):
        super().__init__((w, k + 3) for k, w in enumerate(words))
        self.size = len(words) + 3

    def __missing__(self, word):
        return UNKNOWN


def sequence(text: bytes, vocabulary):
    """Numbers of start, words and end, and the bytes of the unknown words."""
    words = text.lower().split()
    ids = np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
    spelled = sum(len(words[k]) for k in np.flatnonzero(ids == UNKNOWN).tolist())
    return np.concatenate(([START], ids, [END])), spelled


def discounts(n1, n2, n3, n4):
    """Chen and Goodman's three discounts; where the counts allow none, half of one."""
    if not (n1 and n2):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return np.clip([0, 1 - 2 * y * n2 / n1, d2, d3], [0, 0, 0, 0], [0, 1, 2, 3])


class Model:
    """What every task needs: the discounts, and the backoff and lower-order probability by word."""

    def __init__(self, size, counts, follows, history):
        """counts: rows (count, bigrams); follows: rows (word, histories); history: rows
        (word, occurrences, followers seen once, twice, more often)."""
        of = Counter({int(c): int(n) for c, n in counts})
        self.discount = discounts(*(of[r] for r in (1, 2, 3, 4)))
        kept = np.zeros(size)
        if len(follows):
            kept[follows[:, 0].astype(int)] = follows[:, 1]
        of = Counter(kept[kept > 0].astype(int).tolist())
        lower = discounts(*(of[r] for r in (1, 2, 3, 4)))
        total = max(kept.sum(), 1.0)
        taken = lower[np.minimum(kept, 3).astype(int)]
        free = taken.sum() / total if len(follows) else 1.0
        # The start is never predicted; every other word shares what the discounts free.
        self.lower = (kept - taken) / total + free / (size - 1)
        self.lower[START] = 0
        self.total, self.backoff = np.zeros(size), np.ones(size)
        if len(history):
            h = history[:, 0].astype(int)
            self.total[h] = history[:, 1]
            self.backoff[h] = history[:, 2:] @ self.discount[1:] / history[:, 1]

    def log_probability(self, before, word, count):
        p = self.backoff[before] * self.lower[word]
        seen = count > 0
        c = count[seen]
        p[seen] += (c - self.discount[np.minimum(c, 3)]) / self.total[before[seen]]
        return np.log(p)


def trusted(docs: DataFrame, labels: DataFrame, part: int):
    """Ids of good rows, half for fitting (part 0) and half for the cuts (part 1)."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == part)


def fitted(docs: DataFrame, labels: DataFrame):
    """Ids of the good rows that the model is fitted on."""
    half = trusted(docs, labels, 0)
    if TRAIN_ROWS is None:
        return half
    return half.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(TRAIN_ROWS)


def unfitted(docs: DataFrame, labels: DataFrame):
    """Ids of all other good rows."""
    fair = trusted(docs, labels, 1)
    if TRAIN_ROWS is None:
        return fair
    return fair.unionByName(trusted(docs, labels, 0).join(fitted(docs, labels), "doc_id", "left_anti"))


def fit(docs: DataFrame, labels: DataFrame, buckets: int, folder=None):
    """(vocabulary, model, shards of bigram counts, buckets)."""
    spark = docs.sparkSession
    with C.scratch(spark) as texts:
        # Two passes read the training texts: they are joined once, by shuffle at any size, and stored
        # until the counts are.
        training = C.stored(docs.join(fitted(docs, labels).hint("merge"), "doc_id").select(
            C.text_bytes().alias("text")), texts)

        def word_counts(batches):
            for b in C.sized(batches):
                n = Counter(w for t in b["text"].to_pylist() for w in t.lower().split()
                            if len(w) <= LONGEST)
                yield C.batch(("word", "n"), (pa.binary(), pa.int64()), list(n.items()))

        words = training.mapInArrow(word_counts, "word binary, n long").groupBy("word").agg(
            F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "word").limit(VOCABULARY)
        vocabulary = Vocabulary(words.toArrow()["word"].to_pylist())
        size, shared = vocabulary.size, spark.sparkContext.broadcast(vocabulary)
        counted = training.mapInArrow(bigrams(shared, size, buckets), "_bucket int, payload binary")
        shards = C.stored(counted.groupBy("_bucket").applyInArrow(merged, SHARDS), folder)
    found = rows(shards.mapInArrow(tallies(size), TALLIES).groupBy("at").agg(
        *[F.sum(c) for c in ("histories", "n", "once", "twice", "more")]))
    of_words, small = found[found[:, 0] >= 0], found[found[:, 0] < 0]
    model = Model(size, np.abs(small[:, :2]), of_words[of_words[:, 1] > 0, :2],
                  of_words[of_words[:, 2] > 0][:, [0, 2, 3, 4, 5]])
    return shared, spark.sparkContext.broadcast(model), shards, buckets


SHARDS = "_bucket int, keys binary, counts binary"
TALLIES = "at long, histories long, n long, once long, twice long, more long"


def bigrams(shared, size, buckets):
    """What each block of texts has of each bucket's bigrams: packed keys and counts."""
    def run(batches):
        for held in C.sized(batches):
            ids = [sequence(t, shared.value)[0] for t in held["text"].to_pylist()]
            h, w = (np.concatenate([i[part] for i in ids]) for part in (slice(-1), slice(1, None)))
            keys, bucket, place = dealt(h, w, size, buckets)
            n = np.bincount(place, minlength=len(keys))
            starts = C.group_starts(bucket)
            yield C.batch(("_bucket", "payload"), (pa.int32(), pa.binary()), [
                (int(bucket[a]), C.join((C.pack_sorted(keys[a:b]), C.pack(n[a:b]))))
                for a, b in zip(starts, np.append(starts[1:], len(keys)))])
    return run


def merged(bucket):
    """The bucket's bigrams with their counts over all blocks, as one row."""
    parts = [C.split(p) for p in bucket["payload"].to_pylist()]
    keys = np.concatenate([C.unpack_sorted(p[0]) for p in parts])
    n = np.concatenate([C.unpack(p[1]) for p in parts])
    order = np.argsort(keys, kind="stable")
    starts = C.group_starts(keys[order])
    row = (bucket["_bucket"][0].as_py(), C.pack_sorted(keys[order][starts]),
           C.pack(np.add.reduceat(n[order], starts)))
    return C.table(("_bucket", "keys", "counts"), (pa.int32(), pa.binary(), pa.binary()), [row])


def counts_of(shard):
    """(ascending keys, counts) of a table of at most one shard."""
    if not shard.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (C.unpack_sorted(shard["keys"][0].as_py()).astype(np.int64),
            C.unpack(shard["counts"][0].as_py()))


def tallies(size):
    """Sums over a task's shards: by word its histories, its occurrences as history, and its followers
    seen once, twice and more often; at -n the number of bigrams that occur n times, for n below 5."""
    def run(batches):
        found, small = np.zeros((5, size), np.int64), np.zeros(5, np.int64)
        for shard in (b.slice(k, 1) for b in batches for k in range(b.num_rows)):
            keys, n = counts_of(shard)
            h, w = keys // size, keys % size
            found[0] += np.bincount(w, minlength=size)
            found[1] += np.bincount(h, n, minlength=size).astype(np.int64)
            for k, some in enumerate((n == 1, n == 2, n > 2)):
                found[2 + k] += np.bincount(h[some], minlength=size)
            small += np.bincount(n[n < 5], minlength=5)
        at = np.flatnonzero(found.any(0))
        few = np.zeros((5, 4), np.int64)
        few[0] = small[1:]
        columns = np.concatenate((np.stack((at, *found[:, at])), np.stack((-np.arange(1, 5), *few))), 1)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns],
                                         names=["at", "histories", "n", "once", "twice", "more"])
    return run


def rows(df):
    """A small table of numbers as an array; Arrow spares the driver a Python object per cell."""
    found = df.toArrow()
    return np.array([c.to_numpy() for c in found.columns], float).T.reshape(-1, found.num_columns)


ENCODED = ("_block long, doc_ids array<long>, row_keys array<long>, langs array<string>, "
           "sizes binary, spelled binary, ids binary")
SCORED = "doc_id long, row_key long, lang string, n_tokens long, log_prob double"


def encode(shared):
    """Blocks of documents as the numbers of their words."""
    def run(batches):
        for k, held in enumerate(C.gathered(batches)):
            docs, texts, keys, langs = zip(*held)
            found = [sequence(t, shared.value) for t in texts]
            yield pa.RecordBatch.from_arrays([
                pa.array([C.block_number(k)], pa.int64()), pa.array([docs], pa.list_(pa.int64())),
                pa.array([keys], pa.list_(pa.int64())), pa.array([langs], pa.list_(pa.string())),
                pa.array([C.pack([len(s) for s, _ in found])], pa.binary()),
                pa.array([C.pack([n for _, n in found])], pa.binary()),
                pa.array([C.pack(np.concatenate([s for s, _ in found]))], pa.binary())],
                names=["_block", "doc_ids", "row_keys", "langs", "sizes", "spelled", "ids"])
    return run


def block_bigrams(block):
    """(sizes, history, word) of a block's tokens, without the pairs across documents."""
    sizes = C.unpack(block["sizes"][0].as_py())
    ids = C.unpack(block["ids"][0].as_py())
    ends = np.cumsum(sizes)
    inside = np.ones(len(ids) - 1, bool)
    inside[ends[:-1] - 1] = False
    return sizes - 1, ids[:-1][inside], ids[1:][inside]


def dealt(h, w, size, buckets):
    """(distinct bigrams in the order of their buckets, those buckets, place of each given one).

    The sum of both numbers deals a frequent word's bigrams over all buckets, as history and as
    follower.
    """
    keys, of = np.unique(h * size + w, return_inverse=True)
    bucket = (keys // size + keys % size) % buckets
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return keys[order], bucket[order], place[of]


def score(docs: DataFrame, vocabulary, model, shards, buckets) -> DataFrame:
    """Log probability (natural) and tokens, with the end, of every row."""
    size = vocabulary.value.size
    key = F.xxhash64("doc_id", "text")
    blocks = docs.select("doc_id", C.text_bytes().alias("text"), key.alias("row_key"),
                         F.col("lang").cast("string")).mapInArrow(encode(vocabulary), ENCODED)
    blocks = blocks.repartition(C.partitions(docs.sparkSession), "_block")

    def ask(block):
        _, h, w = block_bigrams(block)
        keys, bucket, _ = dealt(h, w, size, buckets)
        starts = C.group_starts(bucket)
        for a, b in zip(starts, np.append(starts[1:], len(keys))):
            yield int(bucket[a]), C.pack_sorted(keys[a:b])

    def answer(bucket, shard):
        (keys, counts), number = counts_of(shard), bucket["_bucket"][0].as_py()
        for block, blob in zip(bucket["_block"].to_pylist(), bucket["payload"].to_pylist()):
            asked = C.unpack_sorted(blob).astype(np.int64)
            _, at, of = np.intersect1d(asked, keys, assume_unique=True, return_indices=True)
            if len(at):
                yield block, C.join((number.to_bytes(4, "little"), C.pack_sorted(at),
                                     C.pack(counts[of])))

    def finish(block, answers):
        sizes, h, w = block_bigrams(block)
        keys, bucket, of = dealt(h, w, size, buckets)
        starts = C.group_starts(bucket)
        first = dict(zip(bucket[starts].tolist(), starts.tolist()))
        counts = np.zeros(len(keys), np.int64)
        for blob in answers["payload"].to_pylist():
            number, at, n = C.split(blob)
            base = first[int.from_bytes(number, "little")]
            counts[base + C.unpack_sorted(at).astype(np.int64)] = C.unpack(n)
        log = model.value.log_probability(h, w, counts[of])
        total = np.add.reduceat(log, np.cumsum(sizes) - sizes)
        total -= SPELLING * C.unpack(block["spelled"][0].as_py())
        return pa.table({
            "doc_id": pa.array(block["doc_ids"][0].as_py(), pa.int64()),
            "row_key": pa.array(block["row_keys"][0].as_py(), pa.int64()),
            "lang": pa.array(block["langs"][0].as_py(), pa.string()),
            "n_tokens": pa.array(sizes, pa.int64()), "log_prob": pa.array(total, pa.float64())})

    return C.dialogue(blocks, ask, answer, finish, SCORED, shards)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, row_key, lang, n_tokens, log_prob, perplexity, cut and keep of every row."""
    buckets = C.BUCKETS_PER_PARTITION * C.partitions(docs.sparkSession)
    fair = unfitted(docs, labels).withColumn("fair", F.lit(True))
    key = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    with C.scratch(docs.sparkSession) as folder:
        scored = score(docs, *fit(docs, labels, buckets, folder)).withColumn("lang_key", key)
        scored = C.stored(scored.join(fair, "doc_id", "left"))
    hot = checkpoint(joins.hottest_in(scored, "lang_key"))

    def of_fair(column):
        return F.when(F.col("fair"), F.col(column))

    def by_language(df, **values):
        """The rows with values of their language's fair rows: null without such rows or language."""
        found = df.groupBy("lang_key").agg(*[v.alias(name) for name, v in values.items()])
        found = found.select("lang_key", *[F.when(F.col("lang_key") != "", F.col(v)).alias(v)
                                           for v in values])
        return joins.hot_lookup(df, found, "lang_key", values, hot, ["doc_id", "row_key"], how="left")

    mean = -F.sum(of_fair("log_prob")) / F.sum(of_fair("n_tokens"))
    overall = scored.agg(mean.alias("m")).first().m
    centre = F.coalesce("mean", F.lit(overall), F.lit(0.0))
    adjusted = checkpoint(by_language(scored, mean=mean).withColumn("centre", centre).withColumn(
        "surprise", (PRIOR * F.col("centre") - F.col("log_prob")) / (F.col("n_tokens") + PRIOR)).drop("mean"))
    cut = F.percentile_approx(of_fair("surprise"), QUANTILE, ACCURACY)
    above = F.when(F.col("fair"), F.col("surprise") / F.col("centre") - 1)
    general, spread = (F.lit(v).cast("double") for v in adjusted.agg(
        cut, F.percentile_approx(above, QUANTILE, ACCURACY)).first())
    judged = by_language(adjusted, own=cut, rows=F.count(of_fair("surprise")))
    least = F.greatest("own", general, F.col("centre") * (1 + spread * F.sqrt(1 + 1 / F.col("rows"))))
    judged = judged.withColumn("cut", F.when(F.col("own").isNull(), general).when(
        F.col("rows") < FEW, least).otherwise(F.col("own")))
    return judged.select(
        "doc_id", "row_key", "lang", "n_tokens", "log_prob",
        F.exp(-F.col("log_prob") / F.col("n_tokens")).alias("perplexity"), "surprise", "cut",
        F.coalesce(F.col("surprise") <= F.col("cut"), F.lit(True)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that pass the cut of their language."""
    out = classify(docs, labels).filter(~F.col("keep")).select(
        F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("doc_id", "text") == F.col("_key"))
    return docs.join(out, same, "left_anti")
