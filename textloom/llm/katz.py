"""Katz backoff language model over words, with Good-Turing discounts.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; every text ends with an end token. A bigram seen in
training has its discounted relative frequency; otherwise its history's backoff weight times the
discounted unigram probability; an unknown word has the unigram mass that discounting frees. Every
weight is the freed mass over the unigram mass of the words not seen after that history, so each
history's probabilities add up to one. A history all of whose followers are too frequent to be
discounted counts one occurrence more, which frees that mass.

Both counts are dialogues between blocks of documents and buckets. Word buckets add up the words'
counts and number them. Bigram buckets own the followers of their histories; a history that holds
more than its share of all tokens is salted by the follower over SALTS buckets. They write the model
(packed histories, followers and counts, one partition a bucket), answer what each block asks for, and
report counts of counts. Blocks add up their documents' scores once the discounts are known.

The model's tables are under the folder that `train_and_score` returns. Nulls: a null text is empty
and still has its end token; a null id counts as the empty text for the split and is passed on.
Repeated rows are scored one by one. An empty table gives no rows. Without training rows every token
is unknown and has probability one.
"""

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C
from textloom.session import shared_dir

HELD_MOD, HELD_REST = 7, 2
CUTOFF = 5
SALTS = 16
UNKNOWN, START, FIRST = 0, 1, 2
TOTALS = -1  # the number of the block that gets the buckets' totals


def discounts(of_counts):
    """Katz's discounts for counts 1..CUTOFF from counts of counts 1..CUTOFF+1.

    Where the counts of counts give none between 0 and 1, half an occurrence is taken off.
    """
    n = np.asarray(of_counts, float)
    out = np.ones(CUTOFF + 1)
    common = (CUTOFF + 1) * n[CUTOFF] / n[0] if n[0] else 1.0
    for r in range(1, CUTOFF + 1):
        d = np.nan
        if n[r - 1] and common < 1:
            d = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(discount, count):
    """Discounted counts; those above the cutoff stay."""
    count = np.asarray(count)
    return count * np.where(count <= CUTOFF, discount[np.minimum(count, CUTOFF)], 1.0)


class Unigrams:
    """Unigram probabilities by count, from the number of words with each small count."""

    def __init__(self, tokens, distinct, of_counts):
        self.tokens, self.distinct = int(tokens), int(distinct)
        self.discount = discounts(of_counts)
        small = np.arange(1, CUTOFF + 1)
        taken = np.sum(np.asarray(of_counts[:CUTOFF]) * small * (1 - self.discount[1:]))
        self.total = self.tokens + (taken <= 0)
        self.unknown = (taken + (taken <= 0)) / self.total

    def probability(self, count):
        return np.where(count > 0, discounted(self.discount, count) / self.total, self.unknown)

    def base(self, count):
        return np.log10((count + 1) / (self.tokens + self.distinct + 1))


def of_counts(counts):
    return np.bincount(counts[counts <= CUTOFF + 1], minlength=CUTOFF + 2)[1:CUTOFF + 2]


def squeeze(words) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def stretch(blob):
    return zstandard.ZstdDecompressor().decompress(blob).split(b" ")


ENCODED = "_block long, doc_ids array<long>, held array<boolean>, sizes binary, words binary, codes binary"
NUMBERED = ("_block long, doc_ids array<long>, held array<boolean>, sizes binary, codes binary, "
            "ids binary, counts binary, totals array<long>")


def encode(batches):
    """Blocks of documents as numbers in the block's own word list; the end token is the empty word."""
    for k, held in enumerate(C.gathered(batches)):
        numbers, codes = C.Numbering({b"": 0}), []
        for _, text, _ in held:
            codes += [numbers.of(text.lower().split()), [0]]
        docs, _, out = zip(*held)
        yield pa.RecordBatch.from_arrays([
            pa.array([C.block_number(k)], pa.int64()), pa.array([docs], pa.list_(pa.int64())),
            pa.array([out], pa.list_(pa.bool_())),
            pa.array([C.pack([len(c) + 1 for c in codes[::2]])], pa.binary()),
            pa.array([squeeze(numbers)], pa.binary()),
            pa.array([C.pack(np.concatenate(codes))], pa.binary())],
            names=["_block", "doc_ids", "held", "sizes", "words", "codes"])


def tokens(block):
    """(sizes, codes, training flag of each token) of a block."""
    sizes, codes = (C.unpack(block[c][0].as_py()) for c in ("sizes", "codes"))
    train = ~np.array(block["held"][0].as_py(), bool)
    return sizes, codes, np.repeat(train, sizes)


def ask_words(block, buckets):
    words, (_, codes, train) = stretch(block["words"][0].as_py()), tokens(block)
    counts = np.bincount(codes[train], minlength=len(words))
    bucket = np.array([C.word_hash(w) % buckets for w in words])
    order = np.argsort(bucket, kind="stable")
    starts = C.group_starts(bucket[order])
    for a, b in zip(starts, np.append(starts[1:], len(order))):
        part = order[a:b]
        yield int(bucket[part[0]]), C.join((squeeze([words[k] for k in part]),
                                            C.pack_sorted(part), C.pack(counts[part])))


def answer_words(bucket, buckets):
    number, known, asked = bucket["_bucket"][0].as_py(), C.Numbering(), []
    for block, blob in zip(bucket["_block"].to_pylist(), bucket["payload"].to_pylist()):
        words, at, counts = C.split(blob)
        asked.append((block, known.of(stretch(words)), at, C.unpack(counts)))
    total = np.zeros(len(known), np.int64)
    for _, ids, _, counts in asked:
        np.add.at(total, ids, counts)
    # Numbers follow the words' order, so any retry gives the same ones.
    names = list(known)
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    ids_of = np.where(total > 0, FIRST + rank * buckets + number, UNKNOWN)
    for block, ids, at, _ in asked:
        yield block, C.join((at, C.pack(ids_of[ids]), C.pack(total[ids])))
    yield TOTALS, C.pack([total.sum(), (total > 0).sum(), *of_counts(total)])


def number_words(block, answers):
    """The block with global numbers and counts of its words; one more row has the totals."""
    payloads = answers["payload"].to_pylist()
    if not block.num_rows:
        sums = np.sum([C.unpack(p) for p in payloads], 0).tolist()
        row = (TOTALS, None, None, None, None, None, None, sums)
    else:
        n = len(stretch(block["words"][0].as_py()))
        ids, counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for at, own, seen in map(C.split, payloads):
            at = C.unpack_sorted(at).astype(np.int64)
            ids[at], counts[at] = C.unpack(own), C.unpack(seen)
        keep = [block[c][0].as_py() for c in ("_block", "doc_ids", "held", "sizes", "codes")]
        row = (*keep, C.pack(ids), C.pack(counts), None)
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(),
             pa.binary(), pa.binary(), pa.list_(pa.int64()))
    names = ("_block", "doc_ids", "held", "sizes", "codes", "ids", "counts", "totals")
    return C.table(names, kinds, [row])


class Bigrams:
    """A block's tokens as (history, word) with counts, and what it asks of which bucket."""

    def __init__(self, block, buckets, starts, hot):
        self.sizes, codes, self.train = tokens(block)
        ids, counts = (C.unpack(block[c][0].as_py()) for c in ("ids", "counts"))
        self.word, self.word_count = ids[codes], counts[codes]
        self.history = np.concatenate(([START], self.word[:-1]))
        self.history_count = np.concatenate(([0], self.word_count[:-1]))
        first = np.cumsum(self.sizes) - self.sizes
        self.history[first], self.history_count[first] = START, starts
        self.asked = (self.history != UNKNOWN) & (self.word != UNKNOWN)
        h, w = self.history[self.asked], self.word[self.asked]
        self.base = int(self.word.max()) + 1 if len(self.word) else 1
        spread = self.history_count[self.asked] > hot
        salt = np.where(spread, 1 + C.mix(w) % C.U64(SALTS), C.U64(0))
        bucket = (C.mix(h.astype(C.U64) * C.U64(2 * SALTS) + salt) % C.U64(buckets)).astype(np.int64)
        # Distinct pairs by bucket, history and word.
        order = np.lexsort((w, h, bucket))
        key = np.stack((bucket, h, w))[:, order]
        new = np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0))) if len(h) else np.zeros(0, bool)
        self.pair_bucket, self.pair_h, self.pair_w = key[:, new]
        self.of = np.empty(len(h), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.seen = np.bincount(self.of[self.train[self.asked]], minlength=len(self.pair_h))
        self.pair_count = self.word_count[self.asked][order][new]
        # Histories of held-out tokens need their backoff; hot ones are asked of every salt.
        known = self.history != UNKNOWN
        wanted = known & (~self.train | (self.history_count > hot))
        hs, at = np.unique(self.history[wanted], return_index=True)
        big = self.history_count[wanted][at] > hot
        salts = np.arange(1, SALTS + 1, dtype=C.U64)
        plain = C.mix(hs[~big].astype(C.U64) * C.U64(2 * SALTS)) % C.U64(buckets)
        many = C.mix(hs[big].astype(C.U64)[:, None] * C.U64(2 * SALTS) + salts) % C.U64(buckets)
        pairs = np.concatenate((np.stack((plain.astype(np.int64), hs[~big]), 1),
                                np.stack((many.ravel().astype(np.int64),
                                          np.repeat(hs[big], SALTS)), 1)))
        self.queries = np.unique(pairs, axis=0)

    def questions(self):
        starts = C.group_starts(self.pair_bucket)
        spans = {int(self.pair_bucket[a]): (a, b)
                 for a, b in zip(starts, np.append(starts[1:], len(self.pair_bucket)))}
        for bucket in sorted(set(spans) | set(self.queries[:, 0].tolist())):
            a, b = spans.get(bucket, (0, 0))
            h = self.pair_h[a:b]
            each = C.group_starts(h)
            wanted = self.queries[self.queries[:, 0] == bucket, 1]
            yield bucket, C.join((
                C.pack_sorted(h[each]), C.pack(np.diff(np.append(each, b - a))),
                C.pack(self.pair_w[a:b]), C.pack(self.seen[a:b]), C.pack(self.pair_count[a:b]),
                C.pack_sorted(wanted)))


def answer_bigrams(bucket, unigrams):
    """Counts of the asked pairs, what the asked histories' backoff needs, the model, and totals."""
    asked = []
    for block, blob in zip(bucket["_block"].to_pylist(), bucket["payload"].to_pylist()):
        hs, each, w, seen, count, wanted = C.split(blob)
        h = np.repeat(C.unpack_sorted(hs).astype(np.int64), C.unpack(each))
        asked.append((block, h, C.unpack(w), C.unpack(seen), C.unpack(count),
                      C.unpack_sorted(wanted).astype(np.int64)))
    h, w, seen, count = (np.concatenate([a[k] for a in asked]) for k in (1, 2, 3, 4))
    order = np.lexsort((w, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])
    of = np.empty(len(h), np.int64)
    of[order] = np.cumsum(new) - 1
    total = np.bincount(of, seen, minlength=int(new.sum())).astype(np.int64)
    pair_h, pair_w, pair_count = h[order][new], w[order][new], count[order][new]
    trained = total > 0
    th, tc = pair_h[trained], total[trained]
    starts = C.group_starts(th)
    names = th[starts]

    def sums(values):
        return np.add.reduceat(values, starts) if len(starts) else np.zeros(0)

    # Per history: followers with each small count, tokens of the frequent ones, unigram mass.
    stats = np.stack([sums((tc == r).astype(float)) for r in range(1, CUTOFF + 1)]
                     + [sums(np.where(tc > CUTOFF, tc, 0).astype(float)),
                        sums(unigrams.probability(pair_count[trained]))], 1)
    at = 0
    for block, own, _, _, _, wanted in asked:
        mine = total[of[at:at + len(own)]]
        at += len(own)
        # Whether each asked history has a follower to discount.
        distinct = own[C.group_starts(own)]
        rich = np.zeros(len(distinct), np.int64)
        place = np.searchsorted(names, distinct)
        found = (place < len(names)) & (names[np.minimum(place, max(len(names) - 1, 0))] == distinct
                                        if len(names) else False)
        found = np.broadcast_to(found, distinct.shape)
        rich[found] = stats[place[found], :CUTOFF].sum(1) > 0
        place = np.searchsorted(names, wanted)
        table = np.zeros((len(wanted), CUTOFF + 2))
        inside = np.flatnonzero(place < len(names))
        inside = inside[names[place[inside]] == wanted[inside]]
        table[inside] = stats[place[inside]]
        yield block, C.join((C.pack(mine), C.pack(rich), C.pack_sorted(wanted),
                             zstandard.ZstdCompressor(level=1).compress(table.T.tobytes())))
    yield TOTALS, C.pack(of_counts(tc))
    yield TOTALS - 1, C.join((C.pack_sorted(names), C.pack(np.diff(np.append(starts, len(th)))),
                              C.pack(pair_w[trained]), C.pack(tc)))


def score_block(block, answers, buckets, starts, hot, unigrams, discount):
    """A row per document of the block."""
    b = Bigrams(block, buckets, starts, hot)
    total = np.zeros(len(b.pair_h), np.int64)
    poor = {}
    stats = {}
    spans = C.group_starts(b.pair_bucket)
    first = dict(zip(b.pair_bucket[spans].tolist(),
                     zip(spans.tolist(), np.append(spans[1:], len(total)).tolist())))
    rich_of = np.ones(len(b.pair_h), bool)
    for bucket, blob in zip(answers["_bucket"].to_pylist(), answers["payload"].to_pylist()):
        mine, rich, wanted, table = C.split(blob)
        a, z = first.get(bucket, (0, 0))
        total[a:z] = C.unpack(mine)
        own = b.pair_h[a:z]
        each = C.group_starts(own)
        rich_of[a:z] = np.repeat(C.unpack(rich), np.diff(np.append(each, z - a))) > 0
        wanted = C.unpack_sorted(wanted).astype(np.int64)
        table = np.frombuffer(zstandard.ZstdDecompressor().decompress(table)).reshape(
            CUTOFF + 2, len(wanted)).T
        for k, h in enumerate(wanted.tolist()):
            stats[h] = stats[h] + table[k] if h in stats else table[k]
    count = np.zeros(len(b.word), np.int64)
    count[b.asked] = total[b.of]
    # One occurrence more for histories without a follower to discount.
    extra = np.zeros(len(b.word), bool)
    extra[b.asked] = ~rich_of[b.of]
    names = np.array(sorted(stats), np.int64)
    rows = np.array([stats[h] for h in names.tolist()]).reshape(-1, CUTOFF + 2)
    small = np.arange(1, CUTOFF + 1)
    kept = rows[:, :CUTOFF] @ (small * discount[1:]) + rows[:, CUTOFF]
    bare = rows[:, :CUTOFF].sum(1) == 0
    place = np.minimum(np.searchsorted(names, b.history), max(len(names) - 1, 0))
    listed = names[place] == b.history if len(names) else np.zeros(len(b.word), bool)
    extra[listed] = bare[place[listed]]
    denominator = b.history_count + extra
    uni = unigrams.probability(b.word_count)
    p = uni.copy()
    back = (b.history != UNKNOWN) & (count == 0) & (b.history_count > 0)
    at = place[back]
    free = 1 - kept[at] / denominator[back]
    p[back] *= free / (1 - rows[at, CUTOFF + 1])
    seen = count > 0
    p[seen] = discounted(discount, count[seen]) / denominator[seen]
    begin = np.cumsum(b.sizes) - b.sizes
    known = np.add.reduceat((b.word_count > 0).astype(np.int64), begin)
    n = len(b.sizes)
    return pa.table({
        "doc_id": pa.array(block["doc_ids"][0].as_py(), pa.int64()),
        "held_out": pa.array(block["held"][0].as_py(), pa.bool_()),
        "n_tokens": pa.array(b.sizes, pa.int64()), "n_known": pa.array(known, pa.int64()),
        "train_tokens": pa.array(np.full(n, unigrams.tokens), pa.int64()),
        "base_score": pa.array(np.add.reduceat(unigrams.base(b.word_count), begin)),
        "score": pa.array(np.add.reduceat(np.log10(p), begin))})


SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def train_and_score(docs: DataFrame, held=None):
    """(scores of all rows, folder of the model's tables); `held` marks rows to leave out."""
    spark, n = docs.sparkSession, C.partitions(docs.sparkSession)
    buckets = C.BUCKETS_PER_PARTITION * n
    held = C.held_out(HELD_MOD, HELD_REST) if held is None else held
    plain = docs.select("doc_id", C.text_bytes().alias("text"), held.alias("held"))
    blocks = plain.mapInArrow(encode, ENCODED).repartition(n, "_block")
    numbered = C.stored(C.dialogue(
        blocks, lambda b: ask_words(b, buckets), lambda b: answer_words(b, buckets),
        number_words, NUMBERED))
    totals = numbered.filter(F.col("_block") == TOTALS).select("totals").first()
    totals = totals.totals if totals else [0] * (CUTOFF + 3)
    unigrams = Unigrams(totals[0], totals[1], totals[2:])
    starts = plain.filter(~F.col("held")).count()
    hot = max(1, unigrams.tokens // (4 * buckets))
    ready = numbered.filter(F.col("_block") >= 0).drop("totals")

    def asked(batches):
        # A stored row is a whole block, so blocks ask where they lie.
        for block in (b.slice(k, 1) for b in batches for k in range(b.num_rows)):
            number = block["_block"][0].as_py()
            yield C.batch(("_bucket", "_block", "payload"), (pa.int32(), pa.int64(), pa.binary()),
                          [(bucket, number, payload) for bucket, payload
                           in Bigrams(block, buckets, starts, hot).questions()])

    def answered(bucket):
        number = bucket["_bucket"][0].as_py()
        rows = [(number, block, blob) for block, blob in answer_bigrams(bucket, unigrams)]
        return C.table(("_bucket", "_block", "payload"), (pa.int32(), pa.int64(), pa.binary()), rows)

    schema = "_bucket int, _block long, payload binary"
    folder = f"{shared_dir(spark)}/katz-{uuid.uuid4().hex}"
    questions = ready.mapInArrow(asked, schema)
    answers = questions.groupBy("_bucket").applyInArrow(answered, schema)
    kind = (F.when(F.col("_block") >= 0, "answers").when(F.col("_block") == TOTALS, "totals")
            .otherwise("bigrams"))
    with C.cleaned(spark):
        answers.withColumn("kind", kind).write.partitionBy("kind").parquet(folder)
    answers = spark.read.schema(schema + ", kind string").parquet(folder)

    def sums(batches):
        for t in batches:
            yield C.batch(("n",), (pa.list_(pa.int64()),),
                          [(C.unpack(p).tolist(),) for p in t["payload"].to_pylist()])

    counts = answers.filter("kind = 'totals'").select("payload").mapInArrow(sums, "n array<long>")
    counts = counts.agg(*[F.sum(F.col("n")[r]) for r in range(CUTOFF + 1)]).first()
    discount = discounts([c or 0 for c in counts])
    replies = answers.filter("kind = 'answers'").drop("kind")
    scores = ready.repartition(n, "_block").groupBy("_block").cogroup(replies.groupBy("_block")).applyInArrow(
        lambda b, a: score_block(b, a, buckets, starts, hot, unigrams, discount), SCORED)
    return scores, folder
