"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct five-word shingles, kept as 64-bit hashes. Shingles are ordered
by document frequency, rarest first: blocks ask buckets for the frequencies of what they hold, and
only shingles of two or more documents come back. Two sets can reach the threshold only if their
prefixes in that order share a shingle, so a document whose prefix holds nothing shared is done.

The rest collapses twice: equal sets form a class, and classes with identical prefix and size form a
group. Groups that share a prefix shingle and pass the size and position filters are candidate pairs;
they are expanded into their classes, and classes are verified on their whole sets.

Components are all that is asked for, so pairs that are already connected need no verification. In
each of at most ROUNDS rounds every group is compared with one group of another component, the one
that most of its prefix shingles lead to (and in the first round members with their group's head).
When a round finds no link, all pairs that pass the filters and still lie in different components are
listed and verified, which makes the result exact. A large set of near copies is connected by the
rounds and never listed pair by pair.

Nulls: a null text, like one without words, has no shingles and links with nothing; a null id counts
as larger than all others and is passed on. Fewer than five words are one shingle. Repeated rows link
like copies. An empty table gives no rows; other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C

SIZE = 5
PERCENT = 80
PAIR_SCHEMA = "a binary, b binary"
ROUNDS = 3


def shingles(text: bytes, hashes):
    """Ascending distinct hashes of a text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, C.U64)
    if len(words) < SIZE:
        return np.array([C.word_hash(b" ".join(words))], C.U64)
    return C.distinct(C.rolling(hashes.of(words), SIZE))


def linked(a, b):
    """Whether two ascending arrays of distinct hashes reach the threshold."""
    if PERCENT * len(b) > 100 * len(a) or PERCENT * len(a) > 100 * len(b):
        return False
    common = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def prefix_length(n):
    return n - (PERCENT * n + 99) // 100 + 1


def block_sets(block):
    """A block's rows, their sets, and the keys of all shingles in it."""
    rows, hashes = C.rows_of(block), C.Hashes()
    return rows, [shingles(t, hashes) for t in rows["text"].to_pylist()]


def key_bits(rows: int) -> int:
    """Leading bits of a hash that frequencies are counted on: far more values than shingles.

    Shingles that share them share their frequency, for every document alike, so the order of
    shingles stays one order; some only look shared and cost a comparison.
    """
    return min(64, 24 + max(rows, 1).bit_length())


def keys(sets, bits):
    return [s >> C.U64(64 - bits) for s in sets]


def slices(sorted_keys, buckets, bits):
    """(bucket, from, to) of the parts of an ascending array; a bucket is a range of keys."""
    bucket = (sorted_keys // C.U64((1 << bits) // buckets + 1)).astype(np.int64)
    starts = C.group_starts(bucket)
    return zip(bucket[starts].tolist(), starts.tolist(), np.append(starts[1:], len(bucket)).tolist())


def ask(block, buckets, bits):
    """Distinct keys of a block and in how many of its rows each stands."""
    sets = [k[C.group_starts(k)] for k in keys(block_sets(block)[1], bits)]
    held, count = np.unique(np.concatenate(sets), return_counts=True)
    for bucket, a, b in slices(held, buckets, bits):
        yield bucket, C.join((C.pack_sorted(held[a:b]), C.pack(count[a:b])))


def answer(bucket):
    """For each block the positions of its keys that two or more rows hold, with their counts."""
    parts = []
    for block, blob in zip(bucket["_block"].to_pylist(), bucket["payload"].to_pylist()):
        own, count = C.split(blob)
        parts.append((block, C.unpack_sorted(own), C.unpack(count)))
    held = np.concatenate([p[1] for p in parts])
    order = np.argsort(held, kind="stable")
    starts = C.group_starts(held[order])
    count = np.concatenate([p[2] for p in parts])
    total = np.empty(len(held), np.int64)
    sums = np.add.reduceat(count[order], starts)
    total[order] = np.repeat(sums, np.diff(np.append(starts, len(order))))
    at, number = 0, bucket["_bucket"][0].as_py()
    for block, own, _ in parts:
        mine = total[at:at + len(own)]
        at += len(own)
        shared = np.flatnonzero(mine > 1)
        if len(shared):
            yield block, C.join((number.to_bytes(4, "little"), C.pack_sorted(shared),
                                 C.pack(mine[shared])))


SET_SCHEMA = ("doc_id long, n_shingles long, class binary, grp long, own int, "
              "prefix array<long>, hashes binary")


def digest(n, hashes) -> bytes:
    return hashlib.blake2b(hashes.tobytes() + n.to_bytes(8, "little"), digest_size=12).digest()


def finish(block, answers, buckets, bits):
    """A row per document; the first of each class in the block also carries the set.

    `own` counts the prefix shingles that no other row holds; `prefix` lists the position and hash
    of the others.
    """
    rows, sets = block_sets(block)
    keyed = keys(sets, bits)
    held = C.distinct(np.concatenate(keyed))
    df = np.ones(len(held), np.int64)
    where = {bucket: a for bucket, a, _ in slices(held, buckets, bits)}
    for blob in answers["payload"].to_pylist():
        bucket, at, count = C.split(blob)
        first = where[int.from_bytes(bucket, "little")]
        df[first + C.unpack_sorted(at).astype(np.int64)] = C.unpack(count)
    out, seen = [], set()
    for doc_id, s, key in zip(rows["doc_id"].to_pylist(), sets, keyed):
        n, row = len(s), [doc_id, len(s), None, None, None, None, None]
        if n:
            count = df[np.searchsorted(held, key)]
            prefix = np.lexsort((s, count))[:prefix_length(n)]
            shared = np.flatnonzero(count[prefix] > 1)
            if len(shared):
                row[2] = digest(n, s)
                if row[2] not in seen:
                    seen.add(row[2])
                    row[3] = int.from_bytes(digest(n, s[prefix])[:8], "little", signed=True)
                    row[4] = len(prefix) - len(shared)
                    row[5] = np.stack((shared, s[prefix[shared]].view(np.int64)), 1).ravel().tolist()
                    row[6] = C.pack_sorted(s)
        out.append(row)
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64()),
             pa.binary())
    return C.table(("doc_id", "n_shingles", "class", "grp", "own", "prefix", "hashes"), kinds, out)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of classes (a, b) whose whole sets reach the threshold."""
    left = sets.select(F.col("class").alias("a"), F.col("hashes").alias("of_a"))
    right = sets.select(F.col("class").alias("b"), F.col("hashes").alias("of_b"))

    def judged(batches):
        for t in batches:
            keep = [linked(C.unpack_sorted(x), C.unpack_sorted(y))
                    for x, y in zip(t["of_a"].to_pylist(), t["of_b"].to_pylist())]
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        C.release()

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
    return both.mapInArrow(judged, PAIR_SCHEMA)


def labels(links: DataFrame, folder=None) -> DataFrame:
    """(node, label): the least node that links reach; every round also jumps to the label's label."""
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    ends = C.stored(ends.unionByName(links.select(
        F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), folder)
    found = C.stored(ends.groupBy("node").agg(F.min("other").alias("near")).select(
        "node", F.least("node", "near").alias("label")), folder)
    while True:
        near = ends.join(found.withColumnRenamed("node", "other"), "other").groupBy("node").agg(
            F.min("label").alias("near"))
        above = found.select(F.col("node").alias("label"), F.col("label").alias("above"))
        step = found.join(above, "label").join(near, "node")
        new = C.stored(step.select("node", "label", F.least("above", "near").alias("next")), folder)
        moved = new.filter(F.col("label") != F.col("next")).limit(1).count()
        found = new.select("node", F.col("next").alias("label"))
        if not moved:
            return found


def merged(found: DataFrame, links: DataFrame, folder=None) -> DataFrame:
    """The components (node, label) after links between nodes; only labels that links touch move."""
    a, b = (found.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")) for c in "ab")
    across = links.join(a, "a").join(b, "b").filter("_a <> _b")
    moves = labels(across.select(F.col("_a").alias("a"), F.col("_b").alias("b")), folder)
    moves = moves.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return C.stored(found.join(moves, "label", "left").select(
        "node", F.coalesce("to", "label").alias("label")), folder)


def ordered(pairs):
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def partners(entries, heads, found):
    """One candidate for each group: the other component's group that most of its shingles lead to.

    A shingle leads to the most central group that holds it, the one with fewest shingles of its
    own; groups of that component are led to the most central one of another component.
    """
    of = heads.join(found, F.col("head") == F.col("node")).select("grp", "head", "label")
    e = entries.join(of, "grp")
    rank = F.struct("own", F.hash("grp").alias("o"), "grp", "head", "label")
    top = e.groupBy("shingle").agg(F.min(rank).alias("top"))
    e = e.join(top, "shingle")
    other = e.filter(F.col("label") != F.col("top.label"))
    second = other.groupBy("shingle").agg(F.min(rank).alias("second"))
    e = e.join(second, "shingle")  # leaves only shingles that two components hold
    to = F.when(F.col("label") == F.col("top.label"), F.col("second")).otherwise(F.col("top"))
    met = e.select("grp", "head", to["head"].alias("to")).groupBy("grp", "head", "to").agg(
        F.count("*").alias("times"))
    best = met.groupBy("grp", "head").agg(F.max_by("to", F.struct("times", "to")).alias("to"))
    return best.select(F.col("head").alias("a"), F.col("to").alias("b"))


def one_of_each(rows: DataFrame, folder=None) -> DataFrame:
    """The classes that have a shared prefix shingle, each with its set."""
    return C.stored(rows.filter("hashes IS NOT NULL").groupBy("class").agg(
        *[F.first(c).alias(c) for c in ("grp", "n_shingles", "own", "prefix", "hashes")]), folder)


def components(classes: DataFrame, folder=None) -> DataFrame:
    """(node, label) of every class of `one_of_each`."""
    sets = classes.select("class", "hashes")
    members = C.stored(classes.select("grp", "class"), folder)
    groups = classes.groupBy("grp").agg(
        F.min("class").alias("head"), F.first("n_shingles").alias("n"),
        F.first("own").alias("own"), F.first("prefix").alias("prefix"))
    each = F.explode(F.expr("transform(sequence(0, size(prefix) div 2 - 1), "
                            "i -> struct(prefix[2*i] as pos, prefix[2*i+1] as shingle))"))
    entries = groups.select("grp", "n", "own", each.alias("e"))
    entries = entries.select("grp", "n", "own", "e.pos", "e.shingle")
    # Shingles of one group alone, mostly of sets of equal copies, lead to no other group.
    shared = entries.groupBy("shingle").agg(F.count("*").alias("c")).filter("c > 1")
    entries = C.stored(entries.join(shared.select("shingle"), "shingle"), folder)
    heads = C.stored(members.groupBy("grp").agg(F.min("class").alias("head")), folder)
    found = members.select(F.col("class").alias("node"), F.col("class").alias("label"))
    tried = members.join(heads, "grp").filter("class <> head").select(
        F.col("class").alias("a"), F.col("head").alias("b"))
    for _ in range(ROUNDS):
        tried = tried.unionByName(partners(entries, heads, found))
        links = C.stored(verify(ordered(tried), sets), folder)
        if not links.limit(1).count():
            break
        found = merged(found, links, folder)
        tried = tried.limit(0)
    links = verify(ordered(every_pair(entries, members, found)), sets)
    return merged(found, C.stored(links, folder), folder)


def every_pair(entries, members, found):
    """Class pairs of all group pairs that pass the filters and are not in one component yet."""
    of_class = members.join(found.withColumnRenamed("node", "class"), "class")
    of_group = of_class.groupBy("grp").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    e = entries.join(of_group, "grp")
    # A shingle within one component leads to nothing to verify.
    mixed = e.groupBy("shingle").agg(F.min("low").alias("l"), F.max("high").alias("h"))
    e = e.join(mixed.filter("l <> h").select("shingle"), "shingle")
    x, y = (e.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in
                                  ("grp", "n", "pos", "low", "high")]) for s in "xy")
    need = F.ceil(F.lit(PERCENT / (100 + PERCENT)) * (F.col("n_x") + F.col("n_y")) - 1e-6)
    most = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
    one = (F.col("low_x") == F.col("high_x")) & (F.col("low_y") == F.col("high_y")) & (
        F.col("low_x") == F.col("low_y"))
    pairs = x.join(y, "shingle").filter(
        (F.col("grp_x") < F.col("grp_y")) & ~one
        & (100 * F.col("n_x") >= PERCENT * F.col("n_y"))
        & (100 * F.col("n_y") >= PERCENT * F.col("n_x")) & (most >= need))
    pairs = pairs.select("grp_x", "grp_y").distinct()
    a, b = (of_class.select(F.col("grp").alias(f"grp_{s}"), F.col("class").alias(c),
                            F.col("label").alias(f"label_{c}")) for s, c in ("xa", "yb"))
    across = pairs.join(a, "grp_x").join(b, "grp_y")
    torn = of_class.join(of_group.filter("low <> high").select("grp"), "grp")
    within = torn.select("grp", F.col("class").alias("a"), F.col("label").alias("label_a")).join(
        torn.select("grp", F.col("class").alias("b"), F.col("label").alias("label_b")), "grp")
    pick = ["a", "b", "label_a", "label_b"]
    every = across.select(*pick).unionByName(within.select(*pick))
    return every.filter("label_a <> label_b").select("a", "b")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    blocks = C.blocked(docs.select("doc_id", C.text_bytes().alias("text")))
    n, bits = C.bucket_count(docs), key_bits(docs.count())
    # The sets are read while links are sought; only the narrow tables outlive that.
    with C.scratch(docs.sparkSession) as folder:
        with C.scratch(docs.sparkSession) as whole:
            rows = C.stored(C.dialogue(blocks, lambda b: ask(b, n, bits), answer,
                                       lambda b, a: finish(b, a, n, bits), SET_SCHEMA), whole)
            narrow = C.stored(rows.select("doc_id", "n_shingles", "class"))
            classes = one_of_each(rows, folder)
        found = components(classes, folder).withColumnRenamed("node", "class")
        least = narrow.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("low"))
        named = least.join(found, "class")
        low = named.groupBy("label").agg(F.min("low").alias("component_id"))
        of_class = C.stored(named.join(low, "label").select("class", "component_id"))
    return narrow.join(of_class, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The document of least id of each component; rows with one id are one document."""
    found = jaccard_components(docs).filter("doc_id = component_id OR component_id IS NULL")
    kept = found.select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) BETWEEN 1 AND 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS MATERIALIZED (
  SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL) c
  JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
)
SELECT w.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.b) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.a = w.doc_id GROUP BY w.doc_id"""
