"""Substring deduplication by super-k-mers.

A window is WINDOW consecutive words. Its minimiser is the least hash among its word pairs;
consecutive windows with one minimiser travel as one packed string (a super-k-mer) to the bucket of
that minimiser, so equal windows always meet. Windows of a minimiser that stands in a large share of a
sample are dealt by a hash of all their words instead, so none fills a bucket. A block sends each distinct string once, with the
least and the greatest document that holds it. The bucket sorts the windows, compares the words of
those that sort together, and tells each block for which windows a smaller document exists than the
greatest of its own. The block then removes the words those windows cover. Windows are judged on the
input, so a window's first document keeps it whole.

Nulls: a null text has no words; a null id counts as larger than all others and is passed on. Rows
with one id are one document's parts and never remove each other. Texts of fewer words than a window
are kept. An empty table gives no rows; only the named columns are carried.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C

WINDOW = 13
EVERY, HEAVY, FEWEST = 1024, 4, 64
FACTOR = 0x9E3779B97F4A7C15
VISIBLE = re.compile(rb"[^\x20\x09-\x0D]+")


def windows(hashes):
    """Minimiser of every run of WINDOW consecutive words."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, C.U64)
    least, width = C.rolling(hashes, 2), 1
    while width * 2 <= WINDOW - 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = WINDOW - 1 - width
    return np.minimum(least[:n], least[rest:rest + n])


def inside(rows):
    """Which windows lie in one document, from each word's document."""
    return rows[:1 - WINDOW] == rows[WINDOW - 1:] if len(rows) >= WINDOW else np.zeros(0, bool)


def read(texts):
    """(words by number, each word's number, each word's row) of a list of texts."""
    numbers = C.Numbering()
    ids = [numbers.of(text.split()).astype(np.int32) for text in texts]
    rows = np.repeat(np.arange(len(ids), dtype=np.int32), [len(i) for i in ids])
    return list(numbers), np.concatenate([*ids, np.zeros(0, np.int32)]), rows


def spread(starts, lengths):
    """Positions start, start + 1, ... of every run, one run after another."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def numbered(ids, starts, lengths):
    """Number of every string by first sight; equal numbers are equal words, which are compared."""
    if not len(starts):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        powers = np.full(len(ids) + 1, FACTOR, C.U64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=C.U64)
        sums = np.zeros(len(ids) + 1, C.U64)
        np.cumsum(C.mix(ids.astype(C.U64) + C.U64(1)) * powers[:-1], dtype=C.U64, out=sums[1:])
        # The later string's sum is at the higher power: both are raised to the end of the block.
        key = C.mix((sums[starts + lengths] - sums[starts]) * powers[len(ids) - starts]
                    + lengths.astype(C.U64))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    a, b = order[same], order[same + 1]
    if np.array_equal(lengths[a], lengths[b]) and np.array_equal(
            ids[spread(starts[a], lengths[a])], ids[spread(starts[b], lengths[b])]):
        heads = C.group_starts(key[order])
        group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
        number = np.empty(len(heads), np.int64)
        number[np.argsort(order[heads])] = np.arange(len(heads))
        out = np.empty(len(order), np.int64)
        out[order] = number[group]
        return out
    return C.Numbering().of([ids[s:s + n].tobytes() for s, n in zip(starts, lengths)])


def super_kmers(texts, heavy):
    """Words, word numbers, word rows, and of each super-k-mer: start, length, place and number."""
    words, ids, rows = read(texts)
    hashes = np.fromiter(map(C.word_hash, words), C.U64, len(words))[ids]
    place, whole = windows(hashes), inside(rows)
    if len(heavy) and len(place):
        at = np.minimum(np.searchsorted(heavy, place), len(heavy) - 1)
        place = np.where(heavy[at] == place, C.rolling(hashes, WINDOW), place)
    opens = whole.copy()
    opens[1:] &= ~whole[:-1] | (place[1:] != place[:-1])
    starts = np.flatnonzero(opens)
    lengths = np.bincount((np.cumsum(opens) - 1)[whole], minlength=len(starts)) + WINDOW - 1
    return words, ids, rows, starts, lengths, place[starts], numbered(ids, starts, lengths)


def ask(block, buckets, heavy):
    """Each distinct super-k-mer of the block, with its least and greatest document."""
    block = C.rows_of(block)
    doc = np.array([C.ordered_id(i) for i in block["doc_id"].to_pylist()], C.U64)
    words, ids, rows, starts, lengths, place, number = super_kmers(block["text"].to_pylist(), heavy)
    # Rows ascend by document, so the first sight has the least one and the last the greatest.
    first, last = np.unique(number, return_index=True)[1], np.zeros(len(number), np.int64)
    last[number] = np.arange(len(number))
    last = last[:len(first)]
    bucket = (place[first] % C.U64(buckets)).astype(np.int64)
    least, greatest = doc[rows[starts[first]]], doc[rows[starts[last]]]
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, C.group_starts(bucket[order])[1:]):
        if not len(part):
            continue
        used, local = np.unique(ids[spread(starts[first[part]], lengths[first[part]])],
                                return_inverse=True)
        yield int(bucket[part[0]]), C.join((
            zstandard.ZstdCompressor(level=1).compress(b"\n".join([words[k] for k in used])),
            C.pack(local), C.pack(lengths[first[part]]), C.pack_sorted(part),
            C.pack_sorted(least[part]), C.pack(greatest[part] - least[part])))


def answer(bucket):
    """For each block, the windows of its strings that a smaller document also holds."""
    numbers, ids, kmer = C.Numbering(), [], []
    blocks, index, least, greatest, count = [], [], [], [], 0
    for block, blob in zip(bucket["_block"].to_pylist(), bucket["payload"].to_pylist()):
        used, local, lengths, at, low, extra = C.split(blob)
        low = C.unpack_sorted(low)
        at = C.unpack_sorted(at).astype(np.int64)
        used = numbers.of(zstandard.ZstdDecompressor().decompress(used).split()).astype(np.int32)
        ids.append(used[C.unpack(local)])
        kmer.append(np.repeat(np.arange(count, count + len(at), dtype=np.int32), C.unpack(lengths)))
        blocks.append(np.full(len(at), block))
        index.append(at)
        least.append(low)
        greatest.append(low + C.unpack(extra, C.U64))
        count += len(at)
    ids, kmer = np.concatenate(ids), np.concatenate(kmer)
    blocks, index = np.concatenate(blocks), np.concatenate(index)
    least, greatest = np.concatenate(least), np.concatenate(greatest)
    starts = np.flatnonzero(inside(kmer))
    order, groups = sorted_windows(ids, starts)
    owner = kmer[starts]
    lowest = np.minimum.reduceat(least[owner[order]], groups)
    first = np.empty(len(starts), C.U64)
    first[order] = np.repeat(lowest, np.diff(np.append(groups, len(order))))
    # Runs of windows of one string with one smaller first document.
    hit = first < greatest[owner]
    opens = hit & ~np.concatenate(([False], (owner[1:] == owner[:-1]) & hit[:-1]
                                   & (first[1:] == first[:-1])))
    at = np.flatnonzero(opens)
    run = np.cumsum(opens) - 1
    length = np.bincount(run[hit], minlength=len(at))
    string_start = np.searchsorted(kmer, owner[at])
    offset, who = starts[at] - string_start, owner[at]
    to = np.argsort(blocks[who], kind="stable")
    for mine in np.split(to, C.group_starts(blocks[who[to]])[1:]):
        if len(mine):
            yield int(blocks[who[mine[0]]]), C.join((
                C.pack(index[who[mine]]), C.pack(offset[mine]),
                C.pack(length[mine]), C.pack(first[at[mine]])))


def sorted_windows(ids, starts):
    """Windows in an order that puts equal ones together, and where each group starts."""
    hashes = C.rolling(ids.astype(C.U64), WINDOW)[starts]
    order = np.argsort(hashes, kind="stable")
    sorted_hashes = hashes[order]
    same = np.flatnonzero(sorted_hashes[1:] == sorted_hashes[:-1])
    a, b = starts[order[same]], starts[order[same + 1]]
    if not all(np.array_equal(ids[a + k], ids[b + k]) for k in range(WINDOW)):
        columns = [ids[starts + k] for k in range(WINDOW - 1, -1, -1)]
        order = np.lexsort(columns)
        differs = np.zeros(len(order) - 1, bool)
        for c in columns:
            differs |= c[order][1:] != c[order][:-1]
        return order, np.flatnonzero(np.concatenate(([True], differs)))
    return order, C.group_starts(sorted_hashes)


def removed(block, answers, heavy):
    """(mask of removed words, end of each row in it) of a block."""
    doc = np.array([C.ordered_id(i) for i in block["doc_id"].to_pylist()], C.U64)
    _, ids, rows, starts, _, _, number = super_kmers(block["text"].to_pylist(), heavy)
    told = [C.split(blob) for blob in answers["payload"].to_pylist()]
    index, offset, length = (np.concatenate([*(C.unpack(t[k]) for t in told), np.zeros(0, np.int64)])
                             for k in range(3))
    first = np.concatenate([*(C.unpack(t[3], C.U64) for t in told), np.zeros(0, C.U64)])
    order = np.argsort(index, kind="stable")
    low, high = (np.searchsorted(index[order], number, side) for side in ("left", "right"))
    at = order[spread(low, high - low)]
    begin = np.repeat(starts, high - low)
    hit = first[at] < doc[rows[begin]]
    begin, at = (begin + offset[at])[hit], at[hit]
    mask = C.covered(begin, begin + length[at] - 1 + WINDOW, len(ids))
    return mask, np.cumsum(np.bincount(rows, minlength=len(doc)))


def removed(block, answers, heavy):
    """(mask of removed words, end of each row in it) of a block."""
    doc = np.array([C.ordered_id(i) for i in block["doc_id"].to_pylist()], C.U64)
    _, ids, rows, starts, _, _, number = super_kmers(block["text"].to_pylist(), heavy)
    told = [C.split(blob) for blob in answers["payload"].to_pylist()]
    index, offset, length = (np.concatenate([*(C.unpack(t[k]) for t in told), np.zeros(0, np.int64)])
                             for k in range(3))
    first = np.concatenate([*(C.unpack(t[3], C.U64) for t in told), np.zeros(0, C.U64)])
    order = np.argsort(index, kind="stable")
    low, high = (np.searchsorted(index[order], number, side) for side in ("left", "right"))
    at = order[spread(low, high - low)]
    begin = np.repeat(starts, high - low)
    hit = first[at] < doc[rows[begin]]
    begin, at = (begin + offset[at])[hit], at[hit]
    mask = C.covered(begin, begin + length[at] - 1 + WINDOW, len(ids))
    return mask, np.cumsum(np.bincount(rows, minlength=len(doc)))


def heavy_places(docs, buckets):
    """Minimisers, ascending, that hold more than HEAVY buckets' share of a sample's windows.

    They only place work: their windows are dealt by all their words, so equal ones still meet. At
    most buckets / HEAVY of them can exist. The sample is one document in EVERY, more of small tables.
    """
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(min(buckets, EVERY))) == 0)

    def count(batches):
        for b in batches:
            words, ids, rows = read(b["text"].to_pylist())
            hashes = np.fromiter(map(C.word_hash, words), C.U64, len(words))[ids]
            place, n = np.unique(windows(hashes)[inside(rows)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(place.view(np.int64)), pa.array(n, pa.int64())],
                                             names=["place", "n"])

    counts = C.stored(chosen.select(C.text_bytes().alias("text")).mapInArrow(
        count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter(F.col("n") * buckets > HEAVY * total).filter(F.col("n") >= FEWEST).collect()
    return np.sort(np.array([r.place for r in rows], np.int64).view(C.U64))


def cut(text: bytes, mask) -> bytes:
    """The text without the masked words and the white space after them."""
    kept, last = [], 0
    at = [m.start() for m in VISIBLE.finditer(text)] + [len(text)]
    for a, b in zip(*C.runs(mask)):
        kept.append(text[last:at[a]])
        last = at[b]
    return b"".join(kept) + text[last:]


def substring_dedup(docs: DataFrame, *carried) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, the shortened text, and the carried columns."""
    blocks = C.blocked(docs.select("doc_id", C.text_bytes().alias("text"), *carried), *carried)
    buckets = C.bucket_count(docs)
    heavy = heavy_places(docs, buckets)

    def finish(block, answers):
        block = C.rows_of(block)
        n_words, n_removed, digests, texts = [], [], [], []
        every, ends = removed(block, answers, heavy)
        for text, mask in zip(block["text"].to_pylist(), np.split(every, ends[:-1])):
            words = text.split()
            kept = [w for w, gone in zip(words, mask.tolist()) if not gone] if mask.any() else words
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            texts.append((cut(text, mask) if len(kept) < len(words) else text).decode())
        out = {"doc_id": block["doc_id"], "n_words": pa.array(n_words, pa.int64()),
               "n_removed": pa.array(n_removed, pa.int64()),
               "kept_sha256": pa.array(digests, pa.string()), "text": pa.array(texts, pa.string())}
        return pa.table(out | {c: block[c] for c in carried})

    kinds = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", "n_words long", "n_removed long", "kept_sha256 string",
                        "text string", *(f"`{c}` {kinds[c]}" for c in carried)])
    return C.dialogue(blocks, lambda b: ask(b, buckets, heavy), answer, finish, schema)


SQL = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, list_slice(ws, i, i + {WINDOW - 1}) AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)
), first AS (
  SELECT hash(win) AS h, win, min(doc_id) AS d FROM win GROUP BY ALL
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i
  FROM win JOIN first USING (win) WHERE doc_id > d
), kept AS (
  SELECT w.doc_id, p.i, ws[p.i] AS word, g.i IS NOT NULL AS removed
  FROM w, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i) p
  LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = p.i
), done AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (removed) AS n_removed,
    string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS kept
  FROM kept GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN done USING (doc_id)"""
