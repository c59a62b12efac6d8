"""Benchmark decontamination with one FM-index per shard of training documents.

Every shard (a bounded run of whole documents) becomes a string over the alphabet of the benchmark's
words. Words that no phrase holds split that string, and pieces shorter than the phrases are left
out, since no phrase can occur there. The string's Burrows-Wheeler transform is kept in a wavelet
matrix whose ranks drive backward search for all phrases at once; sampled suffix positions locate
the occurrences, and their spans are merged per document. Shards need no shuffle.

Phrases are the only thing broadcast. The benchmark is cut into pieces that overlap by a window less
one word, repeated pieces are dropped and the rest dealt by hash into passes of about PASS_BYTES, so a
benchmark of any size is scanned, one pass after the other. Every pass adds its spans and items to
those found before; the rows are written between passes, since ids need not be unique.

Nulls: a null text has no words; a null item text has no phrases; a null id is passed on. Empty
benchmark: no document is hit. Repeated rows are judged one by one; other columns are ignored. Carried
columns may have any name but those of the result.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.llm import common as C

WINDOW = 10
PASS_BYTES = 4 << 20
PIECE_WORDS = 2000
SHARD_BYTES = 8 << 20
SAMPLE = 16
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes outside the word pattern become spaces; A-Z have been lower-cased before.
TABLE = bytes(c if c > 0x7F or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
GAP = 1


def words(text: bytes):
    return text.lower().translate(TABLE).split()


class Bits:
    """Packed bits with the count of ones before each 64 of them."""

    def __init__(self, ones):
        packed = np.packbits(ones, bitorder="little")
        self.words = np.zeros(len(ones) // 64 + 1, "<u8")
        self.words.view(np.uint8)[:len(packed)] = packed
        counts = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        self.before = np.concatenate(([0], counts[:-1])).astype(np.int32)

    def rank(self, upto):
        """Ones before each position."""
        at, inside = upto >> 6, (upto & 63).astype(C.U64)
        mask = (C.U64(1) << inside) - C.U64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask).astype(np.int64)

    def at(self, position):
        return ((self.words[position >> 6] >> (position & 63).astype(C.U64)) & C.U64(1)).astype(np.int64)


class WaveletMatrix:
    """Ranks and symbols of an integer string, one bit level at a time."""

    def __init__(self, symbols, sigma):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.zeros = [], []
        s = symbols
        for level in range(self.levels - 1, -1, -1):
            one = (s >> level) & 1 == 1
            self.bits.append(Bits(one))
            self.zeros.append(len(s) - int(one.sum()))
            s = np.concatenate((s[~one], s[one]))

    def rank(self, symbol, upto):
        """Occurrences of each symbol before each position."""
        start = np.zeros_like(upto)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            bits, zeros, bit = self.bits[k], self.zeros[k], (symbol >> level) & 1
            upto, start = (np.where(bit, zeros + bits.rank(x), x - bits.rank(x)) for x in (upto, start))
        return upto - start

    def at(self, position):
        """Symbol at each position and its rank there."""
        symbol, p = np.zeros_like(position), position
        for bits, zeros in zip(self.bits, self.zeros):
            bit, ones = bits.at(p), bits.rank(p)
            symbol = symbol * 2 + bit
            p = np.where(bit, zeros + ones, p - ones)
        return symbol, self.rank(symbol, position)


class FMIndex:
    """Full-text index of a string of symbols >= 1; 0 is the end mark."""

    def __init__(self, text, sigma):
        text = np.concatenate((text, [0]))
        order = suffix_order(text)
        bwt = text[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.bwt = WaveletMatrix(bwt, sigma)
        kept = (order % SAMPLE == 0) | (order == len(text) - 1)
        self.kept, self.before = kept, np.concatenate(([0], np.cumsum(kept)))
        self.samples = order[kept]

    def search(self, phrases):
        """Row ranges of the suffixes that start with each phrase (a matrix, one phrase a row)."""
        low, high = (np.zeros(len(phrases), np.int64) for _ in range(2))
        left = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[left, j].astype(np.int64)
            if j == phrases.shape[1] - 1:
                a, b = self.first[c], self.first[c + 1]
            else:
                a = self.first[c] + self.bwt.rank(c, low[left])
                b = self.first[c] + self.bwt.rank(c, high[left])
            low[left], high[left] = a, np.maximum(a, b)
            left = left[a < b]
        return low, high

    def locate(self, rows):
        """Text positions of suffix rows: walk back to a sampled one."""
        where, steps = np.zeros(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            found = self.kept[rows]
            where[left[found]] = self.samples[self.before[rows[found]]] + steps
            left, rows = left[~found], rows[~found]
            symbol, rank = self.bwt.at(rows)
            rows, steps = self.first[symbol] + rank, steps + 1
        return where


def suffix_order(text):
    """Order of the suffixes by prefix doubling; the text ends with a unique least symbol."""
    n, step = len(text), 1
    rank = np.unique(text, return_inverse=True)[1]
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:-step or None] = rank[step:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        changed = np.concatenate(([0], key[order][1:] != key[order][:-1]))
        new[order] = np.cumsum(changed)
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1 or step >= 2 * n:
            return order


class Phrases:
    """Test phrases of one length, as rows of word numbers, with the items that hold them."""

    def __init__(self, length, items):
        self.length, self.vocab = length, C.Numbering()
        self.names = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(self.names)}
        rows, owners = [], []
        for item, ws in items:
            ids = (self.vocab.of(ws) + 2).astype(np.int32)
            rows.append(np.lib.stride_tricks.sliding_window_view(ids, length))
            owners.append(np.full(len(rows[-1]), number[item]))
        self.matrix, phrase = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack((phrase.ravel(), np.concatenate(owners)), axis=1), axis=0)
        self.starts = np.searchsorted(pairs[:, 0], np.arange(len(self.matrix) + 1))
        self.owners = pairs[:, 1].astype(np.int32)
        self.sigma = len(self.vocab) + 2

    def items(self, phrase):
        return [self.names[k] for k in self.owners[self.starts[phrase]:self.starts[phrase + 1]]]

    def occurrences(self, numbered):
        """(document, first word, phrase) of every occurrence in documents given as word lists."""
        symbols, docs, places = [], [], []
        look = self.vocab.get
        for doc, ws in numbered:
            s = np.fromiter((look(w, -2) for w in ws), np.int64, len(ws)) + 2
            for a, b in zip(*C.runs(s > 0)):
                if b - a >= self.length:
                    symbols += [s[a:b], [GAP]]
                    docs.append(np.full(b - a + 1, doc))
                    places.append(np.arange(a, b + 1))
        if not symbols:
            return np.zeros((3, 0), np.int64)
        docs, places = np.concatenate(docs), np.concatenate(places)
        index = FMIndex(np.concatenate(symbols), self.sigma)
        low, high = index.search(self.matrix)
        found = high - low
        phrase = np.repeat(np.arange(len(low)), found)
        inside = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
        at = index.locate(low[phrase] + inside)
        return np.stack((docs[at], places[at], phrase))


def phrase_sets(items):
    """Phrases by length; `items` are (id as text, word list), items without words have none."""
    by_length = {}
    for item, ws in items:
        if ws:
            by_length.setdefault(min(len(ws), WINDOW), []).append((item, ws))
    return [Phrases(n, group) for n, group in sorted(by_length.items())]


def judge(texts, sets, before=None):
    """(words, merged spans, items) of each text of one shard, with the spans and items `before`."""
    split = [words(t) for t in texts]
    spans, items = zip(*before) if before else ([[] for _ in texts], [set() for _ in texts])
    for s in sets:
        hits = s.occurrences(enumerate(split))
        for doc, place in hits[:2].T.tolist():
            spans[doc].append((place, place + s.length))
        for doc, phrase in np.unique(hits[[0, 2]], axis=1).T.tolist():
            items[doc].update(s.items(phrase))
    out = []
    for ws, found, held in zip(split, spans, items):
        merged = []
        for a, b in sorted(set(found)):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out.append((len(ws), merged, held))
    return out


def without(text: bytes, spans) -> bytes:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in WORDS.finditer(text.lower())]
    kept, last = [], 0
    for a, b in spans:
        kept.append(text[last:at[a][0]])
        last = at[b - 1][1]
    return b"".join(kept) + text[last:]


RESULT = [("n_words", "long"), ("spans", "array<struct<start:int,end:int>>"),
          ("items", "array<string>"), ("cleaned", "string")]
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, benchmark: DataFrame, *carried, pass_bytes=PASS_BYTES) -> DataFrame:
    """doc_id, the carried columns, words, merged spans (in words, end exclusive), items and the
    text without the spans; `cleaned` is null where nothing was hit, so unhit texts are not copied.
    """
    pieces, passes = benchmark_passes(benchmark, pass_bytes)
    found = docs.select(F.struct("doc_id", *carried).alias("row"), C.text_bytes().alias("text"))
    for k in range(passes):
        part = pieces.filter(F.col("pass") == k).select("item", "piece")
        sets = phrase_sets([(i, bytes(p).split(b" ")) for i, p in part.toLocalIterator()])
        found = scan_once(found, sets)
        if k + 1 < passes:
            found = C.stored(found.drop("n_words", "cleaned"))
    return found.select("row.*", *[name for name, _ in RESULT])


def scan_once(rows: DataFrame, sets) -> DataFrame:
    """Rows (row, text and, after the first pass, spans and items) with what this pass adds."""
    shared = rows.sparkSession.sparkContext.broadcast(sets)

    def shards(batches):
        held, size = [], 0
        for b in C.sliced(batches):
            held.append(b)
            size += b["text"].nbytes
            if size >= SHARD_BYTES:
                yield result(held)
                held, size = [], 0
                C.release()
        if held:
            yield result(held)
        C.release()

    def result(held):
        t = pa.Table.from_batches(held).combine_chunks()
        texts, before = t["text"].to_pylist(), None
        if "spans" in t.column_names:
            before = [([(s["start"], s["end"]) for s in spans], set(items))
                      for spans, items in zip(t["spans"].to_pylist(), t["items"].to_pylist())]
        found = judge(texts, shared.value, before)
        return pa.RecordBatch.from_arrays([
            *(t[c].combine_chunks() for c in ("row", "text")),
            pa.array([r[0] for r in found], pa.int64()),
            pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in found], SPANS),
            pa.array([sorted(r[2]) for r in found], pa.list_(pa.string())),
            pa.array([without(t, r[1]).decode() if r[1] else None for t, r in zip(texts, found)],
                     pa.string()),
        ], names=["row", "text", *(name for name, _ in RESULT)])

    result_fields = StructType.fromDDL(", ".join(map(" ".join, RESULT))).fields
    return rows.mapInArrow(shards, StructType([rows.schema["row"], rows.schema["text"], *result_fields]))


def benchmark_passes(benchmark: DataFrame, pass_bytes):
    """Distinct pieces (item, piece, pass) of the items' words, and the number of passes, at least 1.

    Pieces are far smaller than a pass and distinct, so a hash deals them evenly.
    """
    def cut(batches):
        for b in batches:
            items, pieces = [], []
            for i, t in zip(*(c.to_pylist() for c in b.columns)):
                ws = words(t)
                for at in range(0, max(len(ws) - WINDOW + 1, min(len(ws), 1)), PIECE_WORDS):
                    items.append(i)
                    pieces.append(b" ".join(ws[at:at + PIECE_WORDS + WINDOW - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(pieces, pa.binary())],
                                             names=["item", "piece"])

    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    pieces = C.stored(benchmark.select(item, C.text_bytes().alias("text")).mapInArrow(
        cut, "item string, piece binary").distinct())
    size = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    return pieces.withColumn("pass", F.pmod(F.xxhash64("item", "piece"), F.lit(passes))), passes


def digest(found: DataFrame) -> DataFrame:
    """One row of figures per document."""
    hit = F.aggregate("spans", F.lit(0).cast("long"),
                      lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))


_WORDS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
SQL = f"""
WITH item AS (SELECT item_id, {_WORDS} AS ws FROM benchmark
), phrase AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n,
    unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2),
      lambda i: array_to_string(ws[i:i + least(len(ws), 10) - 1], ' '))) AS p
  FROM item WHERE len(ws) > 0
), d AS (SELECT doc_id, {_WORDS} AS ws FROM documents
), hit AS (
  SELECT w.doc_id, w.i, w.n, item_id FROM (
    SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS p FROM (
      SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
      FROM d, (SELECT DISTINCT n FROM phrase))) w JOIN phrase USING (p, n)
), c AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(ws), 0) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""
