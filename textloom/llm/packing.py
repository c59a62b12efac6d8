"""Cost-balanced packing of documents into training sequences.

Documents are tokenised once and cut into pieces of at most one sequence. Pieces are dealt into
bounded groups by a hash of document and piece, so that no task grows with the input or with one
very long document. In a group, attention cost (linear plus quadratic in the piece's length) decides:
descending pieces go to the open sequence of lowest cost that still has room, and what fits nowhere
whole is cut to fill the remaining room. A group opens just as many sequences as its tokens need, so
it pads less than one sequence in all; the number of groups follows the bytes of text alone.

Nulls: a null text counts as empty and gives one piece, the end mark; a null id is passed on.
Repeated rows are packed one by one. An empty table gives no rows; other columns are ignored.
"""

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C

CAPACITY = 2048
END = 1
GROUP_BYTES = 2 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
SEQUENCES_PER_GROUP = 1 << 32
SPECIAL = "<|endoftext|>"


def vocabulary():
    """Tokenizer file and its rank file, from the package of public tokenizers."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


class Encoder:
    """Token ids of texts, as little-endian 16-bit numbers.

    Whole texts are encoded by the ranks: on text of many rare words that takes half the time of keeping
    the ids of its words. A text with the special token's string needs the tokenizer itself, which is
    only loaded for one.
    """

    def __init__(self, files=None):
        import base64

        import tiktoken

        self.file, ranks_file, pattern = files or vocabulary()
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks,
                                       special_tokens={})

    @functools.cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def ids(self, text: str) -> bytes:
        if SPECIAL in text:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        return np.array(ids, "<u2").tobytes()


ENCODER = None


def encoder():
    global ENCODER
    if ENCODER is None:
        ENCODER = Encoder()
    return ENCODER


def cut(batches):
    """Rows (doc_id, start, doc_tokens, ids) of pieces of at most one sequence."""
    enc, step = encoder(), 2 * CAPACITY
    end = np.array([END], "<u2").tobytes()
    for b in C.sliced(batches):
        ids, starts, totals, blobs = [], [], [], []
        for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
            blob = enc.ids(t) + end
            for at in range(0, len(blob), step):
                ids.append(i)
                starts.append(at // 2)
                totals.append(len(blob) // 2)
                blobs.append(blob[at:at + step])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(totals, pa.int64()),
             pa.array(blobs, pa.binary())], names=["doc_id", "start", "doc_tokens", "ids"])
    C.release()


def cost(length):
    return LINEAR * length + QUADRATIC * length * length


def place(lengths, capacity=CAPACITY):
    """(piece, from, to, sequence, offset) of every part, for pieces no longer than a sequence.

    Whole pieces in descending length go to the cheapest sequence with room; the others are cut
    into the largest rooms that are left.
    """
    lengths = np.asarray(lengths, np.int64)
    n = -(-int(lengths.sum()) // capacity)
    full = np.zeros(n)
    spent, parts, left = np.zeros(n), [], []
    for p in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[p])
        masked = np.where(full + size <= capacity, spent, np.inf)
        s = int(np.argmin(masked))
        if masked[s] == np.inf:
            left.append(p)
            continue
        parts.append((p, 0, size, s, int(full[s])))
        full[s] += size
        spent[s] += cost(size)
    for p in left:
        done, size = 0, int(lengths[p])
        while done < size:
            s = int(np.argmin(full))
            take = min(size - done, int(capacity - full[s]))
            parts.append((p, done, done + take, s, int(full[s])))
            full[s] += take
            spent[s] += cost(take)
            done += take
    return parts


def pack_group(table: pa.Table, with_ids: bool) -> pa.Table:
    table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"),
                                                         ("start", "ascending")]))
    group = table["_group"][0].as_py()
    ids, starts = table["doc_id"].to_pylist(), table["start"].to_pylist()
    totals = table["doc_tokens"].to_pylist()
    blobs = [np.frombuffer(x, "<u2") for x in table["ids"].to_pylist()]
    rows = []
    for p, a, b, s, offset in place([len(x) for x in blobs]):
        wide = blobs[p][a:b].astype("<u4").tobytes()
        rows.append((ids[p], starts[p] + a, b - a, zlib.crc32(wide), totals[p],
                     group * SEQUENCES_PER_GROUP + s, offset, wide if with_ids else None))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [pa.int64()] * 7 + [pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def pack(docs: DataFrame, with_ids=False) -> DataFrame:
    """One row per piece: where it stands in its document and in its sequence, and its ids.

    `ids` (unsigned 32-bit, little-endian) is null unless `with_ids`.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    pieces = docs.select("doc_id", text).mapInArrow(
        cut, "doc_id long, start long, doc_tokens long, ids binary")
    size = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    groups = max(1, -(-(size[0] + (size[1] or 0)) // GROUP_BYTES))
    key = F.xxhash64("doc_id", "start", F.crc32("ids"))
    dealt = pieces.withColumn("_group", F.pmod(key, F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(
        lambda t: pack_group(t, with_ids),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
        "offset long, ids binary")
