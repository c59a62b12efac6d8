"""Helpers of the training-data operators: blocks of documents, packed arrays, hashes, words.

Work that compares every document with every other is laid out as a dialogue between blocks and
buckets. A block is a bounded set of whole documents (they meet by a hash of their content); a
bucket owns a share of the keys. A block first says once what it holds of each bucket, so a key
that stands in every document reaches its bucket once per block and never once per row. The
bucket answers each block, and the block applies the answers to its own documents.
"""

import contextlib
import ctypes
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F

from textloom.session import CLEANUP, cleaned, shared_dir  # noqa: F401

ROWS_PER_BLOCK = 4096
BUCKETS_PER_PARTITION = 2
BLOCK_BYTES = 8 << 20
SPACE = "[^\\x20\\x09-\\x0D]+"
U64 = np.uint64


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column="text"):
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def bucket_count(docs) -> int:
    """Buckets follow the row count, a few at least for each shuffle partition."""
    least = BUCKETS_PER_PARTITION * partitions(docs.sparkSession)
    return max(least, -(-docs.count() // ROWS_PER_BLOCK))


def blocked(docs, *columns):
    """Blocks of the rows' doc_id, text and named columns, as `_block` and compressed `data`.

    Blocks follow the scan, so `docs` should be a stored table: its tasks read the same rows again
    after a failure, and number them alike.
    """
    def run(batches):
        for k, rows in enumerate(sized(batches)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block_number(k)], pa.int64()), pa.array([to_bytes(rows)], pa.binary())],
                names=["_block", "data"])

    out = docs.select("doc_id", "text", *columns).mapInArrow(run, "_block long, data binary")
    return out.repartition(partitions(docs.sparkSession), "_block")


def sliced(batches, rows=256):
    """The batches in short slices: Spark fills a batch by rows, however long their texts are."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def release():
    """Gives the memory that a Python worker has free back to the system.

    Workers outlive their tasks, and what one has freed stays with it otherwise, so the most that any
    stage needed would stand beside the executor's heap under all later ones.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def sized(batches):
    """Tables of bounded size from record batches."""
    held, size, n = [], 0, 0
    for part in sliced(batches):
        held.append(part)
        size += pc.sum(pc.binary_length(part["text"])).as_py() or 0
        n += part.num_rows
        if size >= BLOCK_BYTES or n >= ROWS_PER_BLOCK:
            yield pa.Table.from_batches(held)
            held, size, n = [], 0, 0
            release()
    if n:
        yield pa.Table.from_batches(held)
    release()


def to_bytes(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
        writer.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def rows_of(block: pa.Table) -> pa.Table:
    """A block's rows by id and text, so that any reader numbers them alike; null ids last."""
    rows = pa.ipc.open_stream(block["data"][0].as_py()).read_all()
    return rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])


@contextlib.contextmanager
def scratch(spark):
    """A folder for `stored` tables that goes, with them, once nothing reads them any more."""
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df, folder=None):
    """The rows as a written table in the shared folder or one below it, with a plan that begins there.

    Loops need this rather than checkpoints, whose plans keep what is known of the columns: that
    grows with every round.
    """
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(mod, rest, column="doc_id"):
    """crc32 of the id as text leaves this remainder; a null id counts as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(mod) == F.lit(rest)


class Numbering(dict):
    """Numbers keys in order of first sight."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n

    def of(self, keys):
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


def pack(values) -> bytes:
    """Unsigned integers as compressed byte planes, only as many as the largest value needs."""
    a = np.ascontiguousarray(values).astype("<u8")
    width = 1
    while width < 8 and len(a) and int(a.max()) >> (8 * width):
        width += 1
    planes = a.view(np.uint8).reshape(-1, 8)[:, :width].T.copy()
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob, dtype=np.int64):
    width = blob[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8)
    out = np.zeros((raw.size // width, 8), np.uint8)
    out[:, :width] = raw.reshape(width, -1).T
    return out.reshape(-1).view("<u8").astype(dtype, copy=False)


def pack_sorted(values) -> bytes:
    """Ascending unsigned integers, as differences."""
    a = np.asarray(values, U64)
    return pack(np.diff(a, prepend=U64(0)) if len(a) else a)


def unpack_sorted(blob):
    return np.cumsum(unpack(blob, U64), dtype=U64)


def join(parts) -> bytes:
    """Byte strings as one."""
    sizes = np.array([len(p) for p in parts], "<u4").tobytes()
    return bytes([len(parts)]) + sizes + b"".join(parts)


def split(blob):
    n = blob[0]
    ends = np.cumsum(np.frombuffer(blob[1:1 + 4 * n], "<u4").astype(np.int64)) + 1 + 4 * n
    return [blob[a:b] for a, b in zip([1 + 4 * n, *ends[:-1]], ends)]


def mix(a):
    """Bijective 64-bit finaliser."""
    a = np.asarray(a, U64)
    a = (a ^ (a >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> U64(27))) * U64(0x94D049BB133111EB)
    return a ^ (a >> U64(31))


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class Hashes(dict):
    """64-bit hash of each distinct word, computed once."""

    def __missing__(self, word):
        self[word] = h = word_hash(word)
        return h

    def of(self, words):
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def rolling(h, n):
    """Hash of every run of n consecutive entries."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    h = mix(h)
    out = np.zeros(m, U64)
    for k in range(n):
        out *= U64(0x9E3779B97F4A7C15)
        out += h[k:k + m]
    return mix(out)


def runs(flags):
    """Starts and ends (exclusive) of the runs of true entries."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], np.asarray(flags, np.int8), [0]))))
    return edges[::2], edges[1::2]


def covered(starts, ends, n):
    """Boolean array of n entries, true inside any [start, end)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def distinct(keys):
    """The distinct entries, ascending; sorting beats the hash table of np.unique on large arrays."""
    keys = np.sort(keys)
    return keys[group_starts(keys)]


def group_starts(sorted_keys):
    """Start of each run of equal entries in a sorted array."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def table(names, kinds, rows):
    """Arrow table of row tuples."""
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


def batch(names, kinds, rows):
    """The same as one record batch."""
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      names=list(names))


NULL_ID = (1 << 64) - 1


def ordered_id(doc_id) -> int:
    """Ids as unsigned numbers in the same order; null is above all."""
    return NULL_ID if doc_id is None else doc_id + (1 << 63)


def dialogue(blocks, ask, answer, finish, schema, shards=None):
    """Blocks ask buckets, buckets answer blocks, blocks finish.

    `ask(table)` yields (bucket, payload) of one block; `answer(table)` gets one bucket's rows
    (`_bucket`, `_block`, `payload`) and yields (block, payload); `finish(block, answers)` returns
    the block's result table. With `shards`, a table of rows by `_bucket`, `answer` also gets the
    bucket's shard. The blocks' exchange is planned once and read by both sides.
    """
    def asked(block):
        number = block["_block"][0].as_py()
        out = table(("_bucket", "_block", "payload"), (pa.int32(), pa.int64(), pa.binary()),
                    [(bucket, number, payload) for bucket, payload in ask(block)])
        release()
        return out

    def answered(bucket):
        out = table(("_block", "payload"), (pa.int64(), pa.binary()), list(answer(bucket)))
        release()
        return out

    def answered_by(bucket, shard):
        rows = list(answer(bucket, shard)) if bucket.num_rows else []
        out = table(("_block", "payload"), (pa.int64(), pa.binary()), rows)
        release()
        return out

    def finished(block, answers):
        out = finish(block, answers)
        release()
        return out

    questions = blocks.groupBy("_block").applyInArrow(
        asked, "_bucket int, _block long, payload binary").groupBy("_bucket")
    reply = "_block long, payload binary"
    if shards is None:
        answers = questions.applyInArrow(answered, reply)
    else:
        answers = questions.cogroup(shards.groupBy("_bucket")).applyInArrow(answered_by, reply)
    return blocks.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(
        finished, schema)


def gathered(batches, size=BLOCK_BYTES):
    """Rows (id, text, ...) of Arrow batches in lists of bounded text size."""
    rows, held = [], 0
    for b in sliced(batches):
        for row in zip(*(c.to_pylist() for c in b.columns)):
            rows.append(row)
            held += len(row[1])
            if held >= size or len(rows) >= ROWS_PER_BLOCK:
                yield rows
                rows, held = [], 0
                release()
    if rows:
        yield rows
    release()


def block_number(k):
    """Number of the k-th block of this task: the same at any retry of a scan."""
    return (TaskContext.get().partitionId() << 32) + k
