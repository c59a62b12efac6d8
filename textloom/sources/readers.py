"""Readers for the corpus file shapes, and the column parsers behind them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import clean
from textloom.functions.tokens import unnest
from textloom.operators import order
from textloom.session import stage

LABEL_PREFIX = "__label__"


def folder_label(path: Column, labels: dict | None = None) -> Column:
    """Class of a file: the name of its folder, mapped through `labels` when given."""
    folder = F.regexp_extract(path, r"([^/]+)/[^/]*\z", 1)
    return clean.literal_map(labels.items())[folder] if labels else folder


def read_class_folders(spark: SparkSession, root: str, labels: dict | None = None,
                       skip_header=True, encoding="utf-8") -> DataFrame:
    """(path, text, label) rows from folders of text files, one folder per class."""
    raw = spark.read.format("binaryFile").load(f"{root}/*/*").select(
        F.col("path"), F.decode("content", encoding).alias("text"))
    text = clean.skip_first_line(F.col("text")) if skip_header else F.col("text")
    return raw.select("path", text.alias("text"), folder_label(F.col("path"), labels)
                      .alias("label"))


def name_label(name: Column, rules=(("joke", 1), ("mix", -1)), default=0) -> Column:
    """Label of the first substring found in a file name."""
    out = F.lit(default)
    for part, label in reversed(list(rules)):
        out = F.when(F.contains(name, F.lit(part)), label).otherwise(out)
    return out


def number_rows(df: DataFrame, order_by, name="position") -> DataFrame:
    """Positions from 1 over the whole table, numbered part by part."""
    return order.ranked(df, [], [F.col(c) for c in order_by], name)


def zip_by_position(left: DataFrame, right: DataFrame, left_order, right_order) -> DataFrame:
    """Join two tables row by row in their sort orders; the row counts must agree."""
    a, b = number_rows(left, left_order), number_rows(right, right_order)
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} rows cannot be matched with {m} rows by position")
    return a.join(b, "position")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, value): every line of text files with its place in its file.

    Spark deals a file in byte ranges; `block` is where a line's range begins and `at` grows inside it.
    So lines keep their order although no file is one row or one task, on any storage Spark reads.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")


def running_counts(lines: DataFrame, values: dict, by=("path",)) -> DataFrame:
    """Running sums over the lines of each file (or, with no `by`, of all files in the order of paths).

    A task reads a byte range's lines in their order, so it adds them up as it reads, and no line is
    shuffled; the ranges' sums, one row each, give what stands before a range. `_range` and `_file` number
    the ranges and files.
    """
    names = list(values)
    counts = [F.col(f"_v_{n}") for n in names]
    lines = lines.withColumns({f"_v_{n}": values[n] for n in names})
    every = Window.orderBy("path", "block")
    earlier = Window.partitionBy(*by).orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = lines.groupBy("path", "block").agg(*[F.sum(c).alias(n) for n, c in zip(names, counts)])
    ranges = stage(ranges.select(
        "path", "block", F.row_number().over(every).alias("_range"),
        F.dense_rank().over(Window.orderBy("path")).alias("_file"),
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in names]))
    rest = [c for c in lines.columns if c not in ("path", "block")]
    rows = lines.join(F.broadcast(ranges.select("path", "block", "_range")), ["path", "block"]).select("_range", *rest)
    summed = rows.mapInArrow(_running([f"_v_{n}" for n in names]), rows.schema)
    found = summed.join(F.broadcast(ranges), "_range")
    kept = [c for c in lines.columns if not c.startswith("_v_")]
    return found.select("_range", "_file", *kept, *[
        (c + F.col(f"_before_{n}")).alias(n) for n, c in zip(names, counts)])


def _running(names):
    """Running sums of columns over the rows of each `_range`, which follow one another."""
    def run(batches):
        last, held = None, {}
        for b in batches:
            if not b.num_rows:
                continue
            part = b["_range"].to_numpy()
            starts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
            sizes = np.diff(starts, append=len(part))
            for name in names:
                v = b[name].to_numpy()
                upto = np.cumsum(v)
                before = (upto - v)[starts]
                if part[0] == last:
                    before[0] -= held[name]
                upto -= np.repeat(before, sizes)
                held[name] = upto[-1]
                b = b.set_column(b.schema.get_field_index(name), name, pa.array(upto, pa.int64()))
            last = part[-1]
            yield b
    return run


def split_targets(text: Column) -> Column:
    """Numbers of a whitespace-separated line of a target file."""
    return F.transform(clean.words(text), lambda t: t.cast("double"))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """(position, target): the numbers of a target file (or of its parts in the order of their paths)."""
    lines = read_lines(spark, path).withColumn("_y", split_targets(F.col("value")))
    ends = running_counts(lines, {"_upto": F.size("_y").cast("long")}, by=())
    each = ends.select("_upto", F.size("_y").alias("_n"), F.posexplode("_y").alias("_i", "target"))
    return each.select((F.col("_upto") - F.col("_n") + F.col("_i") + 1).alias("position"), "target")


def read_with_targets(spark: SparkSession, texts: str, target: str) -> DataFrame:
    """Text files with the numbers of one target file, matched by sorted path; the counts must agree."""
    docs = spark.read.text(texts, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    docs, y = number_rows(docs, ["path"]), read_targets(spark, target)
    n, m = docs.count(), y.count()
    if n != m:
        raise ValueError(f"{n} rows cannot be matched with {m} rows by position")
    return docs.join(y, "position").drop("position")


def parse_annotated(text: Column) -> Column:
    """Token structs of an annotated file: tab lines are tokens, any other line ends a sentence."""
    sentences = F.split(text, r"(?m)^[^\t\n]*(?:\n|\z)")

    def one(sentence, i):
        lines = F.filter(F.split(sentence, "\n"), lambda x: F.contains(x, F.lit("\t")))

        def token(line):
            f = F.split(line, "\t")
            return F.struct(
                (i + 1).cast("long").alias("sentence_id"), F.get(f, F.lit(1)).alias("raw"),
                F.get(f, F.lit(2)).alias("lemma"), F.get(f, F.lit(3)).alias("upos"))

        return F.transform(lines, token)

    return F.flatten(F.transform(sentences, one))


def read_annotated(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, sentence_id, raw, lemma, upos) of annotated files, read line by line: a line with tabs is
    a token, any other line ends a sentence."""
    return annotated_ranges(spark, path).drop("_range", "_file")


def annotated_ranges(spark: SparkSession, path: str) -> DataFrame:
    """The same with the numbers of each row's byte range and file."""
    lines = read_lines(spark, path)
    token = F.contains("value", F.lit("\t"))
    counted = running_counts(lines, {"_tokens": token.cast("long"), "_breaks": (~token).cast("long")})
    f = F.split("value", "\t")
    return counted.filter(token).select(
        "_range", "_file", "path", (F.col("_tokens") - 1).alias("pos"), (F.col("_breaks") + 1).alias("sentence_id"),
        F.get(f, F.lit(1)).alias("raw"), F.get(f, F.lit(2)).alias("lemma"), F.get(f, F.lit(3)).alias("upos"))


def lemma_counts(tokens: DataFrame) -> DataFrame:
    """(lemma, n_tokens, n_sentences) of the rows of `annotated_ranges`.

    Sentences that lie whole in a batch of rows are counted there. The others, at most two a batch and two
    a range, are put together by file and sentence.
    """
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            part, sentence = b["_range"].to_numpy(), b["sentence_id"].to_numpy()
            new = np.concatenate(([True], (part[1:] != part[:-1]) | (sentence[1:] != sentence[:-1])))
            starts = np.flatnonzero(new)
            other = np.concatenate(([True], np.diff(part[starts]) != 0, [True]))
            cut = other[:-1] | other[1:]
            t = pa.table({"lemma": b["lemma"], "at": np.cumsum(new) - 1}).group_by(["lemma", "at"]).aggregate(
                [([], "count_all")])
            at = t["at"].to_numpy()
            whole = t.filter(~cut[at]).group_by("lemma").aggregate([("count_all", "sum"), ([], "count_all")])
            none = pa.nulls(whole.num_rows)
            yield from pa.table({
                "lemma": whole["lemma"], "n": whole["count_all_sum"].cast(pa.int64()),
                "sentences": whole["count_all"].cast(pa.int64()), "file": none.cast(pa.int32()),
                "sentence": none.cast(pa.int64())}).to_batches()
            t, row = t.filter(cut[at]), starts[at[cut[at]]]
            yield from pa.table({
                "lemma": t["lemma"], "n": t["count_all"].cast(pa.int64()), "sentences": np.ones(t.num_rows, np.int64),
                "file": b["_file"].to_numpy()[row], "sentence": sentence[row]}).to_batches()

    found = tokens.select("_range", "_file", "sentence_id", "lemma").mapInArrow(
        run, "lemma string, n long, sentences long, file int, sentence long")
    joined = found.groupBy("lemma", "file", "sentence").agg(
        F.sum("n").alias("n"), F.when(F.col("sentence").isNull(), F.sum("sentences")).otherwise(1).alias("s"))
    return joined.groupBy("lemma").agg(F.sum("n").alias("n_tokens"), F.sum("s").alias("n_sentences"))


def read_tsv(spark: SparkSession, path: str, schema: str, header=True, sep="\t") -> DataFrame:
    """Delimited text without quoting."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, quote="", escape="")


def read_groups(spark: SparkSession, path: str, schema="id string, text string, label int"):
    """Headerless (id, text, label) files; the group is the file's stem, without a part's number."""
    rows = read_tsv(spark, path, schema, header=False)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.\d+)?(\.[^./]*)?\z", 1)
    return rows.withColumn("grp", stem)


def parse_labelled_line(line: Column) -> Column:
    """`label <tab> tokens` as a struct."""
    parts = F.split(line, "\t", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("label"),
                    clean.words(F.get(parts, F.lit(1))).alias("tokens"))


def parse_prefixed_line(line: Column, prefix=LABEL_PREFIX) -> Column:
    """Words of a line parted into labels (by prefix, which is cut) and plain words."""
    found = clean.words(line)
    return F.struct(
        F.transform(F.filter(found, lambda t: t.startswith(prefix)),
                    lambda t: F.replace(t, F.lit(prefix), F.lit(""))).alias("labels"),
        F.filter(found, lambda t: ~t.startswith(prefix)).alias("words"))


def parse_vector_line(line: Column, dim: int) -> Column:
    """The last `dim` fields are the vector, what stands before them is the word."""
    f = F.split(line, " ")
    return F.struct(
        F.array_join(F.slice(f, 1, F.greatest(F.size(f) - dim, F.lit(0))), " ").alias("word"),
        F.transform(F.slice(f, F.greatest(F.size(f) - dim, F.lit(0)) + 1, dim),
                    lambda x: x.try_cast("float")).alias("vec"))


def read_vectors(spark: SparkSession, path: str, dim: int, words: DataFrame | None = None):
    """(word, vec) rows; lines without `dim` numbers (such as a header) are dropped. `words`
    restricts the table before the numbers are parsed."""
    lines = spark.read.text(path).filter(F.size(F.split("value", " ")) > dim)
    if words is not None:
        key = F.regexp_extract("value", rf"^(.*?)((?: [^ ]+){{{dim}}})\z", 1)
        lines = lines.withColumn("word", key).join(words.select("word"), "word", "left_semi")
    out = lines.select(parse_vector_line(F.col("value"), dim).alias("v")).select("v.*")
    return out.filter(~F.exists("vec", lambda x: x.isNull()))


def element(html: Column, tag: str) -> Column:
    """Text of each element of one name."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def read_records(df: DataFrame, text: str, record: str, fields: dict, keys=()) -> DataFrame:
    """One row per record element. `fields` maps a prefix to the element whose
    text becomes a prefixed category."""
    rec = unnest(df, keys, element(F.col(text), record), "_body", "record")

    def prefixed(prefix, tag):
        plain = lambda x: F.concat(F.lit(prefix), clean.strip(clean.strip_tags(x)))
        return F.transform(element(F.col("_body"), tag), plain)

    cats = F.flatten(F.array(*[prefixed(p, t) for p, t in fields.items()]))
    return rec.withColumn("categories", cats)
