"""Readers, writers, the stage cache and the stream, on real files."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import bayes
from textloom.sources import readers, writers
from textloom.streaming import score


def test_class_folders(spark, tmp_path):
    for folder, text in (("real", "head\n\n one \ntwo\n"), ("fake", "head\nthree")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.txt").write_text(text)
    rows = readers.read_class_folders(spark, str(tmp_path), {"real": "ok", "fake": "bad"}).collect()
    assert {(r.label, r.text) for r in rows} == {("ok", " one two"), ("bad", "three")}


def test_targets_by_position(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for i in range(3):
        (tmp_path / "t" / f"{i}.txt").write_text(f"text {i}")
    target = tmp_path / "target"
    target.write_text("0.5 1\n2")
    rows = readers.read_with_targets(spark, str(tmp_path / "t"), str(target)).collect()
    assert {r.text: r.target for r in rows} == {"text 0": 0.5, "text 1": 1.0, "text 2": 2.0}
    target.write_text("1 2")
    with pytest.raises(ValueError, match="by position"):
        readers.read_with_targets(spark, str(tmp_path / "t"), str(target))


def test_annotated_tokens(spark, tmp_path):
    f = tmp_path / "text1.txt"
    f.write_text("1\tKoirat\tkoira\tNOUN\n2\tjuoksee\tjuosta\tVERB\n\n1\tSe\tse\tPRON\n")
    rows = readers.read_annotated(spark, str(f)).orderBy("pos").collect()
    assert [(r.sentence_id, r.raw, r.lemma, r.upos) for r in rows] == [
        (1, "Koirat", "koira", "NOUN"), (1, "juoksee", "juosta", "VERB"), (2, "Se", "se", "PRON")]


@pytest.fixture
def small_ranges(spark):
    """Files are read in ranges of a few bytes, by many tasks."""
    names = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_sentences_across_ranges_of_a_file(spark, tmp_path, small_ranges):
    lines, want = [], []
    for name, n in (("text1.txt", 90), ("text2.txt", 40), ("text3.txt", 0)):
        sentence, pos, lines = 1, 0, []
        for i in range(n):
            if i % 7 == 3 or i in (10, 11, 12):
                lines.append("" if i % 2 else "end")
                sentence += 1
            else:
                lines.append(f"{i}\tW{i}\tw{i}\tX")
                want.append((name, pos, sentence, f"W{i}", f"w{i}", "X"))
                pos += 1
        (tmp_path / name).write_text("\n".join(lines))
    read = readers.read_annotated(spark, str(tmp_path))
    assert readers.read_lines(spark, str(tmp_path)).select("block").distinct().count() > 5
    got = sorted((r.path.rsplit("/", 1)[1], *r[1:]) for r in read.collect())
    assert got == sorted(want)


def test_targets_across_lines_and_ranges(spark, tmp_path, small_ranges):
    (tmp_path / "y").write_text("\n".join(" ".join(str(i * 10 + k) for k in range(i % 4)) for i in range(60)))
    got = [(r.position, r.target) for r in readers.read_targets(spark, str(tmp_path / "y")).orderBy("position").collect()]
    want = [float(i * 10 + k) for i in range(60) for k in range(i % 4)]
    assert got == list(enumerate(want, 1))


def test_groups_are_named_after_their_files(spark, tmp_path):
    df = spark.createDataFrame([(f"g{i % 3}", str(i), f"t {i}", i) for i in range(20)],
                               "grp string, id string, text string, label int").repartition(4)
    path = str(tmp_path / "out")
    writers.write_groups(df, "grp", path)
    rows = readers.read_groups(spark, f"{path}/*.tsv").select("grp", "id", "text", "label").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, df.collect()))


def test_group_files_and_vectors(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "Songs.tsv").write_text('1\t"quoted" text\t2\n2\tb\t0\n')
    rows = readers.read_groups(spark, str(tmp_path / "g")).collect()
    assert {(r.grp, r.id, r.text, r.label) for r in rows} == {
        ("Songs", "1", '"quoted" text', 2), ("Songs", "2", "b", 0)}
    v = tmp_path / "v.vec"
    v.write_text("2 2\nnew york 0.5 1.5\ncat 1 2\n")
    words = spark.createDataFrame([("new york",)], "word string")
    assert [(r.word, r.vec) for r in readers.read_vectors(spark, str(v), 2, words).collect()] == [
        ("new york", [0.5, 1.5])]
    assert readers.read_vectors(spark, str(v), 2).count() == 2


def test_line_parsers(spark):
    d = spark.createDataFrame([("__label__a __label__b x y",)], "l string")
    p = d.select(readers.parse_prefixed_line(F.col("l")).alias("p")).first().p
    assert (p.labels, p.words) == (["a", "b"], ["x", "y"])


def test_stage_cache_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for params in ({"n": 1}, {"n": 1}, {"n": 2}):
        assert writers.cached(spark, str(tmp_path), "s", params, build).count() == 3
    assert len(calls) == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, "good fine nice" if i % 2 else "bad poor ugly", i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    tf = score.document_terms(df)
    model = bayes.CountModel(tf, df.select("doc_id", "y"), "y")
    src = str(tmp_path / "in")
    df.select("doc_id", "text").repartition(4).write.parquet(src)
    stream = score.read_documents(spark, src, "doc_id long, text string", max_files=1)
    out = str(tmp_path / "out")
    score.score_stream(stream, model, out, str(tmp_path / "progress")).awaitTermination()
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() > 1
    want = {r.doc_id: r.pred for r in model.predict(tf).collect()}
    assert {r.doc_id: r.pred for r in got.collect()} == want == {r[0]: r[2] for r in rows}
