import numpy as np
from pyspark.ml.linalg import Vectors
from textloom.operators import learn


def test_product_codes_name_the_nearest_centre(spark):
    rng = np.random.default_rng(3)
    # Two slices of two dimensions, each with three far groups: every group gets its own code.
    spots = np.array([[0, 0], [10, 0], [0, 10]])
    picks = rng.integers(0, 3, (60, 2))
    picks[:9] = [(a, b) for a in range(3) for b in range(3)]
    x = np.concatenate([spots[picks[:, s]] for s in (0, 1)], axis=1) + rng.normal(0, 0.1, (60, 4))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())],
                               "vec_id long, v array<double>")
    # As many centres as rows: every row is its own centre, so codes tell all slices apart.
    every = {r.vec_id: r.codes for r in learn.product_codes(df, "v", 4, 2, 60).collect()}
    for s in (0, 1):
        assert len({every[i][s] for i in range(60)}) == 60
    # Fewer centres: a code never covers rows of two groups that another code also covers.
    few = {r.vec_id: r.codes for r in learn.product_codes(df, "v", 4, 2, 20).collect()}
    assert len(few) == 60 and all(0 <= c < 20 for codes in few.values() for c in codes)
    for s in (0, 1):
        groups = {}
        for i, codes in few.items():
            groups.setdefault(codes[s], set()).add(int(picks[i, s]))
        assert all(len(g) == 1 for g in groups.values())
    assert learn.product_codes(df.limit(0), "v", 4, 2).count() == 0


def test_top_labels_are_ordered_with_ties_by_name_order(spark):
    df = spark.createDataFrame([(1, Vectors.dense([0.2, 0.5, 0.3])),
                                (2, Vectors.dense([0.4, 0.2, 0.4]))], ["doc_id", "probability"])
    got = [(r.doc_id, r["rank"], r.label, r.probability)
           for r in learn.top_labels(df, ["a", "b", "c"], 2).orderBy("doc_id", "rank").collect()]
    assert got == [(1, 1, "b", 0.5), (1, 2, "c", 0.3), (2, 1, "a", 0.4), (2, 2, "c", 0.4)]


def test_gradient_steps_separate_two_clear_classes(spark):
    rows = [(i, float(i % 2), Vectors.dense([1.0 - i % 2, float(i % 2)])) for i in range(40)]
    df = spark.createDataFrame(rows, ["doc_id", "y", "features"])
    for loss in ("log", "hinge"):
        got = learn.sgd(df, df, loss, share=0.5).collect()
        assert len(got) == 40 and all(r.pred == r.doc_id % 2 for r in got)


def test_product_codes_leave_odd_vectors_out(spark):
    rows = [(i, [float(i % 5), float(i % 3), 1.0, 2.0]) for i in range(20)]
    odd = [(90, None), (91, []), (92, [1.0]), (93, [1.0, None, 0.0, 0.0]), (94, [1.0, float("nan"), 0.0, 0.0]),
           (95, [float("inf"), 0.0, 0.0, 0.0]), (96, [0.0] * 5)]
    code = lambda r: sorted((x.vec_id, x.codes) for x in learn.product_codes(
        spark.createDataFrame(r, "vec_id long, v array<double>"), "v", 4, 2, 8).collect())
    assert len(code(rows)) == 20 and code(rows + odd) == code(rows)


def test_product_codes_with_empty_partitions(spark):
    rows = spark.createDataFrame([(i, [float(i % 5), float(i % 3)]) for i in range(9)], "vec_id long, v array<double>")
    assert learn.product_codes(rows.repartition(30), "v", 2, 2, 4).count() == 9
