"""Centroid clustering in exact integers, with Ptolemaic pivots to save distances.

Vectors become integers, so assignments, sums and floor means are exact and do not depend on how rows
are dealt to tasks. The first centroids serve as pivots. Every vector's distances to the pivots are
written once to the shared folder. For any pivots p and s, Ptolemy's inequality bounds the distance of
vector x and centroid c from below:

    d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s)

Each pivot is paired with the pivot farthest from it. A vector is measured exactly against the centroid
of least bound first; only centroids whose bound, lowered by more than the rounding error, does not
exceed that distance are measured too. Ties go to the smaller number.

A round is one pass over the stored table: tasks sum their vectors per cluster, Spark adds the sums, and
clusters x (dimensions + 1) numbers reach the driver. No row is shuffled, so repeated rows and clusters
that hold most rows need no care. Integers beyond `int64` arithmetic are handled as Python integers:
slower, equally exact; a distance or sum of distances beyond a long comes back as null.

Vectors that are null, of another length, or hold null or non-finite components are left out. A null
vec_id is the empty text where ids are ordered by hash; rows of one id are separate vectors, ordered
by their components. Fewer vectors than centroids give as many centroids as vectors, an empty table gives
no rows. Other columns are ignored.
"""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import stored

DIM, SCALE, CENTRES, ROUNDS, SEED = 64, 1024, 8, 10, "3"
#: Share by which bounds are lowered: far above the error of a few double operations.
SLACK = 1e-12
LONG = (1 << 63) - 1
LIMB = 40


class Space:
    """Integer vectors of one length; `small` components keep every squared distance in int64."""

    def __init__(self, dim, scale):
        self.dim, self.scale = dim, scale
        self.small = math.isqrt((1 << 62) // dim) // 2

    def integers(self, x):
        """floor(scale * x) as int64, or as Python integers where a component is too large.

        The scale is a power of two, so the product is exact as long as it is finite.
        """
        with np.errstate(over="ignore"):
            scaled = np.floor(x * self.scale)
        if not scaled.size or np.abs(scaled).max() <= self.small:
            return scaled.astype(np.int64)
        big = lambda v: int(v) * self.scale if abs(v) >= 2.0**53 else math.floor(v * self.scale)
        return np.array([[big(v) for v in row] for row in x.tolist()], object)

    def centres(self, rows):
        a = np.array(rows, object).reshape(len(rows), self.dim)
        return a.astype(np.int64) if all(abs(v) <= self.small for v in a.ravel()) else a


def squared(x, c):
    d = x - c
    return (d * d).sum(axis=-1)


def length(d):
    """Square root of exact squared distances as doubles; too large ones are infinite."""
    if d.dtype == object:
        d = np.array([v if v < 1 << 1000 else math.inf for v in d.ravel()], np.float64).reshape(d.shape)
    return np.sqrt(d.astype(np.float64))


def pivot_pairs(pivots):
    """(p, s, d(p, s)): each pivot with the one farthest from it; equal pivots give none."""
    out = []
    for p, x in enumerate(pivots):
        d = length(squared(pivots, x))
        s = int(d.argmax())
        if 0 < d[s] < math.inf:
            out.append((p, s, d[s]))
    return out


def lower_bounds(to_pivots, centre_to_pivots, pairs):
    """Bounds of rows x centroids, never above the true distance."""
    low = np.zeros((len(to_pivots), len(centre_to_pivots)))
    for p, s, apart in pairs:
        a = np.outer(to_pivots[:, p], centre_to_pivots[:, s])
        b = np.outer(to_pivots[:, s], centre_to_pivots[:, p])
        np.maximum(low, (np.abs(a - b) - SLACK * (a + b)) / apart, out=low)
    low *= 1 - SLACK
    return low


def nearest(x, to_pivots, centres, pivots, pairs):
    """Number of the nearest centroid and the squared distance of each row, and how many were measured."""
    if x.dtype == object or centres.dtype == object:
        live = np.ones((len(x), len(centres)), bool)
    else:
        low = lower_bounds(to_pivots, length(squared(centres[:, None, :], pivots[None, :, :])), pairs)
        reach = length(squared(x, centres[low.argmin(1)])) * (1 + SLACK)
        live = low <= reach[:, None]
    best, number = np.full(len(x), -1, x.dtype if x.dtype == object else np.int64), np.zeros(len(x), np.int64)
    if centres.dtype == object:
        best = best.astype(object)
    for c, centre in enumerate(centres):
        rows = np.flatnonzero(live[:, c])
        d = squared(x[rows], centre)
        nearer = (best[rows] < 0) | (d < best[rows])
        best[rows[nearer]], number[rows[nearer]] = d[nearer], c
    return number, best, int(live.sum())


def limbs(n):
    """An integer as (place, part) with 0 <= part < 2^40 but for the last, which keeps the sign."""
    place = 0
    while not -(1 << LIMB) <= n < 1 << LIMB:
        yield place, n & ((1 << LIMB) - 1)
        n >>= LIMB
        place += 1
    yield place, n


def matrix(column, dim, kind=np.float64):
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), dim)


def kept(vectors: DataFrame, dim=DIM) -> DataFrame:
    """vec_id and `x` (doubles) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    whole = F.coalesce(F.size(x) == dim, F.lit(False)) & ~F.coalesce(
        F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == math.inf)), F.lit(False))
    return vectors.filter(whole).select(F.col("vec_id").cast("long"), x.alias("x"))


def first_centres(rows, space, k, seed):
    """The k vectors of least hash of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    least = rows.orderBy(F.sha2(name.cast("binary"), 256), "x").limit(k).collect()
    return [[int(v) for v in space.integers(np.array([r["x"]]))[0]] for r in least]


def with_pivots(rows, space, pivots):
    """The rows and their distances to the pivots, stored."""
    def run(batches):
        points = space.centres(pivots)
        for b in batches:
            x = space.integers(matrix(b["x"], space.dim))
            d = np.stack([length(squared(x, p)) for p in points], 1)
            yield pa.RecordBatch.from_arrays(
                [b["vec_id"], b["x"], pa.array(list(d), pa.list_(pa.float64()))],
                names=["vec_id", "x", "to_pivots"])

    return stored(rows.mapInArrow(run, "vec_id long, x array<double>, to_pivots array<double>"))


def assigned(rows, space, pivots, centres, emit, schema):
    """A pass over the stored rows; `emit` turns each batch's answer into Arrow batches."""
    def run(batches):
        points, marks = space.centres(centres), space.centres(pivots)
        pairs = pivot_pairs(marks)

        def answers():
            for b in batches:
                x = space.integers(matrix(b["x"], space.dim))
                d = matrix(b["to_pivots"], len(marks))
                yield b, x, *nearest(x, d, points, marks, pairs)[:2]

        yield from emit(answers())

    return rows.mapInArrow(run, schema)


def moved(rows, space, pivots, centres):
    """Floor means of the clusters' vectors; clusters without vectors keep their centroid."""
    def emit(answers):
        sums = defaultdict(int)
        for _, x, number, _ in answers:
            for c in np.unique(number):
                mine = x[number == c]
                for k, v in enumerate((len(mine), *mine.sum(axis=0).tolist())):
                    sums[int(c), k] += int(v)
        parts = [(c, k, place, part) for (c, k), v in sums.items() for place, part in limbs(v)]
        columns = zip(*parts) if parts else ((),) * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
            names=["cluster", "cell", "place", "part"])

    parts = assigned(rows, space, pivots, centres, emit, "cluster int, cell int, place int, part long")
    total = parts.groupBy("cluster", "cell", "place").agg(
        F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    sums = defaultdict(int)
    for r in total.collect():  # clusters x (dimensions + 1) numbers
        sums[r["cluster"], r["cell"]] += int(r["part"]) << (LIMB * r["place"])
    out = []
    for c, centre in enumerate(centres):
        n = sums[c, 0]
        out.append([sums[c, k + 1] // n for k in range(space.dim)] if n else centre)
    return out


def long_or_none(n):
    return int(n) if n is not None and n <= LONG else None


def cluster(vectors: DataFrame, dim=DIM, scale=SCALE, k=CENTRES, rounds=ROUNDS, seed=SEED):
    """(vec_id, cluster, distance) of every vector that takes part, and the final centroids.

    `scale` is a power of two. `distance` is the squared distance to the own centroid.
    """
    if scale & (scale - 1):
        raise ValueError("the scale must be a power of two")
    space = Space(dim, scale)
    rows = kept(vectors, dim)
    centres = pivots = first_centres(rows, space, k, seed)
    if not centres:
        spark = vectors.sparkSession
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    rows = with_pivots(rows, space, pivots)
    for _ in range(rounds):
        centres = moved(rows, space, pivots, centres)

    def emit(answers):
        for b, _, number, d in answers:
            yield pa.RecordBatch.from_arrays(
                [b["vec_id"], pa.array(number.astype(np.int32)),
                 pa.array([long_or_none(v) for v in d.tolist()], pa.int64())],
                names=["vec_id", "cluster", "distance"])

    out = assigned(rows, space, pivots, centres, emit, "vec_id long, cluster int, distance long")
    return stored(out), centres


def summary(rows: DataFrame, centres) -> DataFrame:
    """The rows of `cluster` with the inertia of their cluster and of all, and their centroid's hash."""
    per = rows.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"),
        (F.count("*") == F.count("distance")).alias("known")).collect()  # one row per cluster
    inertia = {r["cluster"]: r["inertia"] if r["known"] else None for r in per}
    whole = None if None in inertia.values() else sum(inertia.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]

    def by_cluster(values, kind):
        if not values:
            return F.lit(None).cast(kind)
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))

    return rows.select(
        "vec_id", "cluster", "distance",
        by_cluster([long_or_none(inertia.get(c)) for c in range(len(centres))], "long").alias(
            "cluster_inertia"),
        F.lit(long_or_none(whole)).cast("long").alias("inertia"),
        by_cluster(names, "string").alias("centroid_sha256"))


def _sql():
    steps = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = {DIM}
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (
    SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT {CENTRES}))"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""d{r} AS (
  SELECT rid, vec_id, v.x, k, list_sum(list_transform(range(1, {DIM + 1}),
    lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d FROM v CROSS JOIN c{r} c
), a{r} AS MATERIALIZED (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(x) AS x, min(d) AS d, arg_min(k, (d, k)) AS k
  FROM d{r} GROUP BY rid)""")
        if r < ROUNDS:
            steps.append(f"""s{r} AS (
  SELECT k, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, {DIM + 1}) t(i) GROUP BY k, i
), m{r} AS (
  SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY k
), c{r + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (k))""")
    last = ROUNDS
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} c USING (k)"""


SQL = _sql()
