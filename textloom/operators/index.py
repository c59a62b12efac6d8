"""Exact nearest neighbours through cells around pivots.

Every base vector belongs to the cell of its nearest pivot, and a cell knows how near and far its members
lie from its pivot. By the triangle inequality no member of a cell can be nearer to a query than the
query's distance to the pivot less the cell's farthest member (or the nearest member less that distance).
A query first searches the cells around it that hold enough vectors; its k-th distance there then
rules out most other cells, and the rest is searched too. Results are those of measuring every pair.

Cells are cut into parts of bounded size. A task holds one part and streams the queries sent to it, so the
base table is moved once per phase and never copied, and no group of queries is held.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.blocks import cosines, matrix, squared_distances
from textloom.session import stage

PART_ROWS = 4096
#: Queries that are measured against a part at a time.
ASKED_ROWS = 256
MOST_PIVOTS = 256
#: Rows of queries sent to parts that a task holds at a time.
ROUTED_ROWS = 1 << 14
#: Scores are rounded to six digits and ties go to the smaller id, so bounds leave room for that.
ROOM = 2e-6


def _unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _space(metric):
    """Puts vectors where order by distance is order by score."""
    return _unit if metric == "cosine" else lambda x: x


def chunks(batches, rows=1024):
    """Frames of bounded length, none empty."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at:at + rows]


class VectorIndex:
    """Index of a table (base_id, vec) for cosine or Euclidean distance; ids have any type.

    At most `MOST_PIVOTS` vectors and as many numbers of cells are held by every task. Vectors of length
    zero have cosine 0 with everything; they form a cell of their own that every query searches.
    """

    def __init__(self, base: DataFrame, metric="cosine", part_rows=PART_ROWS):
        self.metric = metric
        self.kind = base.schema["base_id"].dataType.simpleString()
        base = base.select("base_id", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
        n = base.count()
        rows = base.orderBy(F.xxhash64("base_id"), "base_id").limit(
            min(MOST_PIVOTS, max(1, int(np.sqrt(n))))).collect()  # bounded
        space = _space(metric)
        self.pivots = pivots = space(np.array([r["vec"] for r in rows])) if rows else np.zeros((0, 1))

        def place(batches):
            for pdf in chunks(batches):
                x = space(matrix(pdf["vec"]))
                d = np.sqrt(squared_distances(x, pivots))
                cell = d.argmin(axis=1)
                off = d[np.arange(len(x)), cell]
                if metric == "cosine":
                    cell[(x == 0).all(axis=1)] = len(pivots)
                yield pdf.assign(cell=cell.astype(np.int32), off=off)

        placed = base.mapInPandas(
            place, f"base_id {self.kind}, vec array<double>, cell int, off double") if rows else base.select(
                "*", F.lit(0).alias("cell"), F.lit(0.0).alias("off"))
        placed = stage(placed)
        self.cells = placed.groupBy("cell").agg(  # at most MOST_PIVOTS + 1 rows
            F.count("*").alias("n"), F.min("off").alias("low"), F.max("off").alias("high")).toPandas()
        self.cells["parts"] = -(-self.cells["n"] // part_rows)
        parts = dict(zip(self.cells["cell"].tolist(), self.cells["parts"].tolist()))
        many = F.create_map(*[F.lit(v) for kv in parts.items() for v in kv])[F.col("cell")] if parts else F.lit(1)
        part = F.pmod(F.xxhash64("base_id"), many).cast("int")
        self.table = stage(placed.withColumn("part", part))

    def _router(self, first, k):
        """Frames of queries to frames of at most ROUTED_ROWS rows (query columns, cell, part)."""
        cells, pivots, metric, space = self.cells, self.pivots, self.metric, _space(self.metric)
        number, count = cells["cell"].to_numpy(), cells["n"].to_numpy()
        low, high, parts = (cells[c].to_numpy() for c in ("low", "high", "parts"))
        zero = number == len(pivots)
        at = np.where(zero, 0, number)
        most = ROUTED_ROWS
        # The cell and number of every part, and as many queries at a time as such a frame holds.
        cell_of = np.repeat(number, parts).astype(np.int32)
        part_of = (np.concatenate([np.arange(p) for p in parts]) if len(parts) else np.zeros(0)).astype(np.int32)
        begin = np.concatenate([[0], np.cumsum(parts)]).astype(np.int64)
        asked = max(1, min(1024, most // max(1, len(part_of))))

        def run(batches):
            for pdf in chunks(batches, asked):
                q = space(matrix(pdf["vec"]))
                d = np.sqrt(squared_distances(q, pivots))[:, at]
                bound = np.maximum(np.maximum(d - high, low - d), 0.0)
                bound[:, zero] = 0.0
                if metric == "cosine":
                    bound[(q == 0).all(axis=1)] = 0.0
                near = np.argsort(np.where(zero, np.inf, d), axis=1, kind="stable")
                need = k + pdf["banned"].map(len).to_numpy()
                before = np.cumsum(count[near], axis=1) - count[near]
                mine = np.zeros(d.shape, bool)
                np.put_along_axis(mine, near, before < need[:, None], axis=1)
                if not first:
                    limit = pdf["limit"].to_numpy(np.float64)[:, None]
                    mine = ~mine & (np.isnan(limit) | (bound <= limit))
                row, col = np.nonzero(mine)
                if not len(row):
                    continue
                part = np.concatenate([np.arange(begin[c], begin[c + 1]) for c in col])
                row = np.repeat(row, parts[col])
                for a in range(0, len(row), most):
                    out = pdf.iloc[row[a:a + most]].copy()
                    out["cell"], out["part"] = cell_of[part[a:a + most]], part_of[part[a:a + most]]
                    yield out

        return run

    def _route(self, queries, first, k):
        """(query columns, cell, part) rows: the cells a query searches in the first or second phase."""
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
        return queries.mapInPandas(self._router(first, k), f"{kinds}, cell int, part int")

    def _search(self, routed, k):
        """k best of every part for every query sent to it: (query_id, base_id, score)."""
        metric, name = self.metric, routed.schema["query_id"].dataType.simpleString()
        ids = f"array<{self.kind}>"
        both = self.table.select(
            "cell", "part", F.lit(0).alias("side"), "base_id", F.lit(None).cast(name).alias("query_id"), "vec",
            F.lit(None).cast(ids).alias("banned")).unionByName(routed.select(
                "cell", "part", F.lit(1).alias("side"), F.lit(None).cast(self.kind).alias("base_id"), "query_id",
                F.transform("vec", lambda x: x.cast("double")).alias("vec"),
                F.col("banned").cast(ids).alias("banned")))
        schema = f"query_id {name}, base_id {self.kind}, score double"

        def run(batches):
            place, held, points, names = None, [], None, None
            for pdf in batches:
                for spot, rows in pdf.groupby(["cell", "part"], sort=False):
                    if spot != place:
                        place, held, points = spot, [], None
                    base, asked = rows[rows["side"] == 0], rows[rows["side"] == 1]
                    if len(base):
                        held.append(base)
                    if not len(asked) or not held:
                        continue
                    if points is None:
                        part = pd.concat(held).sort_values("base_id", kind="stable")
                        names, points = part["base_id"].to_numpy(), matrix(part["vec"])
                    for at in range(0, len(asked), ASKED_ROWS):
                        yield best(asked.iloc[at:at + ASKED_ROWS], names, points)

        def best(asked, names, points):
            q = matrix(asked["vec"])
            s = cosines(q, points) if metric == "cosine" else -np.round(np.sqrt(squared_distances(q, points)), 6)
            where = {b: i for i, b in enumerate(names)}
            for i, banned in enumerate(asked["banned"]):
                out = [where[b] for b in banned if b in where]
                s[i, out] = -np.inf
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(s, top, axis=1).ravel()
            ok = value > -np.inf
            return pd.DataFrame({"query_id": np.repeat(asked["query_id"].to_numpy(), top.shape[1])[ok],
                                 "base_id": names[top.ravel()[ok]], "score": value[ok] + 0.0})

        sent = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "side")
        return sent.mapInPandas(run, schema)

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, base_id, score, rank) of the k nearest, best first; ties go to the smaller id.

        `queries` is (query_id, vec, banned array of base ids), one row per query_id.
        """
        queries = queries.select("query_id", "vec", "banned")
        name = queries.schema["query_id"].dataType.simpleString()
        if not len(self.pivots):
            schema = f"query_id {name}, base_id {self.kind}, score double, rank int"
            return queries.sparkSession.createDataFrame([], schema)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "base_id")
        ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found = stage(ranked(self._search(self._route(queries, True, k), k)).drop("rank"))
        kth = found.groupBy(F.col("query_id").alias("_q")).agg(
            F.count("*").alias("_n"), F.min("score").alias("_s"))
        # The distance that the k-th score stands for, with room for rounding.
        if self.metric == "cosine":
            limit = F.sqrt(F.greatest(2.0 - 2.0 * F.col("_s"), F.lit(0.0)) + 2 * ROOM) + ROOM
        else:
            limit = -F.col("_s") * (1 + 1e-9) + ROOM
        joined = queries.join(kth, F.col("query_id") == F.col("_q"), "left")
        bounded = joined.select("query_id", "vec", "banned",
                                F.when(F.col("_n") == k, limit).alias("limit"))
        rest = self._search(self._route(bounded, False, k), k)
        return ranked(found.unionByName(rest))

    def pairs_measured(self, queries: DataFrame, k: int) -> int:
        """Pairs of query and base vector that a search measures, to judge the index by."""
        first = self._route(queries.select("query_id", "vec", "banned"), True, k)
        found = self.nearest(queries, k).groupBy(F.col("query_id").alias("_q")).agg(F.min("score").alias("_s"))
        limit = F.sqrt(F.greatest(2.0 - 2.0 * F.col("_s"), F.lit(0.0)) + 2 * ROOM) + ROOM
        if self.metric != "cosine":
            limit = -F.col("_s") * (1 + 1e-9) + ROOM
        again = queries.join(found, F.col("query_id") == F.col("_q")).select(
            "query_id", "vec", "banned", limit.alias("limit"))
        sizes = self.table.groupBy("cell", "part").agg(F.count("*").alias("n"))
        routed = first.select("cell", "part").unionByName(
            self._route(again, False, k).select("cell", "part"))
        return routed.join(F.broadcast(sizes), ["cell", "part"]).agg(F.sum("n")).first()[0] or 0


def nearest(queries: DataFrame, base: DataFrame, k: int, metric="cosine") -> DataFrame:
    """The k nearest base rows of each query: (query_id, base_id, score, rank)."""
    return VectorIndex(base, metric).nearest(queries, k)
