"""Approximate nearest neighbours: NN-descent builds the graph, queries search it greedily.

Equal vectors are one node; its SPARE smallest ids are kept, more than any answer can use. The graph
starts from the leaves of TREES random-projection trees. Their depth follows the table: the first cuts
are fitted on at most SAMPLE vectors, leaves of more than SAMPLE are cut again by trees fitted on their
own vectors, and each last leaf is cut by its task down to 2 * LEAF. Then neighbours of neighbours are
joined: a node's list and the nodes that list it meet in one place, every pair with a new entry is a
candidate for each other's list, and a list keeps its LIST nearest. Candidates travel only if they beat
the last entry of the list they are for. Of the nodes that list a node, a round draws about LIST of the
new and LIST of the older ones, by a hash of the round. Rounds end when at most SHARE of all entries
are new. The search is approximate by contract, and every vector is in the graph.

The search is best-first. Queries start from their own node; each hop expands the EXPAND nearest nodes
that were not expanded, asks the buckets that own their neighbours for distances, and keeps the BEAM
nearest; a query ends when all of these are expanded. A query is one row with its beam and the ids it
has seen. Buckets follow the number of nodes (NODES each) and of queries (QUERIES each). The nodes that list a node are dealt into groups of
about LIST; query and hop pick the group, so that a hub's links are all walked by some query.
Vectors travel as given (single floats, or doubles), and every distance that a list, a beam or an
answer keeps is that of `apart`: the vectors' own difference, in double precision, at any scale.
Products only rule out pairs that are further off by more than their rounding error.

Vectors that are null, zero, or hold null or non-finite components take no part; neither do null ids,
nor vectors of another length than most of the sample. Repeated ids are rows of their own; a query is
never its own neighbour by id. An empty table gives no rows; other columns are ignored.
"""

import itertools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import common as C

TOP = 10
EVERY = 100
LIST = 24
SPARE = TOP + 1
TREES, LEAF, SAMPLE = 4, 128, 20_000
SHARE = 0.001
BEAM, EXPAND = 128, 16
NODES, QUERIES = 32_768, 1024
SEED = 7
ROUNDING = 1e-9
PIECE = 16_384
EDGE = "src long, dst long, d double"
LISTED = EDGE + ", fresh boolean"
PLACED = "tree int, leaf long, node long, vec binary"
DEEPER = 1 << 16
STATES = ("q", "vec", "ids", "d", "done", "seen", "expand")
STATE = "q long, vec binary, ids binary, d binary, done binary, seen binary, expand array<long>"


def usable(df: DataFrame) -> DataFrame:
    """Rows (vec_id, v) that take part, with components as doubles."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return df.select(F.col("vec_id").cast("long"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine & some)


def nodes_of(rows: DataFrame) -> DataFrame:
    """One node per distinct vector: node (least id), its smallest ids, and the vector."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("_r", rank).filter(F.col("_r") <= SPARE)
    grouped = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return grouped.select(F.col("ids")[0].alias("node"), "ids", "v")


def kind_of(vectors: DataFrame):
    """Type that holds the table's components without loss."""
    return np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64


def vectors_of(column, kind):
    """Matrix of packed vectors, in doubles."""
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)


def apart(a, b):
    """Distance of every row of a to the same row of b; neither overflow nor underflow spoils it."""
    with np.errstate(over="ignore", under="ignore"):
        diff = a - b
        d = np.sqrt((diff * diff).sum(1))
        odd = np.flatnonzero(~((d > 1e-140) & (d < 1e140)))
        if len(odd):
            half = np.where(np.isinf(diff[odd]).any(1), 2.0, 1.0)
            diff = a[odd] / half[:, None] - b[odd] / half[:, None]
            top = np.abs(diff).max(1)
            diff /= np.where(top > 0, top, 1)[:, None]
            d[odd] = np.sqrt((diff * diff).sum(1)) * top * half
    return d


def products(x):
    """Squared distances of all pairs by one product, and a bound of their rounding error."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        y = x - x.mean(0)
        square = (y * y).sum(1)
        both = square[:, None] + square
        return both - 2 * y @ y.T, ROUNDING * both + 1e-280


def closer(x, limit, fresh):
    """(i, j, distance) of the ordered pairs, one of them fresh, with a distance below row i's limit."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        square, error = products(x)
        off = square - error >= (limit * limit * (1 + ROUNDING))[:, None]
        off &= np.isfinite(square)
    off |= ~(fresh[:, None] | fresh)
    np.fill_diagonal(off, True)
    i, j = np.nonzero(~off)
    d = apart(x[i], x[j])
    below = d < limit[i]
    return i[below], j[below], d[below]


def cut(x, rng):
    """(normal, cut, rows below it) of a random projection; None if three of them part nothing."""
    for _ in range(3):
        a, b = x[rng.choice(len(x), 2, replace=False)]
        side = x @ (a - b)
        at = np.median(side)
        low = side <= at
        if low.any() and not low.all():
            return a - b, at, low
    return None


def tree_of(x, least, rng):
    """Nested (normal, cut, left, right) nodes down to `least` rows; a leaf is None."""
    found = cut(x, rng) if len(x) > least else None
    if found is None:
        return None
    normal, at, low = found
    return normal, at, tree_of(x[low], least, rng), tree_of(x[~low], least, rng)


def trees(sample):
    """The first cuts of every tree."""
    rng = np.random.default_rng(SEED)
    return [tree_of(sample, max(LEAF * len(sample) / SAMPLE, 16), rng) for _ in range(TREES)]


def parts_of(x, most, rng):
    """Row numbers of the parts of at most `most` rows; rows that no cut parts are halved at random."""
    done, stack = [], [np.arange(len(x))]
    while stack:
        rows = stack.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        found = cut(x[rows], rng)
        low = found[2] if found else rng.permutation(len(rows)) * 2 < len(rows)
        stack += [rows[low], rows[~low]]
    return done


def level(x, scale):
    """Components by the sample's usual size, within what a projection can add up."""
    with np.errstate(over="ignore"):
        return np.clip(x / scale, -1e100, 1e100)


def leaves(tree, x):
    """Leaf number of every row, as the bits of its path."""
    out = np.ones(len(x), np.int64)
    stack = [(tree, np.arange(len(x)))]
    while stack:
        at, rows = stack.pop()
        if at is None or not len(rows):
            continue
        normal, cut, left, right = at
        high = x[rows] @ normal > cut
        out[rows] = out[rows] * 2 + high
        stack += [(left, rows[~high]), (right, rows[high])]
    return out


def nearest_in(ids, x, count=LIST):
    """Edges from every row to its nearest others among the same rows."""
    k = min(count, len(ids) - 1)
    if k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    square, error = products(x)
    known = np.isfinite(square)
    np.fill_diagonal(known, False)
    with np.errstate(over="ignore", invalid="ignore"):
        upto = np.partition(np.where(known, square + error, np.inf), k - 1, axis=1)[:, k - 1]
        near = ~known | (square - error <= upto[:, None])
    np.fill_diagonal(near, False)
    i, j = np.nonzero(near)
    return best_edges(ids[i], ids[j], apart(x[i], x[j]), count)


def best_rows(src, dst, d, fresh, count=LIST):
    """Row numbers of the nearest `count` distinct entries of every source, known ones before fresh."""
    order = np.lexsort((fresh, dst, d, src))
    a, b = src[order], dst[order]
    same = np.zeros(len(order), bool)
    same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    order = order[~same]
    begin = C.group_starts(src[order])
    sizes = np.diff(np.append(begin, len(order)))
    return order[np.arange(len(order)) - np.repeat(begin, sizes) < count]


def best_edges(src, dst, d, count=LIST):
    """The nearest `count` distinct entries of every source."""
    rows = best_rows(src, dst, d, np.zeros(len(src), bool), count)
    return src[rows], dst[rows], d[rows]


def edge_table(src, dst, d):
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()),
                     "d": pa.array(d, pa.float64())})


def lists(edges: DataFrame, n) -> DataFrame:
    """The nearest LIST entries of every source, by buckets of sources."""
    def keep(table):
        rows = best_rows(*(table[c].to_numpy() for c in ("src", "dst", "d", "fresh")))
        return table.select(["src", "dst", "d", "fresh"]).take(pa.array(rows))

    bucket = F.pmod(F.xxhash64("src"), F.lit(n)).cast("int")
    return edges.withColumn("_b", bucket).groupBy("_b").applyInArrow(keep, LISTED)


def deepen(placed: DataFrame, sizes: DataFrame, kind, scale, most) -> DataFrame:
    """Leaves of more than `most` vectors, cut by trees that are fitted on about `most` of each."""
    large = sizes.filter(F.col("c") > most)
    rows = placed.join(large, ["tree", "leaf"], "left").withColumn(
        "salt", F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("c") / most)))
    chosen = rows.filter(F.pmod(F.xxhash64("node", F.lit(2)), F.col("c")) < most)

    def fitted(key, table):
        table = table.sort_by("node")
        rng = np.random.default_rng([SEED, *(k.as_py() for k in key)])
        grown = tree_of(level(vectors_of(table["vec"], kind), scale), max(most // 256, 16), rng)
        return C.table(("tree", "leaf", "grown"), (pa.int32(), pa.int64(), pa.binary()),
                       [(*(k.as_py() for k in key), pickle.dumps(grown))])

    grown = chosen.select("tree", "leaf", "node", "vec").groupBy("tree", "leaf").applyInArrow(
        fitted, "tree int, leaf long, grown binary")
    grown = grown.join(large, ["tree", "leaf"]).select(
        "tree", "leaf", "grown", F.explode(F.sequence(F.lit(0).cast("long"),
                                                      F.ceil(F.col("c") / most) - 1)).alias("salt"))

    def moved(table, fit):
        tree = pickle.loads(fit["grown"][0].as_py()) if fit.num_rows else None
        path = 1 + table["salt"].to_numpy() % (DEEPER - 1)
        if tree is not None and table.num_rows:
            path = leaves(tree, level(vectors_of(table["vec"], kind), scale))
        leaf = pa.array(table["leaf"].to_numpy() * DEEPER + path, pa.int64())
        return pa.table({"tree": table["tree"], "leaf": leaf, "node": table["node"], "vec": table["vec"]})

    key = ["tree", "leaf", "salt"]
    cut_again = rows.filter("c IS NOT NULL").select(*key, "node", "vec").groupBy(*key).cogroup(
        grown.groupBy(*key)).applyInArrow(moved, PLACED)
    return rows.filter("c IS NULL").select("tree", "leaf", "node", "vec").unionByName(cut_again)


def start(nodes: DataFrame, kind, n) -> DataFrame:
    """Edges between the vectors of every leaf part."""
    most, small = SAMPLE, 2 * LEAF
    few = nodes.orderBy(F.xxhash64("node"), "node").limit(most).select("v").collect()
    sizes = [len(r.v) for r in few]
    width = max(set(sizes), key=sizes.count) if sizes else 0
    sample = np.array([r.v for r in few if len(r.v) == width]).reshape(-1, max(width, 1))
    scale = np.median(np.abs(sample).max(1)) if len(sample) else 1.0
    grown = trees(level(sample, scale))
    grown = nodes.sparkSession.sparkContext.broadcast(grown)

    def dealt(batches):
        for b in batches:
            x = np.array(b["v"].to_pylist(), np.float64).reshape(b.num_rows, -1)
            flat = level(x, scale)
            for k, tree in enumerate(grown.value):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), k), pa.int32()), pa.array(leaves(tree, flat), pa.int64()),
                     b["node"], pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())],
                    names=["tree", "leaf", "node", "vec"])

    placed = C.stored(nodes.filter(F.size("v") == width).select("node", "v").mapInArrow(dealt, PLACED))
    while True:
        sizes = placed.groupBy("tree", "leaf").agg(F.count("*").alias("c"))
        if (sizes.agg(F.max("c")).first()[0] or 0) <= most:
            break
        placed = C.stored(deepen(placed, C.stored(sizes), kind, scale, most))
    # A bucket holds whole leaves, as many as fit a bounded task.
    placed = placed.withColumn("_b", F.pmod(F.xxhash64("tree", "leaf"), F.lit(TREES * n)).cast("int"))

    def joined(table):
        table = table.sort_by([(c, "ascending") for c in ("tree", "leaf", "node")])
        key = np.stack([table[c].to_numpy() for c in ("tree", "leaf")])
        ids = table["node"].to_numpy()
        x = vectors_of(table["vec"], kind)
        bounds = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        found = []
        for rows in np.split(np.arange(len(ids)), bounds):
            rng = np.random.default_rng([SEED, *key[:, rows[0]].tolist()])
            for part in parts_of(level(x[rows], scale), small, rng):
                found.append(nearest_in(ids[rows[part]], x[rows[part]]))
        return edge_table(*best_edges(*map(np.concatenate, zip(*found))))

    return placed.groupBy("_b").applyInArrow(joined, EDGE), width


def crowd(edges: DataFrame, *also) -> DataFrame:
    """How many groups of about LIST the nodes that list a node make."""
    return edges.groupBy(F.col("dst").alias("centre"), *also).agg(
        F.ceil(F.count("*") / LIST).alias("groups"))


def drawn(edges: DataFrame, turn) -> DataFrame:
    """(centre, member, fresh): about LIST new and LIST older nodes that list a centre, by the round."""
    back = edges.select(F.col("dst").alias("centre"), F.col("src").alias("member"), "fresh")
    return back.join(crowd(edges, "fresh"), ["centre", "fresh"]).filter(
        F.pmod(F.xxhash64("centre", "member", F.lit(turn)), F.col("groups")) == 0).select(
        "centre", "member", "fresh")


def descend(edges: DataFrame, packed: DataFrame, kind, n, turn) -> DataFrame:
    """One round: candidates from pairs of a node's neighbours, merged into all lists."""
    radius = edges.groupBy("src").agg(F.max("d").alias("radius"), F.count("*").alias("c"))
    radius = radius.select(F.col("src").alias("member"), F.when(
        F.col("c") < LIST, F.lit(float("inf"))).otherwise(F.col("radius")).alias("radius"))
    own = edges.select(F.col("src").alias("centre"), F.col("dst").alias("member"), "fresh")
    members = packed.select(F.col("node").alias("member"), "vec").join(radius, "member")
    some = F.max("fresh").over(Window.partitionBy("centre"))
    met = own.unionByName(drawn(edges, turn)).repartition(n, "centre").groupBy("centre", "member").agg(
        F.max("fresh").alias("fresh")).withColumn("_some", some).filter("_some").drop("_some")
    met = met.join(members, "member").withColumn(
        "_b", F.pmod(F.xxhash64("centre"), F.lit(4 * n)).cast("int"))

    def joined(table):
        centre, member, limit, fresh = (
            table[c].to_numpy() for c in ("centre", "member", "radius", "fresh"))
        x = vectors_of(table["vec"], kind)
        order = np.argsort(centre, kind="stable")
        found = [[], [], []]
        for rows in np.split(order, C.group_starts(centre[order])[1:]):
            if not fresh[rows].any():
                continue
            i, j, d = closer(x[rows], limit[rows], fresh[rows])
            for out, v in zip(found, (member[rows[i]], member[rows[j]], d)):
                out.append(v)
        if not found[0]:
            return edge_table([], [], [])
        return edge_table(*best_edges(*map(np.concatenate, found)))

    made = met.select("centre", "member", "fresh", "vec", "radius", "_b").groupBy("_b").applyInArrow(
        joined, EDGE)
    return lists(edges.withColumn("fresh", F.lit(False)).unionByName(
        made.withColumn("fresh", F.lit(True))), n)


def graph(nodes: DataFrame, kind, n):
    """(edges of the finished graph, packed vectors of the nodes, their length)."""
    def pack(batches):
        for b in batches:
            x = [np.array(v, kind).tobytes() for v in b["v"].to_pylist()]
            owner = pa.array(home(b["node"].to_numpy(), n), pa.int32())
            yield pa.RecordBatch.from_arrays([b["node"], pa.array(x, pa.binary()), owner],
                                             names=["node", "vec", "owner"])

    first, width = start(nodes, kind, n)
    packed = C.stored(nodes.filter(F.size("v") == width).select("node", "v").mapInArrow(
        pack, "node long, vec binary, owner int"))
    edges = C.stored(lists(first.withColumn("fresh", F.lit(True)), n))
    for turn in itertools.count():
        new, entries = edges.agg(F.count_if("fresh"), F.count("*")).first()
        if new <= SHARE * entries:
            return edges, packed, width
        edges = C.stored(descend(edges, packed, kind, n, turn))


def home(node, n):
    """The bucket that owns a node."""
    return (C.mix(node.astype(C.U64)) % C.U64(n)).astype(np.int32)


def longs(blob):
    return np.frombuffer(blob, np.int64)


def joined_longs(blobs):
    return longs(b"".join(blobs))


def asks_of(n):
    """(q, owner, vec, ids): the unseen nodes that a query wants measured, by owning bucket."""
    def asks(state, ways):
        names, kinds = ("q", "owner", "vec", "ids"), (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        wanted = {}
        for q, blob in zip(ways["asker"].to_pylist(), ways["next"].to_pylist()):
            wanted.setdefault(q, []).append(blob)
        rows = []
        for q, vec, seen in zip(*(state[c].to_pylist() for c in ("q", "vec", "seen"))):
            fresh = np.setdiff1d(joined_longs(wanted.get(q, ())), longs(seen))
            owner = home(fresh, n)
            order = np.argsort(owner, kind="stable")
            for part in np.split(order, C.group_starts(owner[order])[1:]):
                if len(part):
                    rows.append((q, int(owner[part[0]]), vec, fresh[part].tobytes()))
        return C.table(names, kinds, rows)

    return asks


def near_of(kind):
    """(q, ids, d): a bucket's distances between queries and the nodes they want."""
    def near(asks, held):
        ids = held["node"].to_numpy()
        order = np.argsort(ids)
        x = vectors_of(held["vec"], kind)
        wanted = [longs(blob) for blob in asks["ids"].to_pylist()]
        if not wanted:
            return C.table(("q", "ids", "d"), (pa.int64(), pa.binary(), pa.binary()), [])
        y = vectors_of(asks["vec"], kind)
        ends = np.cumsum([len(w) for w in wanted])
        of = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
        at = order[np.searchsorted(ids[order], np.concatenate(wanted))]
        d = np.concatenate([apart(x[at[k:k + PIECE]], y[of[k:k + PIECE]])
                            for k in range(0, len(at), PIECE)])
        return pa.table({"q": asks["q"], "ids": asks["ids"], "d": pa.array(
            [part.tobytes() for part in np.split(d, ends[:-1])], pa.binary())})

    return near


def advance(state, answers):
    """States with the answers put in, and the nodes that each query expands next.

    Those are its EXPAND nearest unexpanded nodes among the BEAM nearest found; a query without any
    is at its end. `seen` holds every node measured for it, ascending.
    """
    found = {}
    for q, ids, d in zip(*(answers[c].to_pylist() for c in ("q", "ids", "d"))):
        found.setdefault(q, []).append((ids, d))
    out = []
    for q, vec, ids, d, done, seen, _ in zip(*(state[c].to_pylist() for c in STATES)):
        more = found.get(q, ())
        fresh = joined_longs(i for i, _ in more)
        ids = np.concatenate([longs(ids), fresh])
        d = np.concatenate([np.frombuffer(d), np.frombuffer(b"".join(v for _, v in more))])
        done = np.concatenate([np.frombuffer(done, bool), np.zeros(len(fresh), bool)])
        keep = np.lexsort((ids, d))[:BEAM]
        ids, d, done = ids[keep], d[keep], done[keep]
        turn = np.flatnonzero(~done)[:EXPAND]
        done[turn] = True
        seen = np.sort(np.concatenate([longs(seen), fresh]))
        out.append((q, vec, ids.tobytes(), d.tobytes(), done.tobytes(), seen.tobytes(),
                    ids[turn].tolist()))
    return C.table(STATES, (pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64())), out)


def ways_of(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, part, next): a node's own list, and the nodes that list it in groups, as packed ids."""
    def pack(batches):
        for b in batches:
            ids = [np.array(v, np.int64).tobytes() for v in b["next"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["node"], b["part"], pa.array(ids, pa.binary())],
                                             names=["node", "part", "next"])

    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("next")).join(groups, "node")
    back = back.withColumn("part", F.pmod(F.xxhash64("node", "next"), F.col("groups"))).drop("groups")
    own = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"),
                       F.lit(-1).cast("long").alias("part"))
    return own.unionByName(back).groupBy("node", "part").agg(
        F.collect_list("next").alias("next")).mapInArrow(pack, "node long, part long, next binary")


def search(edges: DataFrame, packed: DataFrame, starts: DataFrame, kind, n) -> DataFrame:
    """(q, node, d) of the BEAM nearest nodes found for each starting node, itself included.

    A query is one row that a hop rewrites; what it asks and what it learns travel as packed ids.
    """
    groups = C.stored(crowd(edges).withColumnRenamed("centre", "node"))
    ways = C.stored(ways_of(edges, groups))
    share = F.pmod(F.xxhash64("q"), F.lit(max(n, -(-starts.count() // QUERIES)))).cast("int")

    def begin(batches):
        for b in batches:
            ids = [np.int64(q).tobytes() for q in b["node"].to_pylist()]
            yield C.batch(STATES, (pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64())), [
                (int(longs(i)[0]), vec, i, np.zeros(1).tobytes(), b"\1", i, [int(longs(i)[0])])
                for i, vec in zip(ids, b["vec"].to_pylist())])

    state = C.stored(starts.join(packed, "node").select("node", "vec").mapInArrow(begin, STATE))
    for hop in itertools.count():
        going = state.filter(F.size("expand") > 0)
        if going.isEmpty():
            break
        picked = F.pmod(F.xxhash64("q", "node", F.lit(hop)), F.coalesce("groups", F.lit(1).cast("long")))
        parts = F.array(F.lit(-1).cast("long"), picked)
        ways_on = going.select("q", F.explode("expand").alias("node")).join(groups, "node", "left").select(
            "q", "node", F.explode(parts).alias("part")).join(ways, ["node", "part"]).select(
            share.alias("_g"), F.col("q").alias("asker"), "next")
        asks = going.select(share.alias("_g"), "q", "vec", "seen").groupBy("_g").cogroup(
            ways_on.groupBy("_g")).applyInArrow(asks_of(n), "q long, owner int, vec binary, ids binary")
        answers = asks.groupBy("owner").cogroup(packed.groupBy("owner")).applyInArrow(
            near_of(kind), "q long, ids binary, d binary")
        state = C.stored(state.withColumn("_g", share).groupBy("_g").cogroup(
            answers.withColumn("_g", share).groupBy("_g")).applyInArrow(advance, STATE))

    def pairs(batches):
        for b in batches:
            ids = [longs(v) for v in b["ids"].to_pylist()]
            d = [np.frombuffer(v) for v in b["d"].to_pylist()]
            q = np.repeat(b["q"].to_numpy(), [len(v) for v in ids])
            yield pa.RecordBatch.from_arrays(
                [pa.array(q), pa.array(np.concatenate([*ids, np.zeros(0, np.int64)])),
                 pa.array(np.concatenate([*d, np.zeros(0)]))], names=["q", "node", "d"])

    return state.select("q", "ids", "d").mapInArrow(pairs, "q long, node long, d double")


def nearest_neighbours(vectors: DataFrame, is_query=None, top=TOP) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of every query's nearest found."""
    if top >= SPARE:
        raise ValueError(f"at most {SPARE - 1} neighbours are kept")
    is_query = F.col("vec_id") % EVERY == 0 if is_query is None else is_query
    rows = usable(vectors)
    nodes = C.stored(nodes_of(rows))
    n = max(C.partitions(vectors.sparkSession), -(-nodes.count() // NODES))
    kind = kind_of(vectors)
    edges, packed, width = graph(nodes, kind, n)
    asking = rows.filter(is_query).filter(F.size("v") == width).join(
        nodes.select("node", F.col("v").alias("_v")), F.col("v") == F.col("_v")).select(
        F.col("vec_id").alias("query_id"), "node")
    asking = C.stored(asking)
    found = search(edges, packed, asking.select("node").distinct(), kind, n)
    pairs = asking.withColumnRenamed("node", "q").join(found, "q").join(
        nodes.select("node", "ids"), "node")
    pairs = pairs.select("query_id", F.col("d").alias("score"), F.explode("ids").alias("vec_id"))
    pairs = pairs.filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= top).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score")
