"""Url filter, turn repair and centroid clustering against plain versions, and their odd cases."""

import hashlib
import math
import os
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

from textloom.llm import clustering, neighbours, turns, urlfilter
from textloom.llm.queries import ORACLES, QUERIES
from textloom.session import ship

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
from check import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, name):
    ship(spark)
    assert compare(QUERIES[name](spark, SF).toPandas(), connect(SF).sql(ORACLES[name]).df()) is None


def test_neighbours_of_nothing_are_nothing():
    import numpy as np

    none = np.zeros(0, np.int64)
    assert len(neighbours.best_rows(none, none, np.zeros(0), np.zeros(0, bool))) == 0
    assert [len(x) for x in neighbours.best_edges(none, none, np.zeros(0))] == [0, 0, 0]


@pytest.mark.parametrize("n, parts", [(1, 8), (2, 8), (11, 60)])
def test_neighbours_in_small_tables_and_many_partitions(spark, n, parts):
    """All candidates come, nearest first, ties to the smaller id, however few vectors a bucket holds."""
    ship(spark)
    rows = [(i, [float(i // 2), 1.0], 0) for i in range(n)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        got = neighbours.nearest_neighbours(df).orderBy("query_id", "rank").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = sorted((abs(x[0]), i) for i, x, _ in rows[1:])[:10]
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [
        (0, k, i, d) for k, (d, i) in enumerate(want, 1)]


# Url filter

def plain_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fitting = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES
               if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fitting:
        return (host, path, *max(fitting)[1:], 0, 0)
    text = host + "".join(c.lower() if "A" <= c <= "Z" else c for c in path)
    found = [sum(bool(re.search(f"(?<![a-z0-9]){w}(?![a-z0-9])", text)) for w in words)
             for words in (urlfilter.STRICT, urlfilter.SOFT)]
    return host, path, None, "block" if found[0] or found[1] > 1 else "allow", *found


def test_urls(spark):
    ship(spark)
    urls = [None, "", "no address", "http://", "://", "http:///en/", "ftp://NET/x", "http://net", "http://a.net?x",
            "http://A.Example.NET/en/x?q=casino", "https://example.com/de", "https://example.com/de/",
            "https://x.example.com/DE/", "http://a.org/fr/x", "http://org.fr/", "http://xexample.net/en/",
            "http://casino.com/", "http://casinos.com/", "http://a.com/free-free-free", "http://a.com/free.bets",
            "http://a.com/x?cheap&pills", "http://a.com/Adult/WIN#x", "http://é.com/écasinoé", "a://b://casino.com/",
            "http://a.com/\ncasino\n", "http://" + "a." * 5000 + "net/x", "http://a.com/" + "y" * 200_000 + "/porn",
            "http://free-adsx.com/xads/adsads-bets", "http://u@net:80/", "http://a.com/farmwin-winfarm"]
    rng = random.Random(5)
    words = [*urlfilter.STRICT, *urlfilter.SOFT, "net", "com", "org", "example", "en", "de", "fr"]
    urls += ["http://" + "".join(rng.choice(words) + rng.choice("./-x/?#") for _ in range(6)) for _ in range(300)]
    urls += urls[:20]
    rows = [(i, u, "h", "r") for i, u in enumerate(urls)] + [(None, "http://net/", "h", "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string").repartition(3)
    out = urlfilter.judge(df)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.strict_terms, r.soft_terms) for r in out.collect()}
    assert got == {i: plain_verdict(u) for i, u, _, _ in rows}
    empty = urlfilter.judge(df.limit(0))
    assert empty.count() == 0 and empty.columns == out.columns


def test_url_rules_are_parameters(spark):
    ship(spark)
    df = spark.createDataFrame([(1, "http://a.b.c/x/y"), (2, "http://b.c/"), (3, "http://bad.word/good")],
                               "page_id long, url string")
    rules = [("c", "/x/yy", "no"), ("b.c", "/x", "longer"), ("c", "/x/y", "longest path"), ("a.b.c", "", "host")]
    rows = urlfilter.judge(df, rules, strict=["word"], soft=[]).orderBy("page_id").collect()
    # c/x/y, b.c/x and a.b.c are equally long: the longest host decides.
    assert [(r.rule, r.verdict) for r in rows] == [("a.b.c", "host"), (None, "allow"), (None, "block")]
    assert rows[2].terms == ["word"]


# Turn repair

def plain_repair(rows):
    """rows: (turn, role, text) in order. Least (cost, audit) by a forward pass with whole strings."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(turns.BLANKS)
        faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    to = {"": "su", "s": "u", "u": "a", "a": "u"}
    state = {"": (0, "", ())}

    def offer(new, q, cost, audit, out):
        if q not in new or (cost, audit) < new[q][:2]:
            new[q] = (cost, audit, out)

    def inserted(state):
        state = dict(state)
        for _ in range(2):
            for q, (cost, audit, out) in list(state.items()):
                n = to[q].replace("s", "")
                offer(state, n, cost + 3, audit + "I", (*out, ("user:" if n == "u" else "assistant:")))
        return state

    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for q, (cost, audit, out) in inserted(state).items():
            offer(new, q, cost + 4, audit + "D", out)
            if fault in (1, 2):
                continue
            cut = 3 * (fault == 3)
            if role[:1] in to[q] and role[:1]:
                offer(new, role[:1], cost + cut, audit + "K", (*out, f"{role}:{text}"))
            n = to[q].replace("s", "")
            offer(new, n, cost + cut + 3, audit + "R", (*out, ("user:" if n == "u" else "assistant:") + text))
        state = new
    ends = [state[""]] if "" in state else []
    ends += [v for q, v in inserted(state).items() if q == "a"]
    cost, audit, out = min(ends, key=lambda e: e[:2])
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return (gaps, *(faults.count(k) for k in (1, 2, 3)), wrong, cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest()), list(out)


def in_order(rows):
    tie = lambda r: hashlib.md5(f"{r[1]}\n{r[2]}".encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r)))


def conversations(seed=1):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "u", " "]
    texts = ["a.", "b", "c!", "", " \n", "a.", "d?\t", "e. f", "É.", "x" * 50_000 + "."]
    out = []
    for c in [None, *range(25)]:
        for k in range(rng.choice([0, 1, 2, 3, 5, 9])):
            turn = rng.choice([k, k, k, k + 3, None, 0])
            out.append((c, turn, rng.choice(roles), rng.choice(texts[:-1] if k else texts)))
    return out


def held(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_turn_repair(spark, parts):
    ship(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = conversations()
        df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, part int")
        got = held(turns.repair(df))
        want = {c: plain_repair(in_order([r[1:] for r in rows if r[0] == c])) for c in {r[0] for r in rows}}
        assert got == {c: w[0] for c, w in want.items()}
        lines = {}
        for r in turns.repaired_turns(df).orderBy("conv_id", "position").collect():
            lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert lines == {c: w[1] for c, w in want.items() if w[1]}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_turn_repair_of_one_long_conversation(spark):
    ship(spark)
    rng = random.Random(9)
    rows = [(5, k, rng.choice(["user", "assistant", "system"]), f"{rng.randrange(15_000)}{rng.choice(['.', '!', ''])}")
            for k in range(14_000)]
    rows += [(4, 0, "user", "a."), (4, 1, "assistant", "b."), (6, 0, "assistant", "b.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = held(turns.repair(df))
    for c in (4, 5, 6):
        assert got[c] == plain_repair([r[1:] for r in rows if r[0] == c])[0]


def test_dropped_repeated_and_empty_turns(spark):
    ship(spark)
    schema = "conv_id long, turn long, role string, text string, copies int"
    df = spark.createDataFrame([(1, 0, "user", "a.", 0), (2, 0, "user", "a.", 2), (2, 1, None, None, 1)], schema)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = held(turns.repair(df))
    assert got[1] == none
    assert got[2] == plain_repair([(0, "user", "a."), (0, "user", "a."), (1, " ", " ")])[0]
    assert turns.repair(df.limit(0)).count() == 0
    damaged = turns.damage(spark.createDataFrame([(None, None, None, None)] * 3, schema.rsplit(",", 1)[0]))
    assert len(held(turns.repair(damaged))) == 1


# Centroid clustering

def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * v) if abs(v) < 2**53 else int(v) * 1024 for v in x]) for i, x in rows
            if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centres = [x for _, x in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))

    def assign():
        return [min((far(x, c), j) for j, c in enumerate(centres)) for _, x in kept]

    for _ in range(rounds):
        mine = {}
        for (_, x), (_, j) in zip(kept, assign()):
            mine.setdefault(j, []).append(x)
        centres = [[sum(v) // len(mine[j]) for v in zip(*mine[j])] if j in mine else c
                   for j, c in enumerate(centres)]
    out, long = assign(), lambda n: n if n < 2**63 else None
    per = [sum(d for d, j in out if j == c) for c in range(k)]
    per = [None if any(long(d) is None for d, j in out if j == c) else long(per[c]) for c in range(k)]
    whole = None if any(long(d) is None for d, _ in out) else long(sum(d for d, _ in out))
    return sorted(((i, j, long(d), per[j], whole, hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest())
                   for (i, _), (d, j) in zip(kept, out)), key=repr)


def vectors(seed, n, spread=1.0):
    rng = random.Random(seed)
    heads = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    return [[v + rng.gauss(0, spread) for v in rng.choice(heads)] for _ in range(n)]


@pytest.mark.parametrize("case", ["plain", "odd", "huge", "few"])
def test_clusters(spark, case):
    ship(spark)
    base = vectors(2, 150, 0.3)
    rows = list(enumerate(base))
    if case == "odd":
        rows += [(i, base[7]) for i in range(200, 350)] + [(3, base[9]), (3, base[9]), (None, base[1]), (None, base[2])]
        rows += [(400, None), (401, []), (402, base[0][:63]), (403, base[0] + [1.0]), (404, [None] + base[0][1:]),
                 (405, [math.nan] + base[0][1:]), (406, [math.inf] + base[0][1:]), (407, [0.0] * 64)]
    if case == "huge":
        rows = rows[:40] + [(500, [1e300] * 64), (501, [-1e300] + [0.0] * 63), (502, [2e5] * 64), (503, [1e-320] * 64)]
    if case == "few":
        rows = rows[:3]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<double>, cluster int")
    out = clustering.summary(*clustering.cluster(df.repartition(3)))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain_clusters(rows)


def test_no_vectors(spark):
    ship(spark)
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    out = clustering.summary(*clustering.cluster(df))
    assert out.count() == 0 and "centroid_sha256" in out.columns


def test_pivots_save_distances_and_never_lose_the_nearest():
    import numpy as np

    space = clustering.Space(64, 1024)
    x = space.integers(np.array(vectors(4, 2000, 0.2)))
    centres = space.centres(x[:8].tolist())
    d = np.stack([clustering.length(clustering.squared(x, p)) for p in centres], 1)
    pairs = clustering.pivot_pairs(centres)
    true = np.stack([clustering.squared(x, c) for c in centres], 1)
    moved = space.centres((x[:8] + 9).tolist())
    for c in (centres, moved):
        true = np.stack([clustering.squared(x, m) for m in c], 1)
        low = clustering.lower_bounds(d, clustering.length(clustering.squared(c[:, None], centres[None])), pairs)
        assert (low <= np.sqrt(true)).all()
        number, best, measured = clustering.nearest(x, d, c, centres, pairs)
        assert (best == true.min(1)).all() and (number == true.argmin(1)).all()
        assert measured < 0.6 * true.size


def test_damage_uses_every_kind(spark):
    df = spark.range(400).select(F.col("id").alias("conv_id"), F.lit(1).alias("turn"),
                                 F.lit("assistant").alias("role"), F.lit("Oh. My!").alias("text"))
    out = turns.damage(df)
    assert {r.copies for r in out.select("copies").distinct().collect()} == {0, 1, 2}
    assert {r.text for r in out.select("text").distinct().collect()} == {"", "Oh My", "Oh. My!"}
    assert {r.role for r in out.select("role").distinct().collect()} == {"user", "assistant"}
