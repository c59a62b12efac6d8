"""Conversation structure repair by prefix-doubling path ranking.

Turns are edited so that the roles' initials read `(s?(ua)+)?`: Keep (K, free), Rerole to user or assistant
(R, 3), Delete (D, 4) or Insert an empty turn of user or assistant (I, 3). Blank and repeated turns must be
deleted; a truncated turn that stays costs 3 more. Of the cheapest edits the ones whose initials, the
audit, come first in ASCII order are chosen.

A node is a place between turns and a state of the grammar (nothing yet, after s, after u, after a). A
backward pass over the turns gives every node its least cost to the end, for all conversations of a block
at once. Arcs on cheapest paths are kept. Nodes are then ranked by the first 1, 2, 4, ... letters of their
least audit: a node's rank for twice the length comes from its own rank and the rank of the node that its
pointer reaches, and pointers double along. No two arcs of a node carry the same letter, so an audit names
one path, which the doubled pointers mark from the conversation's first node.

Turns are sorted by conversation and turn into blocks of bounded size. A conversation inside one block
is finished there. One that touches a block's edge, be it a third of all turns, is cut into parts: each part
yields a 4 x 4 matrix of costs between states, a scan of the matrices from the last part to the first gives
every part its costs to the end, parts are ranked side by side, and a last scan in order strings their
audits together. The scans read sorted parts one by one and hold none of them. The audit and the hash
are one value per conversation by contract, so that last scan of one conversation is one task's.

Turns are ordered by turn number (nulls first), then by the md5 of role and text; repeated rows are turns
of their own. Null roles and texts are one space, null conversation ids form one conversation, texts may
have any length, an empty table gives no rows, other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import block_number, group_starts, partitions, sized, stored

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
#: State that a kept turn leads to, by state and initial (s, u, a, other); -1 is against the grammar.
KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: State that an inserted or re-roled turn leads to, and that turn's role.
NEXT = np.array([2, 2, 3, 2])
ROLE = {2: "user", 3: "assistant"}
#: Cost and edits from each state to the end of a conversation.
END_COST = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
END_AUDIT = ("", "II", "I", "")
INITIALS = {"s": 0, "u": 1, "a": 2}
LEGAL = np.array([[0, 1, 0, 0], [0, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 0]], bool)
FAR = np.int64(1 << 40)
LETTERS = np.frombuffer(b"DIKR", np.uint8)

COUNTS = ("blank", "duplicate", "truncated", "illegal")
PARTS = "part long, turns array<long>, roles array<string>, texts array<string>, keys array<binary>"


def damage(conversations: DataFrame) -> DataFrame:
    """The turns with faults planted by the crc32 of `conv_id:turn`; `copies` counts each row."""
    def text(column):
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(text("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text("text"), "[.!?]", ""))
        .otherwise(text("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


class Turns:
    """Turns of several conversations one after another, with their faults and their edits' costs.

    `owner` numbers each turn's conversation from 0; `seen` holds hashes of turns of earlier parts.
    """

    def __init__(self, owner, n, turns, roles, texts, seen=frozenset()):
        self.owner, self.n = np.asarray(owner, np.int64), n
        self.turns, self.roles, self.texts = turns, roles, texts
        self.code = np.array([INITIALS.get(r[:1], 3) for r in roles], np.int64)
        self.fault = np.zeros(len(roles), np.int64)
        known, at = set(), -1
        for k, (c, role, text) in enumerate(zip(self.owner.tolist(), roles, texts)):
            if c != at:
                known, at = set(), c
            body = text.rstrip(BLANKS)
            if not body:
                self.fault[k] = 1
            elif (role, text) in known or (seen and key(role, text) in seen):
                self.fault[k] = 2
            elif body[-1] not in ENDS:
                self.fault[k] = 3
            known.add((role, text))
        self.cut = CUT * (self.fault == 3)
        must_go = (self.fault == 1) | (self.fault == 2)
        to = KEEP[:, self.code].T
        self.keep_to = np.maximum(to, 0)
        self.keep = np.where(must_go[:, None] | (to < 0), FAR, self.cut[:, None])
        self.rerole = np.where(must_go, FAR, REROLE + self.cut)
        sizes = np.bincount(self.owner, minlength=n)
        self.first = np.cumsum(sizes) - sizes + np.arange(n)  # first place of each conversation
        self.last = self.first + sizes                        # its last place, after all its turns
        self.place = np.arange(len(roles)) + self.owner
        self.left = np.repeat(self.first + sizes, sizes) - self.place

    def counts(self):
        """Blank, duplicate, truncated and illegal turns of each conversation."""
        out = [np.bincount(self.owner[self.fault == f], minlength=self.n) for f in (1, 2, 3)]
        same = self.owner[1:] == self.owner[:-1]
        wrong = same & ~LEGAL[self.code[:-1], self.code[1:]]
        return np.stack([*out, np.bincount(self.owner[1:][wrong], minlength=self.n)], 1)

    def numbers(self, c):
        """(distinct, least, greatest) turn number of a conversation; nulls stand first."""
        mine = {t for t in self.turns[self.rows(c)] if t is not None}
        return (len(mine), min(mine), max(mine)) if mine else (0, None, None)

    def rows(self, c):
        return slice(int(self.first[c]) - c, int(self.last[c]) - c)

    def costs(self, end):
        """Least cost from every place and state; `end` is conversations x states x columns."""
        best = np.zeros((len(self.place) + self.n, 4, end.shape[2]), np.int64)
        best[self.last] = end
        order = np.argsort(self.left, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(self.left[order])) + 1):
            after = best[self.place[rows] + 1]
            kept = np.take_along_axis(after, self.keep_to[rows][:, :, None], 1)
            low = np.minimum(after + DELETE, kept + self.keep[rows][:, :, None])
            np.minimum(low, after[:, NEXT] + self.rerole[rows][:, None, None], out=low)
            u, a = low[:, 2].copy(), low[:, 3].copy()
            low[:, 2] = np.minimum(u, a + INSERT)
            low[:, 3] = np.minimum(a, u + INSERT)
            for q in (0, 1):
                low[:, q] = np.minimum(low[:, q], low[:, 2] + INSERT)
            best[self.place[rows]] = low
        return best

    def doubled(self, best):
        """Letter of each node's least audit, and pointers 1, 2, 4, ... edits ahead until all ended."""
        n = 4 * len(best)
        node = np.arange(n).reshape(-1, 4)
        letter, pointer = np.zeros(n, np.int64), np.arange(n)
        here, after = best[self.place], best[self.place + 1]
        q = np.arange(4)
        arcs = (  # in ASCII order of their letters
            (after + DELETE, node[self.place + 1]),
            (here[:, NEXT] + INSERT, node[self.place][:, NEXT]),
            (np.take_along_axis(after, self.keep_to, 1) + self.keep,
             4 * (self.place[:, None] + 1) + self.keep_to),
            (after[:, NEXT] + self.rerole[:, None], 4 * (self.place[:, None] + 1) + NEXT[q]))
        for k in reversed(range(4)):
            cost, target = arcs[k]
            cheapest = cost == here
            at = node[self.place][cheapest]
            letter[at], pointer[at] = k + 1, target[cheapest]
        rank, pointers, steps = letter, [pointer], (letter > 0).astype(np.int64)
        ended = letter == 0
        while not ended[pointer].all():
            steps = steps + steps[pointer]
            rank = np.unique(rank * n + rank[pointer], return_inverse=True)[1].reshape(-1)
            pointer = pointer[pointer]
            pointers.append(pointer)
        steps = steps + steps[pointer]
        return letter, pointers, steps

    def audits(self, ranked, start):
        """(audit, last state) of each conversation from its first place in state `start`."""
        letter, pointers, steps = ranked
        on = np.zeros(len(letter), bool)
        on[4 * self.first + start] = True
        for pointer in reversed(pointers):
            on[pointer[np.flatnonzero(on)]] = True
        nodes = np.flatnonzero(on)
        nodes = nodes[np.lexsort((-steps[nodes], nodes >> 2))]
        moves = nodes[letter[nodes] > 0]
        text = LETTERS[letter[moves] - 1].tobytes().decode()
        ends = np.searchsorted(moves >> 2, self.last)
        starts = np.searchsorted(moves >> 2, self.first)
        state = nodes[letter[nodes] == 0] & 3
        return [(text[a:b], int(s)) for a, b, s in zip(starts, ends, state)]

    def edits(self, c, audit, state):
        """(letter, role, text, cost) of each edit of a conversation."""
        k = self.rows(c).start
        for letter in audit:
            if letter == "I":
                state = int(NEXT[state])
                yield letter, ROLE[state], "", INSERT
                continue
            if letter == "D":
                yield letter, None, None, DELETE
            elif letter == "K":
                state = int(KEEP[state, self.code[k]])
                yield letter, self.roles[k], self.texts[k], int(self.cut[k])
            else:
                state = int(NEXT[state])
                yield letter, ROLE[state], self.texts[k], REROLE + int(self.cut[k])
            k += 1


def endings(state):
    """Edits that end a conversation."""
    for letter in END_AUDIT[state]:
        state = int(NEXT[state])
        yield letter, ROLE[state], "", INSERT


def key(role, text):
    return hashlib.sha256(f"{role}\0{text}".encode("utf-8", "surrogatepass")).digest()


class Digest:
    """One row per conversation."""

    SCHEMA = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
              "cost long, audit string, repaired_sha256 string")

    def __init__(self, conv_id):
        self.conv_id, self.cost, self.audit, self.hash = conv_id, 0, [], hashlib.sha256()
        self.kept = 0

    def take(self, edits):
        for letter, role, text, cost in edits:
            self.audit.append(letter)
            self.cost += cost
            if role is not None:
                line = f"{role}:{text}" if not self.kept else f"\n{role}:{text}"
                self.hash.update(line.encode("utf-8", "surrogatepass"))
                self.kept += 1
        return ()

    def end(self, gaps, counts):
        yield (self.conv_id, gaps, *counts, self.cost, "".join(self.audit), self.hash.hexdigest())


class Repaired:
    """One row per turn of the repaired conversations."""

    SCHEMA = "conv_id long, position long, role string, text string, edit string"

    def __init__(self, conv_id):
        self.conv_id, self.position = conv_id, 0

    def take(self, edits):
        for letter, role, text, _ in edits:
            if role is not None:
                yield self.conv_id, self.position, role, text, letter
                self.position += 1

    def end(self, gaps, counts):
        return ()


def gaps_of(distinct, least, greatest):
    return greatest - least + 1 - distinct if distinct else 0


TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def schema_of(text):
    """Arrow schema of a list of columns as it is given to Spark."""
    def kind(name):
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else TYPES[name]

    return pa.schema([(name, kind(of)) for name, of in (c.split() for c in text.split(", "))])


def batches_of(schema, rows, size=2048):
    """Arrow batches of row tuples; shorter tuples are filled up with nulls."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield one_batch(schema, held)
            held = []
    if held:
        yield one_batch(schema, held)


def one_batch(schema, rows):
    columns = list(zip(*[(*r, *(None,) * (len(schema) - len(r))) for r in rows]))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def finish_whole(sink, ids, block):
    """Result rows of conversations that lie inside a block."""
    best = block.costs(np.broadcast_to(END_COST[None, :, None], (block.n, 4, 1)))[:, :, 0]
    counts = block.counts().tolist()
    for c, (audit, state) in enumerate(block.audits(block.doubled(best), 0)):
        out = sink(ids[c])
        yield from out.take(block.edits(c, audit, 0))
        yield from out.take(endings(state))
        yield from out.end(gaps_of(*block.numbers(c)), counts[c])


def cut_blocks(turns: DataFrame, sink):
    """Result rows of conversations inside blocks, and the parts of all others, stored.

    A part's number grows along the order of turns: twice the block's number, plus 1 for the block's
    last conversation.
    """
    width = len(sink.SCHEMA.split(","))
    whole = schema_of(f"{sink.SCHEMA}, {PARTS}")

    def expand(table):
        copies = np.asarray(table["copies"].to_numpy(), np.int64)
        rows = table.take(pa.array(np.repeat(np.arange(table.num_rows), copies)))
        return [rows[c].to_pylist() for c in ("conv_id", "turn", "role", "text")]

    def answer(batches):
        for k, table in enumerate(sized(batches)):
            ids = table["conv_id"].to_pylist()
            change = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            edges = {0: 0, len(change) - 2: 1} if len(change) > 2 else {0: 0}
            for g, side in edges.items():
                conv, turn, role, text = expand(table.slice(change[g], change[g + 1] - change[g]))
                number = 2 * block_number(k) + side
                hashes = list({key(r, t) for r, t in zip(role, text)})
                yield (ids[change[g]], *(None,) * (width - 1), number, turn, role, text, hashes)
            if len(change) > 3:
                inner = table.slice(change[1], change[-2] - change[1])
                names = [ids[i] for i in change[1:-2]]
                owner = np.repeat(np.arange(len(names)), np.diff(change[1:-1]))
                owner = np.repeat(owner, np.asarray(inner["copies"].to_numpy(), np.int64))
                _, turn, role, text = expand(inner)
                yield from finish_whole(sink, names, Turns(owner, len(names), turn, role, text))

    def run(batches):
        yield from batches_of(whole, answer(batches))

    copies = F.col("copies").cast("int") if "copies" in turns.columns else F.lit(1)
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")}
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        text["role"].alias("role"), F.when(copies > 0, text["text"]).otherwise("").alias("text"),
        copies.alias("copies"), F.md5(F.concat(text["role"], F.lit("\n"), text["text"])).alias("_tie"),
        # Equal rows are interchangeable; their number only lets a range end between them.
        F.monotonically_increasing_id().alias("_at"))
    order = ["conv_id", "turn", "_tie", "_at"]
    cut = rows.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    return stored(cut.mapInArrow(run, f"{sink.SCHEMA}, {PARTS}"))


def part_turns(row):
    return Turns(np.zeros(len(row["roles"]), np.int64), 1, row["turns"], row["roles"], row["texts"],
                 frozenset(row["seen"] or ()))


def one_by_one(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def finish_parts(parts: DataFrame, sink) -> DataFrame:
    """Result rows of the conversations that were cut into parts."""
    def by_conversation(df, *order):
        return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)

    def matrices(batches):
        schema = schema_of("conv_id long, part long, matrix array<long>")
        unit = np.where(np.eye(4, dtype=bool), 0, FAR)[None]
        rows = ((r["conv_id"], r["part"], (m := part_turns(r)).costs(unit)[m.first[0]].ravel().tolist())
                for r in one_by_one(batches))
        yield from batches_of(schema, rows)

    def suffixes(batches):
        schema = schema_of("part long, ahead array<long>")

        def rows():
            current, cost = (), None
            for r in one_by_one(batches):
                if (r["conv_id"],) != current:
                    current, cost = (r["conv_id"],), END_COST
                yield r["part"], cost.tolist()
                cost = (np.array(r["matrix"]).reshape(4, 4) + cost[None, :]).min(1)

        yield from batches_of(schema, rows())

    ranked_schema = ("conv_id long, part long, turns array<long>, roles array<string>, texts array<string>, "
                     "seen array<binary>, audits array<string>, states array<int>")

    def ranked(batches):
        def rows():
            for r in one_by_one(batches):
                t = part_turns(r)
                paths = t.doubled(t.costs(np.array(r["ahead"])[None, :, None])[:, :, 0])
                found = [t.audits(paths, q)[0] for q in range(4)]
                audits, states = zip(*found)
                yield (r["conv_id"], r["part"], r["turns"], r["roles"], r["texts"], r["seen"],
                       list(audits), list(states))

        yield from batches_of(schema_of(ranked_schema), rows(), 1)

    def strung(batches):
        def rows():
            current, out = (), None
            for r in one_by_one(batches):
                if (r["conv_id"],) != current:
                    if out is not None:
                        yield from ended(out, state, numbers, counts)
                    current, out, state = (r["conv_id"],), sink(r["conv_id"]), 0
                    numbers, counts, last = (0, None, None), np.zeros(4, np.int64), None
                t = part_turns(r)
                yield from out.take(t.edits(0, r["audits"][state], state))
                state = r["states"][state]
                counts = counts + t.counts()[0]
                if len(t.code):
                    counts[3] += last is not None and not LEGAL[last, t.code[0]]
                    last = t.code[-1]
                numbers = added(numbers, t.numbers(0))
            if out is not None:
                yield from ended(out, state, numbers, counts)

        yield from batches_of(schema_of(sink.SCHEMA), rows())

    # A part's rows that an earlier part of the conversation holds as well.
    held = parts.select("conv_id", "part", F.explode("keys").alias("key"))
    before = F.min("part").over(Window.partitionBy("conv_id", "key"))
    seen = held.withColumn("_first", before).filter(F.col("part") > F.col("_first")).groupBy(
        F.col("part").alias("_part")).agg(F.collect_list("key").alias("seen"))
    parts = parts.drop("keys").join(seen, F.col("part") == F.col("_part"), "left").select(
        "conv_id", "part", "turns", "roles", "texts", "seen")
    parts = stored(parts)
    matrix = parts.mapInArrow(matrices, "conv_id long, part long, matrix array<long>")
    ahead = by_conversation(matrix, F.desc("part")).mapInArrow(suffixes, "part long, ahead array<long>")
    ahead = ahead.withColumnRenamed("part", "_part")
    paths = parts.join(ahead, F.col("part") == F.col("_part")).drop("_part")
    return by_conversation(paths.mapInArrow(ranked, ranked_schema), "part").mapInArrow(strung, sink.SCHEMA)


def added(numbers, more):
    """(distinct, least, greatest) of two runs of turn numbers, the second following the first."""
    if not numbers[0] or not more[0]:
        return numbers if numbers[0] else more
    return numbers[0] + more[0] - (numbers[2] == more[1]), numbers[1], more[2]


def ended(out, state, numbers, counts):
    yield from out.take(endings(state))
    yield from out.end(gaps_of(*numbers), counts.tolist())


def _repair(turns, sink):
    rows = cut_blocks(turns, sink)
    names = [c.split()[0] for c in sink.SCHEMA.split(", ")]
    whole = rows.filter(F.col("part").isNull()).select(*names)
    parts = rows.filter(F.col("part").isNotNull()).select("conv_id", "part", "turns", "roles", "texts", "keys")
    return whole.unionByName(finish_parts(parts, sink))


def repair(turns: DataFrame) -> DataFrame:
    """Faults, cost, audit and hash of the repaired turns of every conversation.

    `turns` has conv_id, turn, role, text, and may have `copies`: how often a row counts, 0 for a
    conversation's mere name.
    """
    return _repair(turns, Digest)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired turns themselves, with the edit each comes from."""
    return _repair(turns, Repaired)


_S = "\\x20\\x09-\\x0D"
_TABLE = """(SELECT list(v ORDER BY n) FROM (SELECT n, list_reduce(list_prepend(n, range(8)),
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) t(n)))"""


def _least(*ways):
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


def _way(state, cost, letter, line=None):
    """SQL of a state after one more edit."""
    text = "{0}.r".format(state) if line is None else f"list_append({state}.r, {line})"
    return (f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', "
            f"'r': {text}}} END")


def _turn(state, name):
    """Ways into a state by keeping or re-roling a turn."""
    initial = name[0]
    return [f"CASE WHEN ok AND initial = '{initial}' THEN {_way(state, 'cut', 'K', 'line')} END",
            f"CASE WHEN ok THEN {_way(state, '3 + cut', 'R', repr(name + ':') + ' || text')} END"]


SQL = f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda x: ascii(x)::BIGINT) AS name FROM conversations
), crc AS (SELECT {_TABLE} AS t
), marked AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, name),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM named, crc
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM marked, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, md5(role || chr(10) || text)) AS i FROM damaged
), judged AS (
  SELECT *, left(role, 1) AS initial, role || ':' || text AS line,
    CASE WHEN NOT regexp_matches(text, '[^{_S}]') THEN 1
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][{_S}]*$') THEN 3 ELSE 0 END AS fault,
    coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1)
      NOT IN ('su', 'ua', 'au'), false) AS wrong
  FROM placed
), turns AS MATERIALIZED (
  SELECT *, fault NOT IN (1, 2) AS ok, CASE fault WHEN 3 THEN 3 ELSE 0 END AS cut FROM judged
), counted AS (
  SELECT conv_id, count(*) AS n,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (wrong) AS illegal
  FROM turns GROUP BY conv_id
), open AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS q0,
    NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]) AS q1, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]) AS p2,
    NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]) AS p3
  FROM (SELECT DISTINCT conv_id FROM conversations)
), paths AS (
  SELECT * FROM open
  UNION ALL
  SELECT conv_id, i, q0, q1, p2, p3 FROM (
    SELECT f.conv_id, t.i,
      {_way('q0', 4, 'D')} AS q0,
      {_least(_way('q1', 4, 'D'), f"CASE WHEN ok AND initial = 's' THEN {_way('q0', 'cut', 'K', 'line')} END")} AS q1,
      {_least(_way('q2', 4, 'D'), *_turn('q0', 'user'), *_turn('q1', 'user'), *_turn('q3', 'user'))} AS p2,
      {_least(_way('q3', 4, 'D'), *_turn('q2', 'assistant'))} AS p3
    FROM (
      SELECT conv_id, i, q0, q1, q2, {_least('p3', _way('q2', 3, 'I', "'assistant:'"))} AS q3 FROM (
        SELECT conv_id, i, q0, q1, p3, {_least('p2', *[_way(q, 3, 'I', "'user:'") for q in ('q0', 'q1', 'p3')])}
          AS q2 FROM paths)
    ) f JOIN turns t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.i = f.i + 1)
), done AS (
  SELECT p.conv_id, n, gaps, blank, duplicate, truncated, illegal, q0, p3,
    {_least('p2', *[_way(q, 3, 'I', "'user:'") for q in ('q0', 'q1', 'p3')])} AS q2
  FROM paths p LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id
  WHERE p.i = coalesce(n, 0)
), best AS (
  SELECT *, {_least('q0', 'p3', _way('q2', 3, 'I', "'assistant:'"))} AS b FROM done
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.c AS cost, b.a AS audit,
  sha256(array_to_string(b.r, chr(10))) AS repaired_sha256
FROM best"""
