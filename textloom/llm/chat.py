"""Chat formatting with a grammar that is read back and compared.

A conversation becomes `<s>[TAG] text</s>` turns in order. The text after `<s>[TAG]!` is escaped:
`\\` is written `\\b` and `<` is written `\\l`, so it holds no control string. A deterministic parser
(split at `</s>`, one pattern per turn) reads the rendered string back. A conversation is first
rendered verbatim; when the turns that come back differ from the source, the turns that hold control
strings are escaped, and then all turns, until they are the same. Should even that differ, the
query fails. All of it is column functions.

Turns are ordered by turn number, then role and text; repeated rows are turns of their own. A null
text or role counts as empty, null turn numbers come first, and null conversation ids form one
conversation. An empty table gives no rows; other columns are ignored. One conversation is one
string by contract, so a conversation's turns meet in one row.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
TAGS = {"user": "INST", "system": "SYS", "assistant": "OUT"}
OTHER = "ROLE:"
TURN = r"(?s)^<s>\[([^\]]*)\]([ !])(.*)$"


def escape(x):
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(x):
    return F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def tag(role):
    named = F.concat(F.lit(OTHER), F.replace(escape(role), F.lit("]"), F.lit("\\r")))
    for known, short in TAGS.items():
        named = F.when(role == known, F.lit(short)).otherwise(named)
    return named


def role_of(name):
    rest = F.replace(F.substr(name, F.lit(len(OTHER) + 1)), F.lit("\\r"), F.lit("]"))
    role = unescape(rest)
    for known, short in TAGS.items():
        role = F.when(name == short, F.lit(known)).otherwise(role)
    return role


def conflicts(text):
    return F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE))


def render(turns, escaped):
    """One string of all turns; `escaped` says of a turn's text whether to escape it."""
    def turn(t):
        marked = escaped(t["text"])
        content = F.when(marked, escape(t["text"])).otherwise(t["text"])
        return F.concat(F.lit(OPEN + "["), tag(t["role"]), F.lit("]"),
                        F.when(marked, F.lit("!")).otherwise(F.lit(" ")), content, F.lit(CLOSE))

    return F.array_join(F.transform(turns, turn), "")


def parse(rendered):
    """Turns (role, text) of a rendered conversation; a malformed turn comes back as null."""
    pieces = F.split(rendered, CLOSE, -1)

    def turn(piece):
        content = F.regexp_extract(piece, TURN, 3)
        raw = F.regexp_extract(piece, TURN, 2) == " "
        well = F.rlike(piece, F.lit(TURN)) & ~(raw & F.contains(content, F.lit(OPEN)))
        return F.when(well, F.struct(
            role_of(F.regexp_extract(piece, TURN, 1)).alias("role"),
            F.when(raw, content).otherwise(unescape(content)).alias("text")))

    ended = F.element_at(pieces, -1) == ""
    return F.when(ended, F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, `formatted` and the `turns` (role, text) that were read back from it."""
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.select("conv_id", F.struct("turn", *blank).alias("t"))
    one = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    one = one.select("conv_id", F.transform("t", lambda t: F.struct(
        t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    steps = [lambda x: F.lit(False), conflicts, lambda x: F.lit(True)]
    failed = F.raise_error(F.concat(F.lit("no round trip for conversation "),
                                    F.col("conv_id").cast("string"))).cast("string")
    choice = failed
    for how in reversed(steps):
        tried = render(F.col("source"), how)
        choice = F.when(parse(tried).eqNullSafe(F.col("source")), tried).otherwise(choice)
    out = one.withColumn("formatted", choice)
    return out.select("conv_id", F.size("source").cast("long").alias("n_turns"), "formatted",
                      parse(F.col("formatted")).alias("turns"))


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table's turns and conversation -1, whose texts are made of control strings."""
    text = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user", text), (-1, 1, "assistant", text)],
        "conv_id long, turn long, role string, text string")
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"),
        F.col("text").cast("string")).unionByName(probe)


def digest(formatted: DataFrame) -> DataFrame:
    lines = F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"),
                                       lambda t: t["text"]), "")
    return formatted.select(
        "conv_id", "n_turns", F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


_ESCAPED = "replace(replace({0}, '\\', '\\b'), '<', '\\l')"
SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *,
    CASE role WHEN 'user' THEN 4 WHEN 'system' THEN 3 WHEN 'assistant' THEN 3
      ELSE 5 + length(replace({_ESCAPED.format('role')}, ']', '\\r')) END
    + CASE WHEN contains(text, '<s>') OR contains(text, '</s>')
      THEN length({_ESCAPED.format('text')}) ELSE length(text) END + 10 AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
    AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
    FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""
