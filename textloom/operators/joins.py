"""Look-ups that stay balanced when a few keys hold most rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1000


def hottest(table: DataFrame, on: str, count: str, rows=HOT_ROWS) -> DataFrame:
    """The most frequent keys of a table that knows its keys' counts: at most `rows` rows."""
    return table.orderBy(F.desc(count), on).limit(rows).select(on)


def hottest_in(facts: DataFrame, on: str, rows=HOT_ROWS) -> DataFrame:
    """The keys with most rows in the facts: one partial count per key."""
    measure = "tf" if "tf" in facts.columns else "*"
    return hottest(facts.groupBy(on).agg(F.count(measure).alias("_n")), on, "_n", rows)


def hot_lookup(facts: DataFrame, table: DataFrame, on: str, values, hot: DataFrame, spread_by,
               how="inner") -> DataFrame:
    """Equi-join facts to a table with one row per key, with the hot keys taken out of the shuffle.

    `hot` names at most HOT_ROWS keys. Their rows of the table are broadcast (a fixed bound) and
    met map-side. Their facts then enter the shuffle under a hash of `spread_by` that matches
    nothing, so a key that holds a third of all facts is spread over every task. All other keys
    are joined as usual, by the join that Spark picks for their size; no row is dropped. `values`
    are the table's columns to add.
    """
    values, spread_by = list(values), list(spread_by)
    packed = F.struct(*values)
    table = table.filter(F.col(on).isNotNull())
    few = table.join(F.broadcast(hot), on, "left_semi").select(
        F.col(on).alias("_hot_key"), packed.alias("_hot"))
    met = facts.join(F.broadcast(few), F.col(on) == F.col("_hot_key"), "left")
    away = F.pmod(F.xxhash64(*spread_by), F.lit(2**40)) + 1
    salt = F.when(F.col("_hot_key").isNull(), F.lit(0).cast("long")).otherwise(away)
    # Key and salt are one struct: as two columns the constant salt would be folded away. Hot facts go by
    # the salt alone, so those of one document land in one task and its sums are added up before a shuffle.
    rare = F.when(F.col("_hot_key").isNull(), F.col(on))
    met = met.withColumn("_key", F.struct(rare.alias("k"), salt.alias("s")))
    rest = table.select(
        F.struct(F.col(on).alias("k"), F.lit(0).cast("long").alias("s")).alias("_rest_key"),
        packed.alias("_rest"))
    out = met.join(rest, F.col("_key") == F.col("_rest_key"), "left")
    out = out.withColumn("_found", F.coalesce("_hot", "_rest"))
    if how == "inner":
        out = out.filter(F.col("_found").isNotNull())
    return out.select(*facts.columns, *[F.col(f"_found.{v}").alias(v) for v in values])


def keep_top(table: DataFrame, count: str, tie: str, k: int) -> DataFrame:
    """The k rows of highest count, ties by `tie`.

    The counts' histogram gives the count that k rows reach, so only rows at or above it are
    sorted, instead of k rows from every task.
    """
    sizes = table.groupBy(count).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.orderBy(F.desc(count)))
    reached = sizes.withColumn("_upto", upto).filter(F.col("_upto") >= k)
    least = reached.agg(F.max(count)).scalar()
    kept = table.filter(F.col(count) >= F.coalesce(least, F.lit(0)))
    return kept.orderBy(F.desc(count), tie).limit(k)
