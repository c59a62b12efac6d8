"""Running totals and ranks that no single task has to sort alone.

A window over one hot group, or over the whole table, would sort all of its rows in one task.
Here rows are first cut into ordered parts; a part holds one slice of a group. Totals run inside
each part, and each part adds what the group's earlier parts hold. The parts' totals are small:
one row per group and part.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import checkpoint


def running_totals(df: DataFrame, by, order, values: dict, totals=None, part=None) -> DataFrame:
    """Add, per entry of `values`, the running sum of that column per group in the given order.

    `part` may be a column that grows with the order (such as the leading digits of a hash);
    without one, rows are range-partitioned and kept in reliable storage, because the sampled
    ranges must be the same for both uses below. `totals` maps entries of `values` to columns that
    get the group's whole sum.
    """
    by, order, totals = list(by), list(order), totals or {}
    if part is None:
        cut = df.repartitionByRange(*[F.col(c) for c in by], *order)
        cut = checkpoint(cut.withColumn("_part", F.spark_partition_id()))
    else:
        cut = df.withColumn("_part", part)
    names = list(values)
    cut = cut.withColumns({f"_v_{n}": values[n] for n in names})
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    local = cut.withColumns({f"_run_{n}": F.sum(f"_v_{n}").over(inside) for n in names})
    sizes = cut.groupBy(F.col("_part").alias("_of_part"), *[F.col(c).alias(f"_by_{c}") for c in by])
    sizes = sizes.agg(*[F.sum(f"_v_{n}").alias(f"_size_{n}") for n in names])
    group = Window.partitionBy(*[f"_by_{c}" for c in by])
    earlier = group.orderBy("_of_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        "_of_part",
        *[f"_by_{c}" for c in by],
        *[F.coalesce(F.sum(f"_size_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}")
          for n in names],
        *[F.sum(f"_size_{n}").over(group).alias(f"_total_{n}") for n in names],
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by],
        F.col("_part") == F.col("_of_part"),
    )
    joined = local.join(sizes, same)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_run_{n}") + F.col(f"_before_{n}")).alias(n) for n in names],
        *[F.col(f"_total_{n}").alias(out) for n, out in totals.items()],
    )


def ranked(df: DataFrame, by, order, name="rank", total=None, part=None) -> DataFrame:
    """Row number from 1 per group; `total` adds the group's row count."""
    totals = {name: total} if total else None
    return running_totals(df, by, order, {name: F.lit(1).cast("long")}, totals, part)


def shuffle_key(*ids, seed=""):
    """Portable pseudo-random key of a row: the md5 of its id and a seed."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))


def shuffled_rank(df, by, ids, name="rank", total=None, seed="") -> DataFrame:
    """Rank rows of each group in pseudo-random order; the key's first digits cut the parts."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    keyed = df.withColumn("_key", shuffle_key(*ids, seed=seed))
    order = [F.col("_key"), *[F.col(c) for c in ids]]
    out = ranked(keyed, by, order, name, total, part=F.substring("_key", 1, 3))
    return out.drop("_key")


def uniform(*ids, seed=""):
    """Repeatable number in [0, 1) for a row, from the first 32 bits of its key."""
    head = F.substring(shuffle_key(*ids, seed=seed), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)
