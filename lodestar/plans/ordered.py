"""Row numbers, running sums and neighbours within groups, where one group may hold a large part of all rows.

A window by group would sort each group in one task. Here rows are dealt out by ranges of the group and
the order, so a group lies in many partitions; each partition counts and adds up its own rows, and the
partitions' totals, a few numbers a partition and group, are put in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored


def _ranged(df: DataFrame, keys: list[str], order: list[Column]) -> tuple[DataFrame, Window]:
    """df in the order's ranges with the number of the partition, and the window of a group within a partition."""
    dealt = stored(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()))
    return dealt, Window.partitionBy("_part", *keys).orderBy(*order)


def running(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of its values up to and with the row, within the keys' group in the order.

    The order must tell all rows of a group apart. A value of 1 numbers the rows. Null values add nothing.
    """
    made = df.select("*", *(v.alias(f"_{n}") for n, v in values.items()))
    dealt, within = _ranged(made, keys, order)
    totals = dealt.groupBy("_part", *keys).agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in values))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *keys, *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}_before") for n in values))
    rows = Window.unboundedPreceding, Window.currentRow
    summed = dealt.select("*", *(F.coalesce(F.sum(f"_{n}").over(within.rowsBetween(*rows)), F.lit(0)).alias(n) for n in values))
    same = summed["_part"] == offsets["_part"]
    for k in keys:
        same = same & summed[k].eqNullSafe(offsets[k])
    joined = summed.join(offsets.select("_part", *(F.col(k) for k in keys), *(f"_{n}_before" for n in values)), same)
    return joined.select(*(summed[c] for c in df.columns), *((summed[n] + F.col(f"_{n}_before")).alias(n) for n in values))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with the number of the row in its group, from 1."""
    return running(df, keys, order, {name: F.lit(1).cast("bigint")})


def beside(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """df with `preceding` and `following`: value of the rows before and after in the group; null at its ends."""
    placed = stored(numbered(df, keys, order, "_place"))
    other = lambda step, name: placed.select(*(F.col(k).alias(f"_{k}") for k in keys), (F.col("_place") + step).alias("_at"), F.col(value).alias(name))
    out = placed
    for step, name in ((1, "preceding"), (-1, "following")):
        near = other(step, name)
        on = out["_place"] == near["_at"]
        for k in keys:
            on = on & out[k].eqNullSafe(near[f"_{k}"])
        out = out.join(near, on, "left").drop("_at", *(f"_{k}" for k in keys))
    return out.drop("_place")
