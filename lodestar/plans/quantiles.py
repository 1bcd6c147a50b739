"""Exact percentiles of groups that no task could hold.

A sketch of bounded size cuts a group's values into about a thousand pieces; the pieces are counted, and only the
piece that holds a wanted rank is looked at. While that has more than VALUES distinct values, it is cut again.
Counts are added up before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

#: Distinct values of a piece that one task orders.
VALUES = 100_000
#: Pieces, and the sketch's accuracy: a cut's rank is off by at most a 5,000th of the values.
PIECES, ACCURACY = 1000, 5000
#: Groups up to which what is known of them is broadcast (a group's cuts take 8 KB); salts of a larger join.
FEW_GROUPS, SALTS = 1000, 16


def percentiles(df: DataFrame, keys: list[str], value: Column, wanted: dict[str, float]) -> DataFrame:
    """keys and, for each name of wanted, the percentile of the group's values, between two ranks by their distance.

    As percentile(), or quantile_cont in other engines. Nulls do not count; a group of nulls alone has nulls, and
    null keys make a group. Without keys there is one row, of nulls if there are no values.
    """
    names = [f"k{i}_" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), value.cast("double").alias("v"))
    groups = stored(rows.groupBy(*names).agg(F.count("v").alias("n")))
    size = groups.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("most")).first()
    few = size["groups"] <= FEW_GROUPS
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("p"), F.lit(float(p)).alias("at")) for i, p in enumerate(wanted.values())))).alias("w")
    goals = groups.where("n > 0").select("*", each).select(*names, "w.p", ((F.col("n") - 1) * F.col("w.at")).alias("goal"), F.lit(0).cast("bigint").alias("below"))
    rows = rows.where("v is not null").withColumn("n", F.lit(1).cast("bigint"))
    if (size["most"] or 0) <= VALUES:  # every group is a piece
        held = goals.withColumn("low", F.lit(float("-inf"))).withColumn("high", F.lit(float("inf")))
        rows = rows.groupBy(*names, "v").agg(F.sum("n").alias("n"))
        out = _between(_meet(rows, held, names, few).select(*names, F.col("_p").alias("p"), F.col("_goal").alias("goal"), F.col("_below").alias("below"), "v", "n"), [*names, "p"])
        return _beside(groups, out, keys, names, wanted)
    held = stored(_narrowed(rows, names, goals, names, few))
    found, by = None, [*names, "p"]
    while True:
        inside = F.col("v").between(F.col("_low"), F.col("_high"))
        counted = _meet(rows, held, names if found is None else by, few).where(inside)
        if found is None:
            counted = counted.withColumn("p", F.col("_p"))
        counted = stored(counted.groupBy(*by, F.col("_goal").alias("goal"), F.col("_below").alias("below"), "v").agg(F.sum("n").alias("n")))
        sizes = stored(counted.groupBy(*by).agg((F.count(F.lit(1)) > VALUES).alias("many")))
        placed = _meet(counted, sizes, by, few)
        done = _between(placed.where("not _many").select(*counted.columns), by)
        found = done if found is None else found.unionByName(done)
        if sizes.where("many").isEmpty():
            break
        rows = stored(placed.where("_many").select(*by, "v", "n"))
        again = held.select(*by, "goal", "below").join(sizes.where("many").select(*(F.col(c).alias(f"_{c}") for c in by)), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left_semi")
        held = stored(_narrowed(rows, by, again, by, few))
    return _beside(groups, stored(found), keys, names, wanted)


def _beside(groups: DataFrame, found: DataFrame, keys: list[str], names: list[str], wanted: dict[str, float]) -> DataFrame:
    """One row a group, with a column for each percentile."""
    wide = found.groupBy(*(F.col(n).alias(f"_{n}") for n in names)).agg(*(F.max(F.when(F.col("p") == i, F.col("value"))).alias(name) for i, name in enumerate(wanted)))
    out = groups.join(wide, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names] or F.lit(True), "left")
    return out.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), *wanted)


def _meet(rows: DataFrame, small: DataFrame, on: list[str], few: bool) -> DataFrame:
    """rows with what small says of their group, its columns with _ before them; groups in which very many rows lie are salted."""
    small = small.select(*(F.col(c).alias(f"_{c}") for c in small.columns))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    if few:
        return rows.join(F.broadcast(small), same or F.lit(True))
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(small, [*same, F.col("salt") == F.col("_salt")]).drop("salt", "_salt")


def _narrowed(rows: DataFrame, by: list[str], goals: DataFrame, on: list[str], few: bool) -> DataFrame:
    """goals with the piece (low, high) that holds their rank, and what lies below it, of rows (by, v, n)."""
    cuts = stored(rows.groupBy(*by).agg(F.percentile_approx("v", F.array(*(F.lit(i / PIECES) for i in range(PIECES + 1))), ACCURACY).alias("cuts")))
    # a value's piece: how many cuts it reaches
    piece = F.size(F.filter("_cuts", lambda c: c <= F.col("v")))
    pieces = _meet(rows, cuts, by, few).groupBy(*by, piece.alias("piece")).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = pieces.withColumn("upto", upto)
    own = goals.select(*(F.col(c).alias(f"_{c}") for c in goals.columns))
    met = placed.join(own, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on] or F.lit(True))
    # both neighbours of a rank that lies between two values must be in
    end = F.col("_below") + F.col("upto")
    held = met.where((end > F.floor("_goal")) & (end - F.col("n") <= F.ceil("_goal")))
    names = [c for c in goals.columns if c not in ("goal", "below")]
    return held.groupBy(*(F.col(f"_{c}").alias(c) for c in names), F.col("_goal").alias("goal")).agg(F.min(end - F.col("n")).alias("below"), F.min("low").alias("low"), F.max("high").alias("high"))


def _between(counted: DataFrame, by: list[str]) -> DataFrame:
    """(by, value) of pieces whose distinct values one task orders."""
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counted.withColumn("upto", F.col("below") + upto)
    first = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    ends = placed.groupBy(*by, "goal").agg(first(F.floor("goal")).alias("a"), first(F.ceil("goal")).alias("b"))
    share = F.col("goal") - F.floor("goal")
    return ends.select(*by, F.when(share == 0, F.col("a")).otherwise((1 - share) * F.col("a") + share * F.col("b")).alias("value"))
