"""Running sums over a whole table without one task that sees all of it: ranges of a number, summed on their own, then offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, key: Column, order: list, sums: dict[str, Column], parts: int = 64) -> DataFrame:
    """``df`` with sums up to and including each row in ascending order of ``key``, then ``order``.

    At most ``parts`` ranges are cut at approximate quantiles of the key; the totals of the ranges are the only rows
    that meet in one task. Rows with a null key come first.
    """
    keyed = df.withColumn("_k", key.cast("double"))
    bounds = sorted(set(keyed.approxQuantile("_k", [n / parts for n in range(1, parts)], 0.25 / parts)))
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("_k"))) if bounds else F.lit(0)
    keyed = keyed.withColumn("_range", F.when(F.col("_k").isNull(), -1).otherwise(place))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy("_range").agg(*(F.sum(e).alias(f"_t_{n}") for n, e in sums.items()))
    offsets = totals.select("_range", *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums))
    own = Window.partitionBy("_range").orderBy("_k", *order).rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.join(F.broadcast(offsets), "_range").withColumns({n: F.sum(e).over(own) + F.col(f"_o_{n}") for n, e in sums.items()})
    return out.drop("_k", "_range", *(f"_o_{n}" for n in sums))


def percentiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: the exact interpolated percentiles of a column's values, nulls left out; null without values.

    Counts of distinct values and their running sums, so no task holds the values of the table.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    held = running_sums(counts, F.col("v"), ["v"], {"upto": F.col("n")}).join(F.broadcast(total))

    low = {n: F.min(F.when(F.col("upto") > F.floor(share * (F.col("all") - 1)), F.col("v"))) for n, share in shares.items()}
    high = {n: F.min(F.when(F.col("upto") > F.ceil(share * (F.col("all") - 1)), F.col("v"))) for n, share in shares.items()}
    part = {n: share * (F.max("all") - 1) - F.floor(share * (F.max("all") - 1)) for n, share in shares.items()}
    return held.agg(*((low[n] + (high[n] - low[n]) * part[n]).alias(n) for n in shares))


def grouped_percentiles(df: DataFrame, by: str, column: str, shares: dict[str, float], parts: int = 64) -> DataFrame:
    """(by, one column per share): exact interpolated percentiles of each group's values, nulls left out; groups without values are absent.

    Selection by counts: distinct values are counted, values are cut into at most ``parts`` ranges, and a range that holds a
    wanted rank is the only one whose values are put in order. What meets in one task is a range of a group's distinct
    values, or one count per range of a group; no buffer holds the values of a group. Null is a group of its own.
    """
    key, value = F.to_json(F.struct(F.col(by))), F.col(column).cast("double")
    held = df.where(F.col(column).isNotNull()).select(key.alias("_g"), F.col(by).alias("_by"), value.alias("v"))
    bounds = sorted(set(held.approxQuantile("v", [n / parts for n in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("v"))) if bounds else F.lit(0)
    counts = held.groupBy("_g", "v").agg(F.count("*").alias("n"), F.first("_by").alias("_by")).withColumn("_range", place)
    group = Window.partitionBy("_g")
    ranges = counts.groupBy("_g", "_range").agg(F.sum("n").alias("m")).select("_g", "_range", (F.sum("m").over(group.orderBy("_range")) - F.col("m")).alias("before"), "m", F.sum("m").over(group).alias("all"))
    rank = lambda share, whole: whole(share * (F.col("all") - 1)).cast("long")
    wanted = [rank(s, w) for s in shares.values() for w in (F.floor, F.ceil)]
    has = F.lit(False)
    for r in wanted:
        has = has | ((r >= F.col("before")) & (r < F.col("before") + F.col("m")))
    own = Window.partitionBy("_g", "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.join(ranges.where(has), ["_g", "_range"]).withColumn("upto", F.col("before") + F.sum("n").over(own))
    at = lambda r: F.min(F.when((F.col("upto") > r) & (F.col("before") <= r), F.col("v")))
    found = {}
    for name, share in shares.items():
        low, high = at(rank(share, F.floor)), at(rank(share, F.ceil))
        found[name] = low + (high - low) * (share * (F.max("all") - 1) - F.floor(share * (F.max("all") - 1)))
    return placed.groupBy("_g").agg(F.first("_by").alias(by), *(e.alias(n) for n, e in found.items())).drop("_g")
