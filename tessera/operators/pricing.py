"""Competitor-driven prices, reconciliation with another system, and summaries of a rate over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranges import grouped_percentiles


def aggregate_by_rule(offers: DataFrame) -> DataFrame:
    """One row per sku: the aggregate named by its first row. Unknown names give null; ``rnk`` is the price of the least rank but -1."""
    chosen = F.min_by("agg", "row_no")
    ranked = F.expr("min_by(comp_price, struct(rank, row_no)) FILTER (WHERE rank <> -1)")
    picked = F.when(chosen == "avg", F.avg("comp_price")).when(chosen == "med", F.expr("percentile(comp_price, 0.5)")).when(chosen == "min", F.min("comp_price")).when(chosen == "max", F.max("comp_price")).when(chosen == "rnk", ranked)
    return offers.groupBy("sku").agg(picked.alias("agg_price"), F.min_by("base_price", "row_no").alias("base_price"))


def reprice(prices: DataFrame, limit: float = 0.2) -> DataFrame:
    """The aggregate where it is within ``limit`` of the base price, else the base price."""
    near = F.abs(F.try_divide(F.col("agg_price") - F.col("base_price"), F.col("base_price"))) <= limit
    return prices.withColumn("new_price", F.when(near, F.col("agg_price")).otherwise(F.col("base_price")))


def reconcile(ours: DataFrame, theirs: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of both systems whose values differ; two nulls are equal."""
    joined = ours.select(key, F.col(value).alias("ours")).join(theirs.select(key, F.col(value).alias("theirs")), key)
    return joined.where(~F.col("ours").eqNullSafe(F.col("theirs")))


def missing_from(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    return ours.join(theirs, key, "left_anti").select(key)


def pivot_mean(df: DataFrame, row: str, column: str, value: str, values: list[str]) -> DataFrame:
    """Means by row and column; the columns are stated, so no extra job looks for them."""
    return df.groupBy(row).pivot(column, values).agg(F.round(F.avg(value), 6))


def moving_mean(df: DataFrame, by: str, order: str, value: str, width: int = 3) -> DataFrame:
    """Mean of the last ``width`` rows of a group, null until there are as many."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(1 - width, 0)
    return df.withColumn("moving_avg", F.when(F.count(value).over(w) == width, F.round(F.avg(value).over(w), 6)))


def box_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges, and the number of outliers."""
    q = grouped_percentiles(df, by, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75}).withColumn("reach", 1.5 * (F.col("q3") - F.col("q1")))
    inside = F.col(value).between(F.col("q1") - F.col("reach"), F.col("q3") + F.col("reach"))
    out = df.join(q, by).groupBy(by, "q1", "q2", "q3").agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count_if(~inside).alias("outliers"))
    return out.select(by, *(F.round(c, 6).alias(c) for c in ("q1", "q2", "q3", "low", "high")), "outliers")


def histogram(df: DataFrame, by: str, value: str, bins: int = 10) -> DataFrame:
    """Counts in equal-width bins of each group's range; the maximum belongs to the last bin."""
    edges = df.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)) + 1, F.lit(bins))).otherwise(1)
    return df.join(edges, by).groupBy(by, place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
