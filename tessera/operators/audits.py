"""Leakage audits and data contracts: violations as rows, then roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crossing(df: DataFrame, kinds: list[str], split: str = "split") -> DataFrame:
    """Values of ``kinds`` that occur in more than one split, with the splits in order."""
    parts = [df.select(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value"), split) for k in kinds]
    long = reduce(DataFrame.unionByName, parts).where("value is not null").distinct()
    return long.groupBy("kind", "value").agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.count("*").alias("n_splits")).where("n_splits > 1")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def shared_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def violations(df: DataFrame, entity: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(entity_id, rule, detail) for every rule that a row breaks: one pass over the table, whatever the number of rules."""
    hits = F.filter(F.array(*(F.when(broken, F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail"))) for name, (broken, detail) in rules.items())), lambda x: x.isNotNull())
    return df.select(F.col(entity).cast("string").alias("entity_id"), F.explode(hits).alias("v")).select("entity_id", "v.rule", "v.detail")


def report(found: DataFrame, cap: int = 200) -> DataFrame:
    """Per rule: the exact number of violations and how many of them a capped list shows."""
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.least(F.count("*"), F.lit(cap)).alias("shown"))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(parents, children[child_key] == parents[parent_key], "left_anti")


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
