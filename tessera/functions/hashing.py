"""Deterministic buckets, roles and splits by hash, the same on every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_number(value: Column) -> Column:
    """The first 32 bits of SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 8), 16, 10).cast("long")


def hash_split(value: Column, percent: int = 85) -> Column:
    return F.when(hash_number(value) % 100 < percent, "train").otherwise("validation")


def four_way_role(value: Column, roles: list[str], salt: str = "v3-validation:") -> Column:
    return F.element_at(F.array(*map(F.lit, roles)), (hash_number(F.concat(F.lit(salt), value)) % len(roles) + 1).cast("int"))


def first_match(rules: list[tuple[Column, Column | str]], otherwise: Column) -> Column:
    """The value of the first rule that holds: one parameterised list instead of layers of overrides."""
    out = None
    for rule, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(rule, value) if out is None else out.when(rule, value)
    return otherwise if out is None else out.otherwise(otherwise)


def alternate(df: DataFrame, label: str, key: str, salt: str = "calibration:") -> DataFrame:
    """Within each label, in hash order: even places calibrate, odd ones tune."""
    order = Window.partitionBy(label).orderBy(F.sha2(F.concat(F.lit(salt), F.col(key)), 256), key)
    return df.withColumn("part", F.when(F.row_number().over(order) % 2 == 1, "calibration").otherwise("tuning"))


def shard(df: DataFrame, number: str, shards: int, which: int) -> DataFrame:
    return df.where(F.pmod(F.col(number), F.lit(shards)) == which)
