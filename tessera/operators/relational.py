"""Reports over clients, cards, transactions and loans."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranges import grouped_percentiles


def sum_by(df: DataFrame, key: str, value: str, out: str, ordered: bool = False) -> DataFrame:
    summed = df.groupBy(key).agg(F.sum(value).alias(out))
    return summed.orderBy(key) if ordered else summed


def since_year(df: DataFrame, date_col: str, year: int) -> DataFrame:
    """Filter by the expression itself, so it can be evaluated at the scan."""
    return df.where(F.year(date_col) >= year)


def not_in(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is known and none of ``values``; per row, not per id."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(values))


def many_active_cards(clients: DataFrame, cards: DataFrame, more_than: int, by: list[str]) -> DataFrame:
    """Clients with more than ``more_than`` active cards, grouped by ``by`` (names merge namesakes, ids don't)."""
    joined = clients.join(cards.where("active"), clients.id == cards.id_per)
    return joined.groupBy(*[clients[c] for c in by]).agg(F.count("id_cards").alias("n_cards")).where(F.col("n_cards") > more_than)


def full_years(birthdate: str, as_of: datetime.date) -> Column:
    """Completed years at a stated day."""
    return F.floor(F.months_between(F.lit(as_of), F.col(birthdate)) / 12).cast("int")


def active_in_age_band(clients: DataFrame, cards: DataFrame, txns: DataFrame, low: int, high: int, as_of: datetime.date, more_than: int) -> DataFrame:
    chosen = clients.withColumn("age", full_years("birthdate", as_of)).where(F.col("age").between(low, high))
    joined = chosen.join(cards, chosen.id == cards.id_per).join(txns, "id_cards")
    return joined.groupBy("id", "name").agg(F.count("amount").alias("n_operations")).where(F.col("n_operations") > more_than)


def monthly_median(txns: DataFrame) -> DataFrame:
    """Income of a month, and the interpolated median of its withdrawals (null without any)."""
    month = F.date_trunc("month", F.col("operation_date").cast("timestamp_ntz")).cast("date")
    rows = txns.withColumns({"month": month, "_out": F.when(F.col("operation") == -1, F.col("amount"))})
    income = rows.groupBy("month").agg(F.round(F.sum(F.when(F.col("operation") == 1, F.col("amount")).otherwise(0.0)), 2).alias("income"))
    medians = grouped_percentiles(rows, "month", "_out", {"_median": 0.5}).withColumnRenamed("month", "_month")
    return income.join(medians, F.col("month").eqNullSafe(F.col("_month")), "left").select("month", "income", F.round("_median", 4).alias("median_withdrawal"))


def spenders(clients: DataFrame, cards: DataFrame, txns: DataFrame, system: str, low: str, high: str, least: float) -> DataFrame:
    """Clients who spent over ``least`` by cards of a system, from ``low`` to midnight of ``high``."""
    spent = txns.where(F.col("operation_date").between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")) & (F.col("operation") == -1))
    joined = clients.join(cards.where(F.col("payment_system") == system), clients.id == cards.id_per).join(spent, "id_cards")
    return joined.groupBy("id", "name").agg(F.round(F.sum("amount"), 2).alias("spent")).where(F.col("spent") > least)
