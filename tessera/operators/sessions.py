"""Transactions, fields and sequences of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranges import running_sums


def _z(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def aggregate_all(df: DataFrame, by: list[str], columns: list[str], kinds: dict) -> DataFrame:
    """Every aggregate of ``kinds`` (name: function) over every column; names are column_kind."""
    return df.groupBy(*by).agg(*(F.round(f(c), 6).alias(f"{c}_{k}") for c in columns for k, f in kinds.items()))


def entropy(df: DataFrame, by: str, value: str) -> DataFrame:
    """Entropy of a category per group, in bits."""
    n = df.groupBy(by, value).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(by))
    return n.withColumn("p", p).groupBy(by).agg(F.round(F.sum(-F.col("p") * F.log2("p")), 6).alias("entropy"))


def lag_correlation(df: DataFrame, by: str, order: list[str], value: str, lag: int) -> DataFrame:
    """Correlation with the row ``lag`` before; 0 for fewer than 3 pairs or a constant side."""
    before = F.lag(value, lag).over(Window.partitionBy(by).orderBy(*order))
    pairs = df.withColumn("_b", before)
    both = F.col("_b").isNotNull()
    x, y = F.when(both, F.col(value)), F.col("_b")
    raw = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return pairs.groupBy(by).agg(F.round(F.when(F.count(y) >= 3, _z(raw)).otherwise(0.0), 4).alias(f"lag{lag}"))


def temporal_full(df: DataFrame, by: str, order: list[str], time_us: str, categories: list[str], size: str) -> DataFrame:
    """18 columns per group: count, duration, gaps (mean, population deviation, cv, interpolated p95), burst and silence shares
    against the median gap, entropies and change rates of categories, correlations of size and gap with one and two rows before.

    All windows are over the group, so the rows move once.
    """
    whole = Window.partitionBy(by)
    w = whole.orderBy(*order)
    rows = df.withColumns({"_gap": (F.col(time_us) - F.lag(time_us).over(w)) / 1e6, "_size": F.col(size).cast("double")})
    rows = rows.withColumns({f"_c_{c}": (F.col(c) != F.lag(c).over(w)).cast("double") for c in categories})
    rows = rows.withColumns({f"{x}{n}": F.lag(x, n).over(w) for x in ("_size", "_gap") for n in (1, 2)})
    rows = rows.withColumns({"_median": F.percentile("_gap", F.lit(0.5)).over(whole), **{f"_e_{c}": -F.log2(F.count("*").over(Window.partitionBy(by, c)) / F.count("*").over(whole)) for c in categories}})

    def corr(x: str, y: str) -> Column:
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
        constant = (F.round(F.stddev_pop(a), 9) == 0) | (F.round(F.stddev_pop(b), 9) == 0)
        return F.when((F.count(a) >= 3) & ~constant, F.round(F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)), 4)).otherwise(0.0)

    known = F.col("_gap").isNotNull()
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.round((F.max(time_us) - F.min(time_us)) / 1e6, 4).alias("duration"), F.round(_z(F.avg("_gap")), 4).alias("gap_mean"), F.round(_z(F.stddev_pop("_gap")), 4).alias("gap_std"),
        F.round(_z(F.try_divide(F.stddev_pop("_gap"), F.avg("_gap"))), 4).alias("gap_cv"), F.round(_z(F.percentile("_gap", F.lit(0.95))), 4).alias("gap_p95"),
        F.round(_z(F.avg(F.when(known, (F.col("_gap") <= F.col("_median") / 2).cast("double")))), 6).alias("burst_share"), F.round(_z(F.avg(F.when(known, (F.col("_gap") >= F.col("_median") * 2).cast("double")))), 6).alias("silence_share"),
        *(F.round(F.avg(f"_e_{c}"), 6).alias(f"{c}_entropy") for c in categories), *(F.round(_z(F.avg(f"_c_{c}")), 6).alias(f"{c}_change") for c in categories),
        *(corr(f"_{x}", f"_{x}{n}").alias(f"{x}_lag{n}") for x in ("size", "gap") for n in (1, 2)),
    )


def row_numbers(df: DataFrame, number: str) -> DataFrame:
    """``df`` with ``place``, from 1 in ascending order of ``number``, over the whole table."""
    return running_sums(df, F.col(number), [number], {"place": F.lit(1)})


def numeric_matrix(df: DataFrame, identity: list[str], forbidden: list[str]) -> DataFrame:
    """Numeric and boolean columns in name order, infinities as null, each with a ``__missing`` flag, nulls as 0."""
    chosen = sorted(c for c, t in df.dtypes if c not in {*identity, *forbidden} and (t in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or t.startswith("decimal")))
    finite = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    columns = {c: F.coalesce(finite(c), F.lit(0.0)) for c in chosen} | {f"{c}__missing": finite(c).isNull().cast("int") for c in chosen}
    out = df.select(*identity, *(columns[c].alias(c) for c in sorted(columns)))
    assert not set(forbidden) & set(out.columns)
    return out


def replay_matrix(df: DataFrame, identity: list[str], forbidden: list[str], columns: list[str]) -> DataFrame:
    """The matrix of ``columns``, as a model was trained with them: an absent value is 0 and the flag of an absent column 1. A forbidden name is an error."""
    if leaked := sorted(set(columns) & set(forbidden)):
        raise ValueError(f"forbidden columns in a model's matrix: {leaked}")
    have = numeric_matrix(df, identity, forbidden)
    default = lambda n: F.lit(1) if n.endswith("__missing") else F.lit(0.0)
    return have.select(*identity, *((F.col(n) if n in have.columns else default(n)).alias(n) for n in columns))


def by_prefix(df: DataFrame, prefixes: tuple[str, ...], required: list[str]) -> DataFrame:
    return df.select(*required, *(c for c in df.columns if c.startswith(prefixes) and c not in required))


def visible_only(rows: DataFrame, sessions: DataFrame, key: str, visible: Column) -> DataFrame:
    """Content rows of visible sessions only."""
    return rows.join(sessions.where(visible).select(key), key, "left_semi")


def sequences(df: DataFrame, by: str, order: str, channels: dict[str, Column], steps: int = 96) -> DataFrame:
    """Per session an array of ``steps`` steps of the channels (zeros behind the end) and a mask; long sessions keep head and tail."""
    from tessera.operators.intervals import head_and_tail

    rows = head_and_tail(df, by, order, steps).select(by, F.col("place"), F.array(*(c.cast("double") for c in channels.values())).alias("x"))
    held = rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("seq"))
    blank = F.array_repeat(F.array(*(F.lit(0.0) for _ in channels)), steps)
    padded = F.slice(F.concat("seq", blank), 1, steps)
    mask = F.slice(F.concat(F.transform("seq", lambda x: F.lit(1)), F.array_repeat(F.lit(0), steps)), 1, steps)
    return held.select(by, padded.alias("seq"), mask.alias("mask"))
