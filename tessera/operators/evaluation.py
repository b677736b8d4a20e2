"""Scores against labels: confusion, areas, thresholds, pooled scores, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranges import percentiles, running_sums


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)


def confusion(df: DataFrame, threshold: float, label: str = "label", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Counts and rates at a threshold; a rate without cases is 0."""
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    counts = [F.count_if(c).alias(n) for n, c in (("tp", hit & pos), ("fp", hit & ~pos), ("fn", ~hit & pos), ("tn", ~hit & ~pos))]
    out = df.groupBy(*by).agg(*counts) if by else df.agg(*counts)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "fpr": _ratio(fp, fp + tn), "fp_per_million": _ratio(1e6 * fp, fp + tn), "alerts_per_10k": _ratio(1e4 * (tp + fp), tp + fp + fn + tn)})


def score_steps(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """For each distinct score, from the highest: rows and positives at it, and cumulative tp and fp. Sums of groups, so ties cost nothing."""
    steps = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    return running_sums(steps, -F.col("s"), [], {"tp": F.col("p"), "fp": F.col("n")})


def areas(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """ROC area with average ranks for ties, and average precision; null unless both classes occur."""
    s = score_steps(df, label, score)
    n1, n0 = F.sum("p"), F.sum("n")
    both = (n1 > 0) & (n0 > 0)
    auc = F.sum(F.col("n") * (F.col("tp") - F.col("p") + F.col("tp"))) / (2.0 * n1 * n0)
    ap = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / n1
    return s.agg(F.when(both, F.round(auc, 6)).alias("roc_auc"), F.when(both, F.round(ap, 6)).alias("pr_auc"))


def threshold_for_recall(df: DataFrame, recall: float, label: str = "label", score: str = "score") -> DataFrame:
    """The score with the best precision whose recall is enough, ties to the larger; 0.5 with one class."""
    s = score_steps(df, label, score)
    total = s.agg(F.sum("p").alias("n1"), F.sum("n").alias("n0"))
    ok = s.join(F.broadcast(total)).where((F.col("n1") > 0) & (F.col("n0") > 0) & (F.col("tp") >= recall * F.col("n1")))
    best = ok.agg(F.max(F.struct((F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.col("s").alias("t"))).alias("b"))
    return best.select(F.coalesce("b.t", F.lit(0.5)).alias("threshold"), F.round("b.precision", 6).alias("precision"))


def score_summary(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Count, least, median, interpolated p95 and the share below a threshold."""
    rest = df.agg(F.count("*").alias("n"), F.min(score).alias("min"), F.round(F.avg((F.col(score) < threshold).cast("double")), 6).alias("share_below"))
    return rest.join(F.broadcast(percentiles(df, score, {"median": 0.5, "p95": 0.95}))).select("n", "min", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), "share_below")


def pair_delta(df: DataFrame, pair: str, on: Column, order: str, score: str = "score") -> DataFrame:
    """Mean absolute difference of the two sides of a pair (last score of a side); 999 without a whole pair."""
    sides = df.groupBy(pair).agg(F.max_by(score, F.when(on, F.col(order))).alias("a"), F.max_by(score, F.when(~on, F.col(order))).alias("b"))
    sides = sides.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return sides.agg(F.count("*").alias("pairs"), F.round(F.coalesce(F.avg(F.abs(F.col("a") - F.col("b"))), F.lit(999.0)), 6).alias("delta"))


def pooled(df: DataFrame, by: str, score: str = "score") -> DataFrame:
    return df.groupBy(by).agg(F.round(F.avg(score), 6).alias("mean_score"), F.max(score).alias("max_score"))


def acceptance(metrics: DataFrame, precision: float = 0.95, recall: float = 0.95, fpr: float = 5e-5) -> DataFrame:
    """Does each group with positives reach all three? A missing false-positive rate counts as 1, no rows as failed."""
    ok = (F.col("precision") >= precision) & (F.col("recall") >= recall) & (F.coalesce("fpr", F.lit(1.0)) <= fpr)
    with_positives = metrics.where("tp + fn > 0")
    return with_positives.agg(F.count("*").alias("groups"), F.count_if(ok).alias("passed"), F.coalesce(F.every(ok), F.lit(False)).alias("accepted"))
