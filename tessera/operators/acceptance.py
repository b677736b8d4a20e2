"""Promotion of a model: metric cells against limits, nine points of evidence against what they require, and the roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of a cell, and the facts that each point of evidence requires, as (source, fact).
PRECISION, RECALL, FALSE_POSITIVES = 0.95, 0.95, 50 / 1_000_000
REQUIRED = {
    "external_framework_holdout": [("registry", "framework_validated"), ("registry", "all_frameworks"), ("metrics", "framework_cells")],
    "benign_corpus": [("readiness", "benign_ready"), ("readiness", "benign_multi_event_ready")],
    "client_server_diversity": [("registry", "clients"), ("registry", "servers"), ("registry", "networks")],
    "network_domain_randomization": [("readiness", "netem_ready"), ("registry", "clients"), ("registry", "servers"), ("registry", "networks")],
    "long_term_timing": [("readiness", "long_timing_ready"), ("readiness", "long_timing_multi_event_ready"), ("registry", "external_long_timing")],
    "wire_real_ech": [("registry", "ech_validated"), ("metrics", "ech_suspicious"), ("metrics", "ech_benign"), ("metrics", "ech_pair_delta")],
    "unseen_evaluation": [("metrics", "leave_one_family_out"), ("metrics", "compositional_holdout")],
    "sequence_expert": [("models", "opaque_sequence")],
    "visibility_fusion": [("models", "fusion"), ("models", "no_plaintext_when_opaque")],
}


def required(spark: SparkSession) -> DataFrame:
    """(point, source, fact): the truth table above."""
    return spark.createDataFrame([(p, *x) for p, facts in REQUIRED.items() for x in facts], "point string, source string, fact string")


def false_positive_rate() -> Column:
    """Of a cell with ``fpr``, ``fp`` and ``tn``: as given, else from the confusion matrix, else 1."""
    counted = F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1))
    return F.coalesce(F.col("fpr"), counted, F.lit(1.0)).cast("double")


def cell_passes(precision: float | None = PRECISION, recall: float = RECALL, fpr: float = FALSE_POSITIVES) -> Column:
    """Does a cell (rows, precision, recall, fpr, fp, tn) reach the limits? Without rows it fails; ``precision`` None isn't asked for."""
    ok = (F.coalesce("rows", F.lit(0)) > 0) & (F.coalesce("recall", F.lit(0.0)) >= recall) & (false_positive_rate() <= fpr)
    return ok if precision is None else ok & (F.coalesce("precision", F.lit(0.0)) >= precision)


def all_pass(cells: DataFrame, by: str, passes: Column) -> DataFrame:
    """(fact, ok): do all cells of each ``by`` pass?"""
    return cells.groupBy(F.col(by).alias("fact")).agg(F.every(passes).alias("ok"))


def points(needed: DataFrame, facts: DataFrame) -> DataFrame:
    """(point, ready, missing, failed) against ``facts(source, fact, ok)``: a fact that no source has is a row of the count ``missing``."""
    known = facts.groupBy("source", "fact").agg(F.every(F.coalesce("ok", F.lit(False))).alias("ok"))
    held = needed.join(known, ["source", "fact"], "left")
    return held.groupBy("point").agg(F.every(F.coalesce("ok", F.lit(False))).alias("ready"), F.count_if(F.col("ok").isNull()).alias("missing"), F.count_if(~F.col("ok")).alias("failed"))


def roll_up(dataset: DataFrame, cells: DataFrame, evidence: DataFrame, evidence_required: bool = True) -> DataFrame:
    """One row: (dataset_valid, quality, evidence, candidate) of ``dataset(valid)``, ``cells(passed)`` and ``points``; no cells is no quality."""
    valid = dataset.agg(F.coalesce(F.every("valid"), F.lit(False)).alias("dataset_valid"))
    quality = cells.agg(F.coalesce(F.every("passed"), F.lit(False)).alias("quality"), F.count("*").alias("cells"), F.count_if("passed").alias("cells_passed"))
    ready = evidence.agg(F.coalesce(F.every("ready"), F.lit(False)).alias("evidence"), F.count_if("ready").alias("points_ready"))
    one = valid.join(F.broadcast(quality)).join(F.broadcast(ready))  # one row each
    promoted = F.col("dataset_valid") & F.col("quality") & (F.col("evidence") if evidence_required else F.lit(True))
    return one.withColumn("candidate", promoted)
