"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``; other columns are left out. Every stage takes null
and empty texts (the quality model scores them by its bias), repeated rows (each counts, but near_duplicates treats rows
with one id as one document), rows with a null id (never a near copy of anything) and empty tables (no rows come back).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, read_table
from tessera.llm.jaccard_join import jaccard_classes
from tessera.llm.mixing import mix_to_targets
from tessera.llm.packing import pack
from tessera.llm.pii import find_personal_data, redact
from tessera.llm.quality import fit_quality, score_quality
from tessera.llm.queries import WEIGHTS, labelled_domains

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score of at least 0.3)."""
    docs = docs.select(*COLUMNS)
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return score_quality(docs, model).where("score >= 0.3").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Documents without a group stay."""
    docs = docs.select(*COLUMNS)
    leaders = jaccard_classes(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(leaders, "doc_id", "left_anti").select(*COLUMNS)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each personal span replaced by its kind; ``n_chars`` follows the new text."""
    found = find_personal_data(docs.select(*COLUMNS))
    clean = found.withColumn("text", redact(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: likely toxic and poor ones less than once, likely good ones once or more.

    A document whose likeliest domain is good has a rate of at least 1, so none of them is lost to rounding.
    """
    mixed = mix_to_targets(docs.select(*COLUMNS), labelled_domains(read_table(spark, sf_dir, "labels")), WEIGHTS, "good", anchor_scale=1.1, keep_anchor=True)
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in training sequences."""
    return pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("personal_data", personal_data_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Classifiers, hashing tokenizers and packing have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
