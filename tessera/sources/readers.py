"""Tolerant and strict readers, layouts of layered tables, checksums, backfill."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the cluster names; only a local master may do without, below its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One row per well-formed line; blank and malformed lines are skipped; a missing path is an empty table."""
    if not exists(spark, path):
        parsed = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        return spark.createDataFrame([], parsed)
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


@dataclass
class Sorted:
    """Lines of a source sorted into what is kept and what isn't, with counts taken while they were written."""

    kept: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def sort_jsonl(spark: SparkSession, path: str, schema: str, rules: dict[str, Column]) -> Sorted:
    """Every line either kept or rejected, with the first reason that holds: ``blank``, ``malformed``, then ``rules`` in order.

    One pass: lines are parsed once and written to a folder of kept rows and one of rejected lines, while the counts are
    observed on the way. A rule that is null for a row doesn't reject it. A missing path has no lines. ``rejected`` is
    (line, reason); ``counts`` has ``read``, ``kept`` and one count per reason.
    """
    wanted = T._parse_datatype_string(schema)
    full = T.StructType([*wanted.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path) if exists(spark, path) else spark.createDataFrame([], "value string")
    parsed = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("row"))
    flat = parsed.select("value", "row.*")
    reasons = {"blank": F.trim("value") == "", "malformed": F.col("_bad").isNotNull(), **rules}
    reason = F.coalesce(*(F.when(holds, name) for name, holds in reasons.items()), F.lit("kept"))
    seen = Observation()
    counted = flat.withColumn("reason", reason).observe(seen, F.count("*").alias("read"), F.count_if(F.col("reason") == "kept").alias("kept"), *(F.count_if(F.col("reason") == n).alias(n) for n in reasons))
    place = scratch(spark, "sorted")
    kept = F.col("reason") == "kept"
    stored = counted.select(F.when(~kept, F.col("value")).alias("line"), "reason", F.when(kept, F.struct(*(F.col(f.name) for f in wanted.fields))).alias("row"), kept.alias("is_kept"))
    stored.write.partitionBy("is_kept").parquet(place)
    back = spark.read.schema(T.StructType([*stored.schema.fields])).parquet(place)
    return Sorted(back.where("is_kept").select("row.*"), back.where("not is_kept").select("line", "reason"), dict(seen.get))


def read_jsonl_strict(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Any malformed line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as leaf columns with joined names; arrays and maps stay."""

    def leaves(schema: T.StructType, path: list[str]) -> Iterator[Column]:
        for f in schema.fields:
            at = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, at)
            else:
                yield F.col(".".join(f"`{p}`" for p in at)).alias(sep.join(at))

    return df.select(*leaves(df.schema, []))


def load_shards(spark: SparkSession, root: str, name: str, keys: list[str]) -> DataFrame:
    """All tables of one name below a root, by column name, one row per key."""
    df = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").option("pathGlobFilter", "*.parquet").parquet(f"{root}/*/{name}")
    return df.dropDuplicates(keys)


def read_positional_csv(spark: SparkSession, path: str, names: list[str], sep: str = ";") -> DataFrame:
    """Strings by position; rows that repeat the header are dropped by what they hold, not by where they are."""
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    raw = spark.read.csv(path, sep=sep, schema=schema).toDF(*names)
    same = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.lit(n)) for n in names))
    return raw.where(~same)


def write_layer(df: DataFrame, root: str, layer: str, name: str, by: str | None = None) -> str:
    path = f"{root}/{layer}/{name}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return path


def read_exit_code(spark: SparkSession, path: str) -> DataFrame:
    """One row: the integer in a one-line file, -1 if there is none."""
    if not exists(spark, path):
        return spark.sql("SELECT -1 AS code")
    return spark.read.text(path).limit(1).agg(F.coalesce(F.max(F.expr("try_cast(trim(value) AS int)")), F.lit(-1)).alias("code"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_checksums(found: DataFrame, stated: DataFrame) -> DataFrame:
    """(file, state): ok, mismatch, missing or unlisted."""
    joined = found.select("file", F.col("sha256").alias("has")).join(stated.select("file", F.col("sha256").alias("said")), "file", "full")
    state = F.when(F.col("has").isNull(), "missing").when(F.col("said").isNull(), "unlisted").when(F.col("has") == F.col("said"), "ok").otherwise("mismatch")
    return joined.select("file", state.alias("state"))


def missing_shards(source: DataFrame, target: DataFrame, shard: str) -> DataFrame:
    """Shards of the source that the target lacks."""
    return source.select(shard).distinct().join(target.select(shard).distinct(), shard, "left_anti")


def backfill_shards(spark: SparkSession, shards: list[str], source: Callable[[str], DataFrame], target: str, at_once: int = 4) -> DataFrame:
    """(shard, state, n, reason): builds the table of each shard that ``target`` lacks; ``built``, ``skipped`` or ``error``.

    A shard is a job of its own. It is written under another name and gets its own by one rename when it is whole, so
    readers never see part of one and a job that died leaves nothing that counts. A shard whose job fails, or that derives no
    rows, is an error with its reason; the others are built all the same.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path

    def build(shard: str) -> tuple[str, str, int, str]:
        final, draft = f"{target}/{shard}", f"{target}/.draft-{shard}-{uuid.uuid4().hex[:12]}"
        fs = fs_path(target).getFileSystem(spark._jsc.hadoopConfiguration())
        if exists(spark, f"{final}/_SUCCESS"):
            return shard, "skipped", 0, ""
        try:
            source(shard).write.parquet(draft)
            n = spark.read.parquet(draft).count()
            if n and fs.rename(fs_path(draft), fs_path(final)):
                return shard, "built", n, ""
            reason = "no rows" if not n else "another writer was first"
        except Exception as error:  # noqa: BLE001  any failure of one shard is its own
            reason = getattr(error, "getCondition", lambda: None)() or type(error).__name__
        fs.delete(fs_path(draft), True)
        return shard, "error", 0, reason

    with ThreadPoolExecutor(at_once) as pool:
        done = list(pool.map(build, shards))
    return spark.createDataFrame(done, "shard string, state string, n long, reason string")


def append_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def ensure_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """Add the columns that are absent, with their defaults."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})
