"""Pieces that several operators of this subpackage share.

* where intermediate tables go (the folder that all executors share),
* splitting Arrow string columns into bounded runs of UTF-8 bytes,
* 64-bit hashes of any byte span of such a run, all spans at once.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
CHUNK_BYTES = 1 << 18


# --- session --------------------------------------------------------------------------------


def bounded_batches(spark: SparkSession, rows: int = 2_000) -> SparkSession:
    """Let Arrow batches hold at most ``rows`` rows from now on: texts of any length then keep a Python worker small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


# --- shared storage -------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset a temporary one is made, but only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` (in a folder for each value of ``by``, which are few) to the shared folder and read it back, so lost executors never replay its lineage."""
    spark = df.sparkSession
    path, writers = new_path(spark, name), "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    try:
        if by:  # a task keeps a file open for each value; without this it sorts its rows by value first
            spark.conf.set(writers, "8")
        df.write.option("compression", "zstd").parquet(path, partitionBy=list(by) or None)
    finally:
        spark.conf.set(writers, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def drop_materialized(df: DataFrame, part: str = "") -> None:
    """Delete the files of a materialized table (or of one of its folders, ``column=value``) that nothing reads any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        path = f"{path}/{part}" if part else path
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of finished steps now instead of at some later collection."""
    gc.collect()
    spark._jvm.System.gc()


# --- runs of bytes --------------------------------------------------------------------------


def utf8_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def text_runs(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole rows of at most ``most`` bytes, or one longer row."""
    data, offsets = utf8_column(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


# --- hashes ---------------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(which: int, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        step = np.full(max(n, 2 * len(_powers[which])), (_BASE, _INVERSE)[which], np.uint64)
        step[0] = 1
        with np.errstate(over="ignore"):
            _powers[which] = np.cumprod(step, dtype=np.uint64)
    return _powers[which][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), so all bits of the result depend on all bits of ``x``."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums over bytes, for ``span_hashes``."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _grown(0, len(data)), dtype=np.uint64, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span [start, end) that depends on nothing but its bytes."""
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * _grown(1, len(sums))[start], seed)


# --- small column helpers -------------------------------------------------------------------


def crc_bucket(column: str, n: int):
    """crc32 of the id as text, modulo ``n``: the fixed folds of the classifiers. A null id is in bucket -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)), F.lit(-1))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
