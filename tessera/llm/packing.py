"""Best-two-fit packing of token pieces into sequences.

What decides a packing is how many pieces of each length there are: a table of at most ``capacity`` rows, whatever
the number of documents. The plan is made on that table, as patterns of lengths and how often each is used. Pieces
are numbered within their length and take their place in a pattern by that number.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_shuffles, materialize
from tessera.llm.tokens import Encoder

SALTS = 256


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and ``end_id``, cut at ``capacity`` only if longer; the first piece takes the remainder."""

    def run(batches):
        encode, end = Encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    length = (n - start) % capacity or capacity
                    out.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, piece = start + length, piece + 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            cols = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def two_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths, times used) that use up ``counts``.

    A bin takes the largest length left, then again and again the largest that fits. If room is left, its smallest
    piece gives way to the two lengths left that together fill the widened gap best, if they fill it better.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []

    def largest(most: int) -> int:
        at = np.flatnonzero(left[1 : most + 1])
        return int(at[-1]) + 1 if len(at) else 0

    while length := largest(capacity):
        pattern = [length]
        left[length] -= 1
        gap = capacity - length
        while gap and (length := largest(gap)):
            many = min(int(left[length]), gap // length)
            pattern += [length] * many
            left[length] -= many
            gap -= many * length
        if gap and len(pattern) > 1:
            small, room, best = pattern[-1], gap + pattern[-1], (pattern[-1], 0, 0)
            for x in np.flatnonzero(left[: room + 1])[::-1].tolist():
                if 2 * x < best[0]:
                    break
                y = largest(min(x, room - x)) if x < room else 0
                if y == x and left[x] < 2:
                    y = largest(x - 1) if x > 1 else 0
                if y and x + y > best[0]:
                    best = (x + y, x, y)
            if best[1]:
                pattern[-1:] = best[1:]
                left[small] += 1
                left[best[1]] -= 1
                left[best[2]] -= 1
        lengths, used = np.unique(pattern, return_counts=True)
        times = 1 + int((left[lengths] // used).min())
        left[lengths] -= used * (times - 1)
        plan.append((pattern, times))
    return plan


def places(plan: list[tuple[list[int], int]], capacity: int) -> dict[int, np.ndarray]:
    """For each length a table of (first number, first sequence, offset): numbers from there on take the sequences from there on."""
    taken, rows, sequence = [0] * (capacity + 1), {}, 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            rows.setdefault(length, []).append((taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return {length: np.array(x, np.int64) for length, x in rows.items()}


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null and empty texts are one piece of ``end_id`` alone. Each row of ``docs`` is a document of its own, also where
    ids repeat or are null. Other columns are ignored.
    """
    pieces = materialize(token_pieces(docs, vocabulary, capacity, end_id), "pieces")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(places(two_fit_plan(counts, capacity), capacity))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "salt", "first")
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = salted.withColumn("number", F.row_number().over(own) - 1).join(firsts, ["length", "salt"]).withColumn("number", F.col("number") + F.col("first"))

    def run(batches):
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own, table = np.flatnonzero(length == x), shared.value[int(x)]
                at = np.searchsorted(table[:, 0], number[own], side="right") - 1
                sequence[own], offset[own] = table[at, 1] + number[own] - table[at, 0], table[at, 2]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    free_shuffles(docs.sparkSession)
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
