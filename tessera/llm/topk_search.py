"""Exact top-k by integer inner product: tiled matrix products of query blocks and candidate shards.

Vectors are packed into tiles and queries into blocks of bounded size. Blocks and groups of tiles form a grid; a
cell multiplies its block with its tiles one after the other, selects within each tile, and keeps one list of
``k`` per query. The lists of a query are merged in two steps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _pack(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Rows (keys, id, v array<long>) as matrices of at most ``most`` rows that share keys and length."""

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            groups: dict[tuple, list[int]] = {}
            vectors, ids = table.column("v").to_pylist(), table.column("id").to_pylist()
            for i, key in enumerate(zip(*(table.column(k).to_pylist() for k in keys), map(len, vectors), strict=True)):
                groups.setdefault(key, []).append(i)
            rows = [(*key, *_narrow(np.array([vectors[i] for i in part], np.int64)), np.array([ids[i] for i in part], np.int64).tobytes()) for key, at in groups.items() for part in (at[j : j + most] for j in range(0, len(at), most))]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(len(keys) + 4)]
            types = [pa.int32()] * (len(keys) + 2) + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [*keys, "dim", "width", "matrix", "ids"])

    return df.select(*keys, "id", "v").mapInArrow(run, ", ".join([*(f"{k} int" for k in keys), "dim int, width int, matrix binary, ids binary"]))


def _narrow(matrix: np.ndarray) -> tuple[int, bytes]:
    """Bytes per number, 2, 4 or 8 as the largest one needs, and the numbers."""
    low, high = int(matrix.min(initial=0)), int(matrix.max(initial=0))
    width = next(w for w in (2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
    return width, matrix.astype(f"<i{width}").tobytes()


def products(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond the range of long they stop at its ends."""
    bound = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(t.astype(float)).max(initial=0)) * max(1, q.shape[1])
    if bound < 2**53:
        return (q.astype(np.float64) @ t.T.astype(np.float64)).astype(np.int64)
    if bound < 2**62:
        return q @ t.T
    exact = q.astype(object) @ t.T.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def select(score: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the ``k`` best of each row, ties to the smaller id."""
    if score.shape[1] > 2 * k:
        low = np.where(allowed, score, np.iinfo(np.int64).min)
        allowed = allowed & (score >= np.partition(low, -k, axis=1)[:, -k][:, None])
    row, col = np.nonzero(allowed)
    return best(row, ids[col], score[row, col], k)


def best(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, ~score, row))
    row, ids, score = row[order], ids[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], ids[place < k], score[place < k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, tile_rows: int = 2048, block_rows: int = 4096, cell_tiles: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score) for all ``queries(id, v)`` against all ``vectors(id, v)``, v: array<long>.

    Every row is a candidate, also where ids repeat, but for those with the query's own id; of queries with one id the
    least vector counts. Fewer candidates than ``k`` give fewer rows; vectors of another length than the query's are
    no candidates; rows with a null id or vector take no part; no rows, no result. Ties go to the smaller id. Other
    columns are ignored. A matrix is sent with as few bytes a number as it needs.
    """
    vectors, queries = (d.where("id is not null and v is not null").select("id", "v") for d in (vectors, queries))
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    n_queries, n_vectors = queries.count(), vectors.count()
    blocks, groups = max(1, math.ceil(n_queries / block_rows)), max(1, math.ceil(n_vectors / (tile_rows * cell_tiles)))
    block_of, group_of = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.floor(F.rand(7) * groups).cast("int")  # copies of one id spread too
    left = _pack(queries.withColumn("block", block_of).repartition(blocks, "block"), ["block"], block_rows)
    right = _pack(vectors.withColumn("cell", group_of).repartition(groups, "cell"), ["cell"], tile_rows)
    left = left.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("side", F.lit(0))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(1))
    grid = left.unionByName(right).repartition(blocks * groups, "block", "cell").sortWithinPartitions("block", "cell", "dim", "side")

    def run(batches):
        at, q_ids, q, lists = None, None, None, None

        def out():
            if lists is None or not len(lists[0]):
                return
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[lists[0]]), pa.array(np.full(len(lists[0]), at[1], np.int32)), pa.array(lists[1]), pa.array(lists[2])], ["query_id", "cell", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                key, ids = (r["block"], r["cell"], r["dim"]), np.frombuffer(r["ids"], np.int64)
                matrix = np.frombuffer(r["matrix"], f"<i{r['width']}").reshape(len(ids), r["dim"]).astype(np.int64)
                if key != at:
                    yield from out()
                    at, q_ids, q, lists = key, None, None, None
                if r["side"] == 0:
                    q_ids, q = (ids, matrix) if q is None else (np.concatenate((q_ids, ids)), np.concatenate((q, matrix)))
                elif q is not None:
                    got = select(products(q, matrix), q_ids[:, None] != ids[None, :], ids, k)
                    lists = got if lists is None else best(*(np.concatenate(x) for x in zip(lists, got, strict=True)), k)
        yield from out()

    found = grid.mapInArrow(run, "query_id long, cell int, vec_id long, score long")
    fan = max(2, math.isqrt(groups))
    for by in (["query_id", F.floor(F.col("cell") / fan)], ["query_id"]):
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def scaled_integers(table: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of each component in double precision. Vectors that are null or hold a null, NaN or infinite component are left out."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    kept = table.where(v.isNotNull()).where(~bad)
    return kept.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(scale))).alias("v"))
