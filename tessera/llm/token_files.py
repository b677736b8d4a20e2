"""Token ids in binary files of compressed planes, with an index of chunks, written and read in parallel.

A file holds whole documents in ascending order of id:

    "TPF1" | chunks | documents | footer | footer's place (8 bytes) | "TPF1"

Ids are unsigned 32-bit integers, cut into chunks of a fixed number of them (the last of a file may be shorter). A chunk is
turned into planes: the first bytes (or bits) of all its ids, then the second ones, and so on. Each plane is a zstandard
frame of its own; a plane of zeros takes no room. ``documents`` is one zstandard frame of id flags, ids and numbers
of tokens. The footer is one more: plane width, ids per chunk, and for each chunk its place, ids and bytes per plane, so any
chunk, or one plane of it, is read alone. All numbers are little-endian.

A file gets a name of its own for each attempt at a task. It counts only once Spark has committed the task's row of the
index, so what lost executors leave behind is never read; ``remove_unlisted`` deletes it.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_path
from tessera.llm.tokens import shared_encoder
from tessera.operators.ranges import running_sums

MARK = b"TPF1"


# --- planes ---------------------------------------------------------------------------------


def to_planes(ids: np.ndarray, bits: int) -> np.ndarray:
    """Rows of bytes: plane p holds byte (``bits`` 8) or bit (``bits`` 1) p of every id."""
    by_byte = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return np.ascontiguousarray(by_byte.T)
    return np.packbits(np.unpackbits(by_byte, axis=1, bitorder="little").T, axis=1, bitorder="little")


def from_planes(planes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The ``n`` ids of ``to_planes``."""
    if bits == 8:
        return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")
    each = np.unpackbits(planes, axis=1, count=n, bitorder="little")
    return np.packbits(each.T, axis=1, bitorder="little").reshape(-1).view("<u4")


# --- one file -------------------------------------------------------------------------------


class FileWriter:
    """Writes one file chunk by chunk; holds a chunk of ids and 16 bytes a document."""

    def __init__(self, sink, chunk_ids: int, bits: int, level: int = 3):
        self.sink, self.chunk_ids, self.bits = sink, chunk_ids, bits
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.pending, self.n_pending, self.chunks, self.docs, self.n_ids = [], 0, [], [], 0
        self.place = sink.write(MARK)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.n_ids += len(ids)
        at = 0
        while at < len(ids):
            part = ids[at : at + self.chunk_ids - self.n_pending]
            self.pending.append(part)
            self.n_pending += len(part)
            at += len(part)
            if self.n_pending == self.chunk_ids:
                self._flush()

    def _flush(self) -> None:
        ids = np.concatenate(self.pending)
        frames = [self.compress(plane.tobytes()) if plane.any() else b"" for plane in to_planes(ids, self.bits)]
        self.chunks.append(struct.pack(f"<QI{len(frames)}I", self.place, len(ids), *map(len, frames)))
        self.place += self.sink.write(b"".join(frames))
        self.pending, self.n_pending = [], 0

    def close(self) -> int:
        """Ends the file; its size in bytes."""
        if self.n_pending:
            self._flush()
        flags = bytes(d is not None for d, _ in self.docs)
        ids, counts = (np.array(x, "<i8").tobytes() for x in ([d or 0 for d, _ in self.docs], [n for _, n in self.docs]))
        docs = self.compress(flags + ids + counts)
        footer = self.compress(struct.pack("<BIQII", self.bits, self.chunk_ids, len(self.docs), len(docs), len(self.chunks)) + b"".join(self.chunks))
        size = self.place + self.sink.write(docs + footer + struct.pack("<Q", self.place + len(docs)) + MARK)
        self.sink.close()
        return size


class FileReader:
    """Reads the footer and documents at once, and chunks when asked for."""

    def __init__(self, source):
        self.source, size = source, source.size()
        tail = self._read(size - 12, 12)
        if size < 16 or tail[8:] != MARK or self._read(0, 4) != MARK:
            raise ValueError("not a whole file of token planes")
        self.expand = zstandard.ZstdDecompressor().decompress
        place = struct.unpack("<Q", tail[:8])[0]
        footer = self.expand(self._read(place, size - 12 - place))
        head = struct.calcsize("<BIQII")
        self.bits, self.chunk_ids, n_docs, n_bytes, n_chunks = struct.unpack("<BIQII", footer[:head])
        one = struct.Struct(f"<QI{32 // self.bits}I")
        self.chunks = [one.unpack_from(footer, head + i * one.size) for i in range(n_chunks)]
        docs = self.expand(self._read(place - n_bytes, n_bytes))
        self.known = np.frombuffer(docs, np.bool_, n_docs)
        self.doc_ids, self.counts = np.frombuffer(docs, "<i8", 2 * n_docs, n_docs).reshape(2, n_docs)

    def _read(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def chunk(self, i: int) -> np.ndarray:
        """The ids of chunk ``i``."""
        place, n, *sizes = self.chunks[i]
        data, planes, at = self._read(place, sum(sizes)), np.zeros((len(sizes), n if self.bits == 8 else -(-n // 8)), np.uint8), 0
        for p, size in enumerate(sizes):
            if size:
                planes[p] = np.frombuffer(self.expand(data[at : at + size]), np.uint8)
                at += size
        return from_planes(planes, n, self.bits)

    def ids_between(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to before ``end`` of the file; only the chunks that hold them are read."""
        first = start // self.chunk_ids
        parts = [self.chunk(i) for i in range(first, -(-end // self.chunk_ids))]
        return np.concatenate(parts or [np.zeros(0, "<u4")])[start - first * self.chunk_ids : end - first * self.chunk_ids]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place of its first id in the file, ids) of every document, each chunk read once."""
        at, i, held, base = 0, 0, np.zeros(0, "<u4"), 0
        for known, doc_id, n in zip(self.known.tolist(), self.doc_ids.tolist(), self.counts.tolist(), strict=True):
            parts, need = [], n
            while need:
                if at == base + len(held):
                    base, held, i = base + len(held), self.chunk(i), i + 1
                part = held[at - base : at - base + need]
                parts.append(part)
                at, need = at + len(part), need - len(part)
            yield (doc_id if known else None), at - n, parts[0] if len(parts) == 1 else np.concatenate(parts or [held[:0]])


# --- many files -----------------------------------------------------------------------------


@dataclass
class TokenStore:
    """Files below ``path``, listed in a Parquet index beside them."""

    spark: SparkSession
    path: str

    def index(self) -> DataFrame:
        """One row per file: (part, n) order it; name, n_docs, n_ids, n_bytes, and ``start``, the ids of all files before it."""
        files = self.spark.read.parquet(f"{self.path}/index")
        return running_sums(files, F.col("part"), ["n"], {"_upto": F.col("n_ids")}).withColumn("start", F.col("_upto") - F.col("n_ids")).drop("_upto")

    def read(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids): ``ids`` as little-endian unsigned 32-bit integers, ``start`` counted over all files."""
        path, most = self.path, 4 << 20

        def run(batches):
            fs, folder = pafs.FileSystem.from_uri(f"{path}/data")
            for batch in batches:
                for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                    out, held = [], 0
                    with fs.open_input_file(f"{folder}/{name}") as source:
                        for doc_id, place, ids in FileReader(source).documents():
                            out.append((doc_id, start + place, len(ids), ids.tobytes()))
                            held += 4 * len(ids)
                            if held >= most or len(out) >= 2_000:
                                yield _batch(out)
                                out, held = [], 0
                    if out:
                        yield _batch(out)

        index = self.index()
        # a row is a whole file, so each gets a task of its own
        return index.select("name", "start").repartition(max(1, index.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")

    def remove_unlisted(self) -> int:
        """Deletes files that no row of the index names, left by attempts that failed; how many. Only when nobody writes."""
        fs, folder = pafs.FileSystem.from_uri(f"{self.path}/data")
        listed = {r.name for r in self.spark.read.parquet(f"{self.path}/index").select("name").toLocalIterator()}
        gone = [f.path for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.base_name not in listed]
        for f in gone:
            fs.delete_file(f)
        return len(gone)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def write_token_files(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = 2, chunk_ids: int = 65_536, bits: int = 8, file_ids: int = 16_000_000) -> TokenStore:
    """Encodes ``docs(doc_id, text)`` and writes the ids of each document and ``end_id``, in ascending order of id, below ``path``.

    Null and empty texts are ``end_id`` alone. Null ids come first; rows with one id are ordered by a hash of their
    text, and each counts. Long texts are encoded whole and may span chunks but not files; a file ends at the first document
    that brings it to ``file_ids``. An empty table gives a store without files. ``bits`` is 8 for planes of bytes and
    1 for planes of bits. Other columns are ignored. Executors write through ``pyarrow.fs``, so ``path`` is a URI it knows.
    """
    path = path or new_path(docs.sparkSession, "token-files")

    def run(batches):
        fs, folder = pafs.FileSystem.from_uri(f"{path}/data")
        fs.create_dir(folder, recursive=True)
        encode, end = shared_encoder(vocabulary), np.array([end_id], "<u4")
        part, n, writer, name = TaskContext.get().partitionId(), 0, None, ""
        row = lambda: pa.RecordBatch.from_pydict({"part": [part], "n": [n], "name": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids], "n_bytes": [writer.close()]}, schema=_INDEX)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if writer is None:
                    name = f"{part:06d}-{n:04d}-{uuid.uuid4().hex[:12]}.tpf"
                    writer = FileWriter(fs.open_output_stream(f"{folder}/{name}", compression=None), chunk_ids, bits)
                writer.add(doc_id, np.concatenate((np.frombuffer(encode(text or ""), "<u4"), end)))
                if writer.n_ids >= file_ids:
                    yield row()
                    writer, n = None, n + 1
        if writer is not None:
            yield row()

    # rows that share an id and a text are dealt by their place, which no result depends on
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_i"))
    placed = keyed.repartitionByRange("doc_id", "_h", "_i").sortWithinPartitions("doc_id", "_h", "_i").select("doc_id", "text")
    placed.mapInArrow(run, "part int, n int, name string, n_docs long, n_ids long, n_bytes long").write.parquet(f"{path}/index")
    return TokenStore(docs.sparkSession, path)


_INDEX = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
