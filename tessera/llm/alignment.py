"""Alignment of two tokenizers: which of their tokens cover the same bytes, in each text and over all texts.

Both tokenizers cut the same bytes. Where tokens of both end there is a shared cut; groups lie between neighbouring cuts.

* Two lists of ends are aligned by divide and conquer: the common end nearest the middle is found by bisection, both
  halves are done likewise, and an interval without a common end inside is a group. All intervals are divided together.
* Both tokenizers always cut before a single space between two other signs (checked when the vocabularies are loaded), so
  texts are divided there first, and what lies between, a word as a rule, is aligned once and looked up from then on.
* Documents are handled in blocks. A block knows each distinct pair of ids once, so what is counted and looked up over all
  documents is one row per block and pair, never one per link, and all of it meets by (pair) and by (block) in shuffles.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, drop_materialized, materialize
from tessera.llm.tokens import uneven, unkept_encoder

#: Bytes of text in a block, unless one text is longer.
BLOCK_BYTES = 4 << 20


def shared_groups(a: np.ndarray, b: np.ndarray, intervals: np.ndarray | None = None) -> np.ndarray:
    """Rows of (first, end) in ``a`` and (first, end) in ``b``: the tokens of each group, in order, for ascending ends of tokens.

    ``intervals`` has such rows too, each with tokens of both over the same bytes; by default all tokens are one. All
    intervals of a level are divided at once: the ends of A nearest each middle are looked up in B by bisection, then the
    next ones to either side, until a common end is found or an interval has none and is a group.
    """
    todo, groups = np.array([[0, len(a), 0, len(b)]]) if intervals is None else intervals, []
    while len(todo):
        a0, a1, b0, b1 = todo.T
        cut, away = np.full(len(todo), -1), 0
        open_ = np.flatnonzero((a1 - a0 > 1) & (b1 - b0 > 1))
        while len(open_):
            low, last = a0[open_], a1[open_] - 1
            for side in (0, 1):
                i = (low + last) // 2 + (away if side else -away)
                inside = (cut[open_] < 0) & (i >= low) & (i < last)
                at = np.searchsorted(b, a[i[inside]])
                which = open_[inside]
                hit = (b[np.minimum(at, len(b) - 1)] == a[i[inside]]) & (at < b1[which] - 1)
                cut[which[hit]] = i[inside][hit]
            away += 1
            open_ = open_[(cut[open_] < 0) & (away <= (last - low + 1) // 2)]
        done = cut < 0
        groups.append(todo[done])
        i = cut[~done] + 1
        j = np.searchsorted(b, a[i - 1]) + 1
        x0, x1, y0, y1 = todo[~done].T
        todo = np.concatenate((np.stack((x0, i, y0, j), 1), np.stack((i, x1, j, y1), 1)))
    out = np.concatenate(groups) if groups else np.zeros((0, 4), np.int64)
    return out[np.argsort(out[:, 0], kind="stable")]


def links_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, end) of all pairs of tokens whose bytes overlap: every stretch without an end inside lies in one of each."""
    ends = np.union1d(a, b)
    return np.searchsorted(a, ends), np.searchsorted(b, ends), ends


class Aligner:
    """Aligns pieces of text by two vocabularies; the number of a piece stands for what was found.

    ``numbers`` has five for each: tokens of A, tokens of B, groups, links, 1 if bytes differ. ``pairs`` holds A id * 2^32
    + B id of each link, from ``bounds[k]`` to ``bounds[k + 1]``; ``groups[k]`` the ids of each group as text.
    """

    MOST, LONGEST = 800_000, 40

    def __init__(self, byte_vocabulary: str, piece_model: str):
        self.encode_a, lengths = unkept_encoder(byte_vocabulary)
        self.model = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece crosses the start of a word")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) or self.model.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = np.array(lengths), np.array([*map(len, self.bytes_b)])
        self.names = [*map(str, range(max(len(lengths), len(pieces))))]
        self.start()

    def start(self) -> None:
        self.known: dict[str, int] = {}
        self.numbers, self.bounds, self.pairs, self.groups = array("q"), array("q", [0]), array("Q"), []

    def full(self) -> bool:
        return len(self.groups) > self.MOST or len(self.pairs) > 10 * self.MOST

    def add(self, texts: list[str]) -> None:
        """Numbers for texts that each follow a space."""
        for k, text in enumerate(texts, len(self.groups)):
            self.known[text] = k
        spaced = [" " + t for t in texts]
        ids_b = self.model.encode(texts, num_threads=1)
        same = [b"".join(map(self.bytes_b.__getitem__, x)) == t.encode() for x, t in zip(ids_b, spaced, strict=True)]
        ids_a = [self.encode_a(t) if ok else [] for t, ok in zip(spaced, same, strict=True)]
        ids_b = [x if ok else [] for x, ok in zip(ids_b, same, strict=True)]
        per = [np.array([*map(len, x)], np.int64) for x in (ids_a, ids_b)]
        flat = [np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in zip((ids_a, ids_b), per, strict=True)]
        a, b = np.cumsum(self.length_a[flat[0]]), np.cumsum(self.length_b[flat[1]])
        ends_a, ends_b = (np.cumsum(n) for n in per)
        whole = np.stack((ends_a - per[0], ends_a, ends_b - per[1], ends_b), 1)
        groups = shared_groups(a, b, whole[per[0] > 0])
        i, j, ends = links_of(a, b)
        stops = np.concatenate(([0], a))[ends_a]  # bytes before the end of each text
        links = np.diff(np.searchsorted(ends, stops, side="right"), prepend=0)
        upto = np.searchsorted(groups[:, 1], ends_a, side="right")
        self.numbers.frombytes(np.stack((*per, np.diff(upto, prepend=0), links, ~np.array(same, bool)), 1).astype(np.int64).tobytes())
        self.bounds.frombytes((len(self.pairs) + np.cumsum(links)).astype(np.int64).tobytes())
        self.pairs.frombytes(((flat[0][i] << 32) | flat[1][j]).astype(np.uint64).tobytes())
        named_a, named_b = ([*map(self.names.__getitem__, x.tolist())] for x in flat)
        shown = [f"{named_a[p]}|{named_b[r]}" if q - p == t - r == 1 else f"{','.join(named_a[p:q])}|{','.join(named_b[r:t])}" for p, q, r, t in groups.tolist()]
        self.groups += [";".join(shown[p:q]).encode() for p, q in zip([0, *upto.tolist()], upto.tolist())]

    def pieces(self, texts: list[str | None]) -> list[list[int]]:
        """Numbers of the pieces of each text; none where it has no tokens."""
        split = [[] if not t else [t] if uneven(t) else t.split(" ") for t in texts]
        fresh: set[str] = set()
        for words in split:
            fresh |= set(words).difference(self.known)
        if fresh:
            self.add(sorted(fresh))
        found = [[*map(self.known.__getitem__, words)] for words in split]
        for text in fresh:
            if len(text) > self.LONGEST:
                del self.known[text]
        differ = set(np.flatnonzero(np.frombuffer(self.numbers, np.int64)[4::5]).tolist())
        return [[] if differ and not differ.isdisjoint(x) else x for x in found]


@lru_cache(maxsize=1)
def shared_aligner(byte_vocabulary: str, piece_model: str) -> Aligner:
    """One aligner for all tasks of a Python worker, so its words outlive a task."""
    return Aligner(byte_vocabulary, piece_model)


# --- a block of documents -------------------------------------------------------------------

_DOC = {"block": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string(), "held": pa.binary(), "times": pa.binary()}
_PAIR = {"number": pa.int32(), "a": pa.int32(), "b": pa.int32(), "n_docs": pa.int64()}
_SCHEMA = pa.schema([*_DOC.items(), *_PAIR.items()])
_DDL = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, held binary, times binary, number int, a int, b int, n_docs long"


def _blocks(texts: list[str | None], most: int):
    """(first, end) of runs of whole texts of at most ``most`` characters, or one longer text."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > first and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(texts):
        yield first, len(texts)


def _aligned_block(aligner: Aligner, block: int, doc_ids: list, texts: list, digest: bool):
    """Rows of a block: one per document (with the numbers of its pairs in the block and how often it has each), one per pair."""
    if aligner.full():
        aligner.start()
    pieces = aligner.pieces(texts)
    shown = []
    for found in pieces:
        text = b";".join([aligner.groups[k] for k in found])
        shown.append(hashlib.sha256(text).hexdigest() if digest and found else text.decode())
    n, per_doc = len(texts), np.array([len(p) for p in pieces])
    flat = np.fromiter((k for p in pieces for k in p), np.int64, int(per_doc.sum()))
    doc = np.repeat(np.arange(n), per_doc)
    numbers = np.frombuffer(aligner.numbers, np.int64).reshape(-1, 5)
    sums = [np.bincount(doc, weights=numbers[flat, c], minlength=n).astype(np.int64) for c in range(4)]
    # each distinct piece of a document once, with how often it stands there
    kinds = len(aligner.groups)
    own, often = np.unique(doc * kinds + flat, return_counts=True)
    doc, piece = own // kinds, own % kinds
    bounds = np.frombuffer(aligner.bounds, np.int64)
    size = bounds[piece + 1] - bounds[piece]
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(bounds[piece], size)
    pairs, number = np.unique(np.frombuffer(aligner.pairs, np.uint64)[place], return_inverse=True)
    both, where = np.unique(np.repeat(doc, size) * max(1, len(pairs)) + number, return_inverse=True)
    times = np.bincount(where, weights=np.repeat(often, size), minlength=len(both)).astype("<u4")
    doc, number = both // max(1, len(pairs)), (both % max(1, len(pairs))).astype("<u4")
    at = np.searchsorted(doc, np.arange(n + 1)).tolist()
    rows = {"block": np.full(n, block), "doc_id": doc_ids, **dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums, strict=True)), "groups": shown}
    rows |= {c: [x[i:j].tobytes() for i, j in zip(at, at[1:])] for c, x in (("held", number), ("times", times))}
    yield _filled(rows, n)
    n_docs = np.bincount(number, minlength=len(pairs))
    yield _filled({"block": np.full(len(pairs), block), "number": np.arange(len(pairs)), "a": pairs >> np.uint64(32), "b": pairs & np.uint64(2**32 - 1), "n_docs": n_docs}, len(pairs))


def _filled(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


# --- over all documents ---------------------------------------------------------------------


def align_documents(docs: DataFrame, byte_vocabulary: str, piece_model: str, digest: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``groups`` is the alignment itself, ``a1,a2|b1;a3|b2,b3`` with decimal ids in order, or, where ``digest`` is set, its
    sha256. A pair of ids counts once for each document that links it; ``count_sum`` adds that count up over the links
    of a document, ``n_best`` tells how many of them are of a pair that no other pair of the same A id exceeds.

    Null and empty texts, and texts whose tokens don't add up to a space and the text, have no tokens: zeros and ''.
    Special tokens' strings are plain text. Texts count whole, of any length. Each row is a document of its own, also
    where ids repeat or are null. No rows give none. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        aligner, block = shared_aligner(byte_vocabulary, piece_model), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for i, j in _blocks(texts, BLOCK_BYTES):
                yield from _aligned_block(aligner, block, ids[i:j], texts[i:j], digest)
                block += 1

    both = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _DDL), "aligned")
    pairs = both.where("number is not null").select("block", "number", "a", "b", "n_docs")
    counts = pairs.groupBy("a", "b").agg(F.sum("n_docs").alias("n"))
    # an A id meets at most as many B ids as the other vocabulary has
    counts = materialize(counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a"))), "pair-counts")
    known = pairs.join(counts, ["a", "b"]).select(F.col("block").alias("of"), "number", "n", "best")

    def finish(key, left, right):
        number = right.column("number").to_numpy()
        n, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        n[number], best[number] = right.column("n").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        sums, bests = [], []
        for held, times in zip(left.column("held").to_pylist(), left.column("times").to_pylist(), strict=True):
            at, often = np.frombuffer(held, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
            sums.append(int(n[at] @ often))
            bests.append(int(best[at] @ often))
        out = {c: left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64()), "groups": left.column("groups")}
        return pa.table(out)

    rows = both.where("number is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "held", "times")
    out = rows.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    out = materialize(out, "alignment")
    for done in (both, counts):
        drop_materialized(done)
    return out
