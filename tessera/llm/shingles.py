"""Sets of word shingles as sorted 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

from tessera.llm.common import mix, prefix_sums, span_hashes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words (no space, no tab to carriage return) of a run of texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins = inside & (first | np.concatenate(([True], ~inside[:-1])))
    start = np.flatnonzero(begins)
    last = np.concatenate((first[1:], [True]))
    end = np.flatnonzero(inside & (last | np.concatenate((~inside[1:], [True])))) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lowered, and their row numbers."""
    start, end, row = words_of(data, offsets)
    return span_hashes(prefix_sums(_LOWER[data]), start, end), row


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingles of row i are ``hashes[bounds[i]:bounds[i + 1]]``, sorted.

    A shingle is ``words`` words in a row; a text with fewer words has its whole sequence as its only one,
    a text without words has none.
    """
    h, row = word_hashes(data, offsets)
    rows = len(offsets) - 1
    per_row = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    first = np.concatenate(([0], np.cumsum(per_row)))[:-1]
    with np.errstate(over="ignore"):
        weights = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(words)]
        n = max(0, len(h) - words + 1)
        total = np.zeros(n, np.uint64)
        for k in range(words):
            total += h[k : k + n] * weights[k]
        whole = row[:n] == row[words - 1 : words - 1 + n] if n else np.zeros(0, bool)
        bounds = np.concatenate(([0], np.cumsum(np.where(per_row < words, per_row > 0, per_row - words + 1))))
        value = np.empty(bounds[-1], np.uint64)
        few = per_row[np.searchsorted(bounds, np.arange(bounds[-1]), side="right") - 1] < words if (per_row < words).any() else np.zeros(bounds[-1], bool)
        value[~few] = mix(total[whole], words)  # rows come in order
        for length in range(1, words):
            rows_of = np.flatnonzero(per_row == length)
            if len(rows_of):
                part = np.zeros(len(rows_of), np.uint64)
                for k in range(length):
                    part += h[first[rows_of] + k] * weights[k]
                value[bounds[rows_of]] = mix(part, length)
    ends = bounds.tolist()
    for k in np.flatnonzero(per_row > words).tolist():
        value[ends[k] : ends[k + 1]].sort()
    if len(value):
        keep = np.concatenate(([True], value[1:] != value[:-1]))
        keep[bounds[:-1][bounds[:-1] < len(value)]] = True
        value, bounds = value[keep], np.concatenate(([0], np.cumsum(keep)))[bounds]
    return value, bounds
