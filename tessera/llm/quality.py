"""Quality classifier: naive Bayes support vectors over byte, word and repetition n-gram indicators of the whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_bucket, mix, prefix_sums, span_hashes, text_runs
from tessera.llm.nbsvm import LinearModel, fit_on_sample, score_texts
from tessera.llm.shingles import words_of

SIZE = 1 << 17
#: Shares of words that equal the word before them, and of upper-case letters, that count as indicators.
_STEPS = np.array([0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8])
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def quality_features(column: pa.Array) -> Iterator[np.ndarray]:
    """Distinct hashed features of each text: byte 1- to 3-grams, words, pairs of equal words, and steps of shares."""
    flags = np.zeros(SIZE, bool)
    mask = np.uint64(SIZE - 1)
    for i, j, data, offsets in text_runs(column):
        with np.errstate(over="ignore"):
            one = data.astype(np.uint64) + np.uint64(1)
            two = one[:-1] * np.uint64(257) + one[1:] if len(one) > 1 else one[:0]
            three = two[:-1] * np.uint64(257) + one[2:] if len(one) > 2 else one[:0]
        grams = [(mix(x, 20 + n) & mask).astype(np.int64) for n, x in enumerate((one, two, three))]
        start, end, row = words_of(data, offsets)
        words = span_hashes(prefix_sums(data), start, end, 5)
        bounds = np.searchsorted(row, np.arange(j - i + 1))
        same = np.concatenate(([False], (words[1:] == words[:-1]) & (row[1:] == row[:-1]))) if len(words) else np.zeros(0, bool)
        numbers = (words & mask).astype(np.int64)
        for k in range(j - i):
            a, b, u, v = offsets[k], offsets[k + 1], bounds[k], bounds[k + 1]
            found = [g[a : max(a, b - n)] for n, g in enumerate(grams)] + [numbers[u:v]]
            if v > u:
                repeated = np.flatnonzero(same[u:v].mean() >= _STEPS)
                letters = _LETTER[data[a:b]].sum()
                shouting = np.flatnonzero(_UPPER[data[a:b]].sum() >= _STEPS * max(1, letters))
                marks = np.concatenate((repeated, 100 + shouting, 200 + np.flatnonzero(letters <= (b - a) * _STEPS))).astype(np.uint64)
                found.append((mix(marks, 77) & mask).astype(np.int64))
            hits = np.concatenate(found)
            flags[hits] = True
            distinct = np.flatnonzero(flags)
            flags[hits] = False
            yield distinct


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, most_rows: int = 8_000) -> LinearModel:
    """Learn ``labels.quality`` from rows outside the held fold, at most ``most_rows`` of them."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    return fit_on_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), known, crc_bucket("doc_id", folds) != held_fold, quality_features, SIZE, most_rows)


def score_quality(docs: DataFrame, model: LinearModel) -> DataFrame:
    """``docs`` and a column ``score``: 0 to 1, higher where label 1 is likelier; null and empty texts get the bias alone.

    Texts are scored whole. Repeated rows get the same score, an empty table gives none, other columns stay, and a
    column ``score`` is replaced. A model of one class scores every text alike.
    """
    return score_texts(docs, model, quality_features)
