"""Toxicity behind disguises: a noisy-channel decoder restores words, and a linear model scores the restored text.

A character language model (trigrams, counted over all documents) and a channel that allows look-alike digits
and signs, characters set apart and repeated characters make a lattice for each written word; Viterbi decoding
picks the likeliest letters. A word that has only its own letters is its own single path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_bucket, text_runs
from tessera.llm.nbsvm import LinearModel, fit_on_sample, score_texts

SIZE = 1 << 18
#: Letters that each sign may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Nats that the channel charges for a look-alike, a letter said again in a run of three or more and a sign left out between letters.
SWAP, AGAIN, DROP = 1.0, 0.7, 0.7
CODES = 64  # 0: outside a word; 1-26: a to z; 27-62: other letters of Latin-1 and beyond; 63: any other sign
_EDGE = ".,;:!?\"'()[]{}<>*&%#$-_/\\|~`^=+"


def _code_table() -> np.ndarray:
    table = np.full(0x250, 63, np.int64)
    for c in range(0x250):
        ch = chr(c)
        if ch.isspace():
            table[c] = 0
        elif "a" <= ch.lower()[0] <= "z":
            table[c] = ord(ch.lower()[0]) - 96
        elif ch.isalpha():
            table[c] = 27 + ord(ch.lower()[0]) % 36
    return table


_CODE = _code_table()


def codes_of(text: bytes) -> np.ndarray:
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return _CODE[np.minimum(points, len(_CODE) - 1)]


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over all texts: each task sends its sums once; the table has a fixed size."""

    def run(batches):
        total = np.zeros(CODES**3, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_runs(batch.column("text")):
                for text in (data.tobytes(),) if len(offsets) else ():
                    c = np.concatenate(([0, 0], codes_of(text), [0]))
                    total += np.bincount((c[:-2] * CODES + c[1:-1]) * CODES + c[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(CODES**3, np.int64)
    if rows:
        out[[r.gram for r in rows]] = [r.n for r in rows]
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """log p(third | first two), smoothed with shorter histories."""
    tri = counts.reshape(CODES, CODES, CODES).astype(float)
    uni = (tri.sum((0, 1)) + 0.5) / (tri.sum() + 0.5 * CODES)
    bi = (tri.sum(0) + 5.0 * uni) / (tri.sum((0, 2))[:, None] + 5.0)
    return np.log((tri + 5.0 * bi[None]) / (tri.sum(2)[:, :, None] + 5.0)).astype(np.float32)


def decode(word: str, lm: np.ndarray) -> str:
    """The likeliest letters behind a written word, or behind a run of letters set apart by spaces, where words may end.

    Viterbi over the last two letters; each state holds its letters as a chain, so time and memory grow with the length.
    """
    states = {(0, 0): (0.0, None)}
    for at, ch in enumerate(word):
        said = at and ch == word[at - 1] and any(word[i : i + 3] == 3 * ch for i in (at - 2, at - 1, at) if i >= 0)  # of a run of three or more
        options = [(ch, 0.0)] if ch.isalpha() else [(x, SWAP) for x in LOOKALIKES.get(ch, "")]
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {}

        def put(key, cost, text, best=best):
            if key not in best or cost < best[key][0]:
                best[key] = (cost, text)

        for (p, q), (cost, text) in states.items():
            for letter, charge in options:
                c = int(_CODE[min(ord(letter), len(_CODE) - 1)])
                put((q, c), cost + charge - float(lm[p, q, c]), (text, letter))
            if text and (said or text[1] in LOOKALIKES.get(ch, "")):
                put((p, q), cost + AGAIN, text)
            if ch == " ":
                put((q, 0), cost - float(lm[p, q, 0]), (text, " "))
            if not ch.isalnum():
                put((p, q), cost + DROP, text)
            elif not options:
                put((q, 63), cost - float(lm[p, q, 63]), (text, ch))
        states = best
    if not states:
        return word
    text, letters = min(((cost - float(lm[p, q, 0]), n, text) for n, ((p, q), (cost, text)) in enumerate(states.items())), key=lambda x: x[:2])[2], []
    while text:
        text, letter = text
        letters.append(letter)
    return "".join(reversed(letters))


_DISGUISED = re.compile(r"[^\W\d_][\d@$!|+(€£¡]|[\d@$!|+(€£¡][^\W\d_]|(.)\1\1|[^\W_][.\-_*'][^\W_][.\-_*'][^\W_]")
_APART = re.compile(r"(?<!\S)(?:[^\W_][\x20\t]+){2,}[^\W_](?!\S)")
_GAP = re.compile(r"[\x20\t]+")


class Restorer(dict):
    """Restored forms of written words, decoded when first met; long ones are decoded each time."""

    MOST, LONGEST = 200_000, 64

    def __init__(self, lm: np.ndarray):
        self.lm = lm

    def __missing__(self, word: str) -> str:
        bare = word.strip(_EDGE)
        out = bare
        if not bare.isalpha() or _DISGUISED.search(bare):
            core = word.rstrip(".,;:?\"')]}>").lstrip("\"'([{<")
            letters = sum(map(str.isalpha, core))
            if letters and letters + sum(c in LOOKALIKES for c in core) >= 2 and _DISGUISED.search(core) and core.strip(_EDGE) != "":
                plain = bare if bare.isalpha() and not re.search(r"(.)\1\1", bare) else None
                out = plain or decode(core, self.lm)
        if len(self) < self.MOST and len(word) <= self.LONGEST:
            self[word] = out
        return out

    def run(self, spaced: str) -> str:
        """Letters set apart: gaps wider than the least end a word, others may."""
        gaps = _GAP.findall(spaced)
        least = min(map(len, gaps))
        parts = re.split(r"[\x20\t]{%d,}" % (least + 1), spaced) if max(map(len, gaps)) > least else [spaced]
        return " ".join(decode(_GAP.sub(" ", part), self.lm) for part in parts)


def restore(text: str, words: Restorer) -> list[str]:
    """The words of a text, lower case, with disguises undone."""
    text = text.lower()
    if _APART.search(text):
        text = _APART.sub(lambda m: words.run(m[0]), text)
    return list(map(words.__getitem__, text.split()))


class _Numbers(dict):
    """Feature numbers of a restored word: the word, its beginnings and its end."""

    MOST = 200_000

    def __missing__(self, word: str) -> bytes:
        import zlib

        parts = ["w" + word] + ["p" + word[:n] for n in range(3, min(8, len(word)) + 1)] + (["s" + word[-4:]] if len(word) > 4 else [])
        out = np.array([zlib.crc32(p.encode("utf-8", "replace")) % SIZE for p in parts], np.int32).tobytes()
        if len(self) < self.MOST:
            self[word] = out
        return out


def toxicity_featurizer(lm: np.ndarray):
    """A function from a string column to arrays of distinct features of the restored texts."""
    state: dict[str, dict] = {}

    def features(column: pa.Array) -> Iterator[np.ndarray]:
        if not state:
            state.update(words=Restorer(lm), numbers=_Numbers())
        words, numbers = state["words"], state["numbers"]
        for text in column.to_pylist():
            found = b"".join(map(numbers.__getitem__, set(restore(text or "", words))))
            yield np.unique(np.frombuffer(found, np.int32)).astype(np.int64)

    return features


def fit_toxicity(docs: DataFrame, labels: DataFrame, lm: np.ndarray, folds: int = 3, held_fold: int = 1, most_rows: int = 10_000) -> LinearModel:
    """Learn ``labels.toxic`` from rows outside the held fold, at most ``most_rows`` of them."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label"))
    return fit_on_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), known, crc_bucket("doc_id", folds) != held_fold, toxicity_featurizer(lm), SIZE, most_rows)


def score_toxicity(docs: DataFrame, model: LinearModel, lm: np.ndarray) -> DataFrame:
    """``docs`` and a column ``score``: 0 to 1, higher where label 1 is likelier; null and empty texts get the bias alone.

    Texts are scored whole. Repeated rows get the same score, an empty table gives none, other columns stay, and a
    column ``score`` is replaced. A model of one class scores every text alike.
    """
    return score_texts(docs, model, toxicity_featurizer(lm))
