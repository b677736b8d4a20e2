"""Shape, alphabet and grammar of strings: built-in functions, and counts over the bytes of Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_entropy(value: Column) -> Column:
    """Shannon entropy of the bytes of a string or binary, in bits; 0 for none. One count of 256 cells per value, over Arrow batches."""

    @F.pandas_udf("double")
    def entropy(values: pd.Series) -> pd.Series:
        def one(v) -> float:
            data = np.frombuffer(v.encode("utf-8", "replace") if isinstance(v, str) else bytes(v or b""), np.uint8)
            p = np.bincount(data, minlength=256) / max(1, len(data))
            p = p[p > 0]
            return float(abs((p * np.log2(p)).sum()))

        return pd.Series([one(v) for v in values], dtype="float64")

    return entropy(value)


def share_of(value: Column, char_class: str) -> Column:
    """Share of characters in a class of the regular-expression kind; 0 when empty."""
    return F.regexp_count(value, F.lit(f"[{char_class}]")) / F.greatest(F.lit(1), F.char_length(value))


def counts_between(data: np.ndarray, ends: np.ndarray, tables: np.ndarray, block: int = 1 << 20) -> list[np.ndarray]:
    """For each table of 256 flags: how many flagged bytes each text has; ``ends`` are 0 and the ends of the texts in ``data``.

    Whole texts of about ``block`` bytes are looked up at a time, so beside the data there is little more than that (or a longer text).
    """
    counts = [np.zeros(len(ends) - 1, np.int64) for _ in tables]
    first = 0
    while first < len(ends) - 1:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + block, "right")) - 1)
        part, starts = data[ends[first] : ends[last]], ends[first:last] - ends[first]
        held = np.flatnonzero(np.diff(ends[first : last + 1]))  # texts without bytes have no place of their own
        for n, table in zip(counts, tables, strict=True):
            if last == first + 1:  # may be longer than a block
                n[first] = np.count_nonzero(table[part])
            elif len(held):
                n[first + held] = np.add.reduceat(table[part], starts[held], dtype=np.int64)
        first = last
    return counts


def ascii_shares(value: Column, classes: dict[str, str]) -> Column:
    """A struct of the share of characters in each class of ASCII signs (as in a regular expression); 0 when empty, null for null.

    The bytes of an Arrow batch are counted in blocks of texts, and a text has as many characters as bytes that don't
    continue one.
    """
    tables = np.array([[b < 128 and bool(re.match(f"[{c}]", chr(b))) for b in range(256)] for c in classes.values()] + [[b & 0xC0 != 0x80 for b in range(256)]])
    kind = pa.struct([(n, pa.float64()) for n in classes])

    @F.arrow_udf(f"struct<{', '.join(f'{n}: double' for n in classes)}>")
    def shares(values: pa.Array) -> pa.Array:
        held = values.cast(pa.large_binary())
        offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
        raw = held.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        counts = counts_between(data, offsets - offsets[0], tables)
        shown = [pa.array(n / np.maximum(1, counts[-1])) for n in counts[:-1]]
        return pa.StructArray.from_arrays(shown, fields=list(kind), mask=values.is_null())

    return shares(value)


def unique_share(value: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(value, ""), lambda x: x != ""))) / F.greatest(F.lit(1), F.char_length(value))


#: What a token looks like as a whole.
GRAMMARS = {
    "uuid_like": r"^[0-9a-fA-F]{8}-[0-9a-fA-F-]{27,36}$",
    "jwt_like": r"^[^.]+\.[^.]+\.[^.]+$",
    "etag_like": r'^(W/)?"[^\n]*"$',
    "encoded_token_like": r"^[A-Za-z0-9+/=_-]{16,}$",
}


def grammar_flags(value: Column) -> dict[str, Column]:
    return {name: value.rlike(pattern).cast("int") for name, pattern in GRAMMARS.items()}


def log_scale(value: Column, cap: float) -> Column:
    """log1p(x) / log1p(cap), kept between 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log1p(F.greatest(value, F.lit(0.0))) / F.log1p(F.lit(cap))))


def iso_micros(value: Column) -> Column:
    """Microseconds since 1970 of ISO-8601 text; ``Z`` and offsets count, text without a zone is UTC, anything else is null."""
    zoned = F.when(value.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), value).otherwise(F.concat(value, F.lit("Z")))
    return F.unix_micros(F.try_to_timestamp(zoned))


def decode_body(value: Column, most: int = 16_384) -> Column:
    """Base64 if it is, clipped to ``most`` bytes, as Latin-1; null for anything else."""
    return F.decode(F.substring(F.try_to_binary(value, F.lit("base64")), 1, most), "ISO-8859-1")


def bucket(value: Column, buckets: list[str], fallback: str = "other") -> Column:
    """The first of ``buckets`` that ``value`` holds, lower case."""
    out = None
    for b in buckets:
        hit = F.contains(F.lower(value), F.lit(b))
        out = F.when(hit, b) if out is None else out.when(hit, b)
    return out.otherwise(fallback)


def decimal_comma(columns: list[str]) -> list[Column]:
    """Strings with decimal commas as doubles; null where they aren't numbers."""
    return [F.expr(f"try_cast(replace(`{c}`, ',', '.') AS double)").alias(c) for c in columns]
