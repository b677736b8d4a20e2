"""One row per session out of many sources, what is missing of it and why, and rate tables as simple experts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What hides content, and protocols that the log parsers don't read.
HIDDEN, UNREAD = "opaque|encrypted|ech", ["h3", "http3", "quic", "webtransport", "masque"]


def assemble(manifest: DataFrame, key: str, *parts: DataFrame) -> DataFrame:
    """``manifest`` with the columns of ``parts`` (one row per key at most), left-joined.

    Each part is an aggregate by ``key`` and so dealt by it already: a source crosses the network by that key once, and
    no join deals it anew.
    """
    for part in parts:
        manifest = manifest.join(part, key, "left")
    return manifest


def status_columns(first_exit: Column, second_exit: Column, exported: Column, tail: Column, packets: Column) -> dict[str, Column]:
    """Flags of a session: both parsers ended well (no exit code is a failure), exported and whole (unless said otherwise), rows there."""
    ok = lambda code: F.coalesce((code == 0).cast("int"), F.lit(0))
    unless = lambda flag: F.coalesce(flag.cast("int"), F.lit(1))
    return {"first_parser_ok": ok(first_exit), "second_parser_ok": ok(second_exit), "exported": unless(exported), "tail_pass": unless(tail), "sequence_available": (F.coalesce(packets, F.lit(0)) > 0).cast("int")}


def visible() -> Column:
    """Can content of a session be seen at all?"""
    return ~(F.coalesce(F.lower("visibility").rlike(HIDDEN), F.lit(False)) | F.coalesce(F.col("inspection") == "bypass", F.lit(False)))


def missing_reasons() -> dict[str, Column]:
    """Flags of why a session lacks rows; ``missing_genuinely_absent`` where no reason holds."""
    any_rows = F.col("first_events") + F.col("second_events") > 0
    found = {
        "encrypted": ~visible(), "parser_unsupported": ~any_rows & F.lower("protocol").isin(UNREAD), "parser_failed": (F.col("first_parser_ok") == 0) | (F.col("second_parser_ok") == 0),
        "packet_loss": (F.col("expected_packets") > 0) & (F.col("packet_count") < F.col("expected_packets") * 0.98), "truncated": F.col("tail_pass") == 0, "not_exported": F.col("exported") == 0,
    }
    flags = {f"missing_{n}": F.coalesce(x, F.lit(False)).cast("int") for n, x in found.items()}
    return flags | {"missing_genuinely_absent": (sum(flags.values(), F.lit(0)) == 0).cast("int")}


def availability() -> dict[str, Column]:
    return {
        "available_encrypted": F.lower("visibility").rlike(HIDDEN).cast("int"), "available_bypassed": (F.col("inspection") == "bypass").cast("int"),
        "available_sni_hidden": (~F.lower("sni").isin("clear", "visible")).cast("int"), "available_parser_any": (F.col("first_events") + F.col("second_events") > 0).cast("int"),
    }


def rate_expert(train: DataFrame, rows: DataFrame, cells: list[str], label: str = "label") -> DataFrame:
    """``rows`` with ``p``: the share of positives, one of two added, among training rows of the same ``cells``; half where there is none."""
    rates = train.groupBy(*cells).agg(((F.sum(label) + 1.0) / (F.count("*") + 2.0)).alias("p"))
    return rows.join(rates, cells, "left").withColumn("p", F.coalesce("p", F.lit(0.5)))
