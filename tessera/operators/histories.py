"""Histories of snapshots: what changed from one to the next, for many entities at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes_by_entity(snapshots: DataFrame, entity: str, order: str, fields: list[str]) -> DataFrame:
    """``snapshots`` with ``state`` (initial, changed or same), ``changes`` (map of field to (from, to), as text) and ``digest``.

    Each snapshot is held against the one before of its own entity, so entities are independent and no window spans the
    table. Null counts as a value of its own; the first snapshot of an entity has no changes. The digest is that of the
    fields by name, so equal snapshots have equal ones.
    """
    own = Window.partitionBy(entity).orderBy(order)
    said = F.struct(*(F.col(f).cast("string").alias(f) for f in fields))
    held = snapshots.withColumns({"_now": said, "_was": F.lag(said).over(own)})
    each = F.array(*(F.struct(F.lit(f).alias("key"), F.struct(F.col(f"_was.{f}").alias("from"), F.col(f"_now.{f}").alias("to")).alias("value")) for f in fields))
    moved = F.map_from_entries(F.filter(each, lambda x: ~x["value"]["from"].eqNullSafe(x["value"]["to"])))
    first = F.col("_was").isNull()
    state = F.when(first, "initial").when(F.size(moved) == 0, "same").otherwise("changed")
    digest = F.sha2(F.concat_ws("|", *(F.concat(F.lit(f"{f}="), F.coalesce(F.col(f"_now.{f}"), F.lit(""))) for f in fields)), 256)
    return held.select(*snapshots.columns, state.alias("state"), F.when(~first, moved).alias("changes"), digest.alias("digest"))
