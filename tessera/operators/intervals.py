"""Attribution of timed rows to the intervals of their key, and what is computed of a session's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tessera.operators.ranges import running_sums

TOLERANCE_US = 100_000


def hot_key_pieces(points: DataFrame, parts: int) -> DataFrame | None:
    """(src, bounds) of the keys with more than a ``parts``-th of all rows of ``points(src, t)``: fewer than ``parts`` keys, with fewer than twice ``parts`` times to cut them at in all.

    None where no key is that large. A key is cut at quantiles of its own times, into as many pieces as its share of the rows asks for.
    """
    per = points.groupBy("src").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n")).first()[0] or 0
    hot = {r.src: -(-r.n * parts // total) for r in per.where(F.col("n") * parts > total).collect()}  # fewer than `parts` rows
    if not hot:
        return None
    spark, kind = points.sparkSession, points.schema["src"].dataType
    wanted = F.broadcast(spark.createDataFrame([(k, n) for k, n in hot.items()], StructType([StructField("_hot", kind), StructField("_n", LongType())])))
    rows = points.join(wanted, F.col("src").eqNullSafe(F.col("_hot"))).where("t is not null")
    sketch = F.percentile_approx("t", [n / parts for n in range(1, parts)], 20 * parts)
    cuts = {r._hot: (r._n, r.at) for r in rows.groupBy("_hot", "_n").agg(sketch.alias("at")).collect()}
    chosen = [(k, sorted({at[i * parts // n - 1] for i in range(1, n) if i * parts // n})) for k, (n, at) in cuts.items()]
    return spark.createDataFrame(chosen, StructType([StructField("src", kind), StructField("bounds", ArrayType(LongType()))]))


def attribute(probes: DataFrame, intervals: DataFrame, tolerance: int = TOLERANCE_US, parts: int | None = None) -> DataFrame:
    """``probes`` with ``session_id``: the interval with the latest start at or before the row, else the next one, if it holds the row within ``tolerance``.

    ``probes(src, ts_us, ...)``, ``intervals(src, session_id, start_us, end_us, ordinal)``. Of equal starts the later
    ordinal counts. Rows with a null key meet intervals with a null key.

    Rows and intervals are dealt once by key and sorted once; no pair of a row and an interval is ever formed. A key with
    more than a ``parts``-th of all rows (default: the shuffle partitions) is cut into ranges of its time. What a range
    needs of its neighbours, the last interval before it and the first one after, is carried over a table of one row per
    key and range, and stands in the range as its first and last row. Only rows of one key and instant stay together.
    """
    spark = probes.sparkSession
    parts = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    probes_at, intervals_at = probes.withColumn("t", F.col("ts_us").cast("long")), intervals.withColumn("t", F.col("start_us").cast("long"))
    cut = hot_key_pieces(probes_at.select("src", "t").unionByName(intervals_at.select("src", "t")), parts)
    if cut is None:
        ranged = lambda df: df.withColumn("_range", F.lit(0))
    else:
        small = F.broadcast(cut.withColumnRenamed("src", "_hot"))
        place = F.coalesce(F.size(F.filter("bounds", lambda x: x < F.col("t"))), F.lit(0))
        ranged = lambda df: df.join(small, F.col("src").eqNullSafe(F.col("_hot")), "left").withColumn("_range", F.when(F.col("bounds").isNull(), 0).otherwise(place)).drop("_hot", "bounds")
    held = F.struct("session_id", "start_us", "end_us")
    empty_row, empty_held = F.lit(None).cast(probes.select(F.struct(*probes.columns)).schema[0].dataType), F.lit(None).cast(intervals.select(held).schema[0].dataType)
    starts = ranged(intervals_at).select("src", "_range", "t", F.lit(0).alias("kind"), F.col("ordinal").cast("long").alias("ordinal"), held.alias("held"), empty_row.alias("row"))
    points = ranged(probes_at).select("src", "_range", "t", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("ordinal"), empty_held.alias("held"), F.struct(*probes.columns).alias("row"))
    every = starts.unionByName(points)
    if cut is not None:
        every = every.unionByName(_carried(starts, points, cut))
    order = Window.partitionBy("src", "_range").orderBy("t", "kind", "ordinal")
    before = F.last("held", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.expr("lead(held, 1) IGNORE NULLS OVER (PARTITION BY src, _range ORDER BY t, kind, ordinal)")
    fits = lambda h: (F.col("t") >= h["start_us"] - tolerance) & (F.col("t") <= h["end_us"] + tolerance)
    placed = every.withColumns({"before": before, "after": after}).where("kind = 1")
    return placed.select("row.*", F.when(fits(F.col("before")), F.col("before.session_id")).when(fits(F.col("after")), F.col("after.session_id")).alias("session_id"))


def _carried(starts: DataFrame, points: DataFrame, cut: DataFrame) -> DataFrame:
    """For each range of a cut key a row before all others with the last interval of earlier ranges, and one behind with the first of later ranges."""
    key = F.struct("t", "ordinal")
    ends = starts.where("t is not null").groupBy("src", "_range").agg(F.min_by("held", key).alias("first"), F.max_by("held", key).alias("last"))
    used = points.select("src", "_range").distinct()
    cut_only = used.join(F.broadcast(cut.select(F.col("src").alias("_hot"))), F.col("src").eqNullSafe(F.col("_hot")), "left_semi")
    none = F.lit(None).cast(starts.schema["held"].dataType)
    grid = ends.withColumn("asked", F.lit(0)).unionByName(cut_only.select("src", "_range", none.alias("first"), none.alias("last"), F.lit(1).alias("asked")))
    per = grid.groupBy("src", "_range").agg(F.max("first").alias("first"), F.max("last").alias("last"), F.max("asked").alias("asked"))
    earlier = Window.partitionBy("src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("src").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = per.withColumns({"b": F.last("last", ignorenulls=True).over(earlier), "a": F.last("first", ignorenulls=True).over(later)}).where("asked = 1")
    far = 2**63 - 1
    two = F.array(F.struct(F.lit(-far - 1).alias("t"), F.lit(-1).alias("kind"), F.col("b").alias("held")), F.struct(F.lit(far).alias("t"), F.lit(2).alias("kind"), F.col("a").alias("held")))
    long = carried.select("src", "_range", F.explode(two).alias("x")).where("x.held is not null")
    return long.select("src", "_range", F.col("x.t").alias("t"), F.col("x.kind").alias("kind"), F.lit(0).cast("long").alias("ordinal"), F.col("x.held").alias("held"), F.lit(None).cast(points.schema["row"].dataType).alias("row"))


def all_containing(probes: DataFrame, intervals: DataFrame, tolerance: int = TOLERANCE_US, width_us: int = 6 * 3600 * 1_000_000) -> DataFrame:
    """Every pair of a row and an interval of its key that holds it: a superset of ``attribute``.

    Time is cut into buckets of ``width_us``. An interval stands in each that it touches and a row in one, so a row meets
    only intervals near it, however many its key has.
    """
    bucket = lambda x: F.floor(x / width_us)
    low, high = F.col("start_us") - tolerance, F.col("end_us") + tolerance
    i = intervals.select("src", "session_id", low.alias("_low"), high.alias("_high"), F.explode(F.sequence(bucket(low), bucket(high))).alias("_bucket"))
    joined = probes.withColumn("_bucket", bucket(F.col("ts_us"))).join(i, ["src", "_bucket"])
    return joined.where(F.col("ts_us").between(F.col("_low"), F.col("_high"))).select(*probes.columns, "session_id")


def mapping_coverage(attributed: DataFrame) -> DataFrame:
    """Mapped rows, all rows, and their share (0 without rows)."""
    return attributed.agg(F.count("session_id").alias("mapped"), F.count("*").alias("total"), F.round(F.coalesce(F.avg(F.col("session_id").isNotNull().cast("double")), F.lit(0.0)), 6).alias("coverage"))


def packet_aggregates(attributed: DataFrame) -> DataFrame:
    """18 columns for each session that has rows, dealt by ``session_id``. Population deviation, nearest-rank p95."""
    order = Window.partitionBy("session_id").orderBy("ts_us", "rec")
    rows = attributed.where("session_id is not null").withColumn("gap", (F.col("ts_us") - F.lag("ts_us").over(order)) / 1e6)
    up, down = F.col("direction") > 0, F.col("direction") < 0
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    per = rows.groupBy("session_id").agg(
        F.count("*").alias("packet_count"), F.sum("size").alias("byte_count"), ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("duration"),
        F.avg("size").alias("size_mean"), F.stddev_pop("size").alias("size_std"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY size)").alias("size_p95"),
        zero(F.avg("gap")).alias("gap_mean"), zero(F.stddev_pop("gap")).alias("gap_std"),
        F.sum(F.when(up, F.col("size")).otherwise(0.0)).alias("up_bytes"), F.sum(F.when(down, F.col("size")).otherwise(0.0)).alias("down_bytes"),
        F.count_if(up).alias("up_packets"), F.count_if(down).alias("down_packets"),
        F.count_if(F.col("flow") == "click").alias("tcp_packets"), F.count_if(F.col("flow") == "view").alias("udp_packets"),
        F.count_if(F.col("flow") == "signup").alias("syn_packets"), F.count_if(F.col("flow") == "error").alias("rst_packets"),
    )
    return per.withColumns({"gap_cv": zero(F.try_divide("gap_std", "gap_mean")), "up_down_ratio": F.col("up_bytes") / F.greatest(F.col("down_bytes"), F.lit(1.0))})


PACKET_COUNTS = {"packet_count", "up_packets", "down_packets", "tcp_packets", "udp_packets", "syn_packets", "rst_packets"}


def packet_filled(columns: list[str]) -> list:
    """Columns of ``packet_aggregates`` with 0 where a session has no rows."""
    return [F.coalesce(c, F.lit(0)).cast("long").alias(c) if c in PACKET_COUNTS else F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in columns]


def packet_features(intervals: DataFrame, attributed: DataFrame) -> DataFrame:
    """``packet_aggregates`` of every session; those without rows have zeros."""
    per = packet_aggregates(attributed)
    return intervals.select("session_id").join(per, "session_id", "left").select("session_id", *packet_filled(per.columns[1:]))


def delta_t(attributed: DataFrame) -> DataFrame:
    """Seconds since the row before in arrival order, never below 0; 0 for the first."""
    order = Window.partitionBy("session_id").orderBy("rec")
    return attributed.where("session_id is not null").withColumn("delta_t", F.greatest(F.lit(0.0), F.coalesce((F.col("ts_us") - F.lag("ts_us").over(order)) / 1e6, F.lit(0.0))))


def first_of(df: DataFrame, keys: list[str], order: str, out: str, also=None) -> DataFrame:
    """Flag of the first row with its keys (or where ``also`` holds)."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    return df.withColumn(out, (first if also is None else first | also).cast("int"))


def seen_before(df: DataFrame, keys: list[str], order: str, out: str, only=None) -> DataFrame:
    """Flag of rows whose keys came before (where ``only`` holds)."""
    again = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) > 1
    return df.withColumn(out, (again if only is None else again & only).cast("int"))


def head_and_tail(df: DataFrame, by: str, order: str, most: int = 96) -> DataFrame:
    """The first and last halves of ``most`` rows of a group, with ``place`` from 1; whole groups if no longer."""
    w = Window.partitionBy(by)
    placed = df.withColumns({"place": F.row_number().over(w.orderBy(order)), "n": F.count("*").over(w)})
    return placed.where((F.col("n") <= most) | (F.col("place") <= most // 2) | (F.col("place") > F.col("n") - most // 2)).drop("n")


def zero_traffic(features: DataFrame, most: int = 500) -> DataFrame:
    """Ids of sessions without rows, the first ``most`` of them, and how many there are in all."""
    empty = features.where(F.coalesce("packet_count", F.lit(0)) <= 0)
    total = empty.agg(F.count("*").alias("n_zero"))
    return empty.select("session_id").orderBy("session_id").limit(most).join(F.broadcast(total))


def tail_guard(intervals: DataFrame, probes: DataFrame, slack_us: int = 50_000) -> DataFrame:
    """Does the capture reach the start of the latest session?"""
    last = probes.agg(F.max("ts_us").alias("last_packet_us"))
    start = intervals.agg(F.max("start_us").alias("latest_start_us"))
    return last.join(F.broadcast(start)).withColumn("passed", F.col("last_packet_us") + slack_us >= F.col("latest_start_us"))


def rank_with_consent(df: DataFrame, key: str, score: str, consent: str, quota: int) -> DataFrame:
    """Position by score, consenting rows above, the rank among those who consent, and the risk against a quota."""
    held = running_sums(df.select(key, score, consent), -F.col(score), [key], {"position": F.lit(1), "_with": F.col(consent).cast("long")})
    out = held.select(key, consent, F.col("position").cast("long").alias("position"), (F.col("_with") - F.col(consent).cast("long")).cast("long").alias("consents_above")).withColumn("consent_rank", F.col("consents_above") + 1)
    return out.withColumn("state", F.when(F.col("consent_rank") <= quota, "inside").when(F.col("consent_rank") <= 2 * quota, "near").otherwise("outside"))
