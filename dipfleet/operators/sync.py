"""Aligning sensor and camera timelines: nearest and interpolating time joins as one sort, never a cross join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dipfleet.functions.series import KEYS, onwards, ordered, so_far

COUNTS = ("vehicles_in_frame", "people_in_frame", "bicycles_in_frame")


def filter_start_time(samples: DataFrame, start_ms: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows from `start_ms` on (all, if it is not positive), with `i` counted anew."""
    kept = samples.where(F.col("time_ms") >= start_ms) if start_ms > 0 else samples
    return kept.withColumn("i", F.row_number().over(ordered(keys)) - 1)


def start_at_exact_time(samples: DataFrame, starts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The first row whose time equals the key's `start_ms`; keys without one are left out."""
    return samples.join(starts, list(keys)).where("time_ms = start_ms").groupBy(*keys).agg(F.min("seq").alias("start_seq"), F.min("time_ms").alias("start_ms"))


def rebase_timeline(samples: DataFrame, starts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """From the start row on, seconds since the start; keys without a start give nothing."""
    joined = samples.join(starts.select(*keys, "start_seq", "start_ms"), list(keys)).where("seq >= start_seq")
    return joined.withColumn("time_seconds", ((F.col("time_ms") - F.col("start_ms")) / 1000.0).cast("double")).drop("start_seq", "start_ms")


def vehicle_times(frames: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return frames.where("vehicles_in_frame > 0").select(*keys, "time_seconds")


def nearest_depth_join(frames: DataFrame, samples: DataFrame, offset: float = 0.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each frame with the distance at the nearest sample time, if frame time + offset lies within the samples.

    Ties go to the earlier sample; of samples with equal times the first in order counts. Both timelines are united
    and sorted once per key: the neighbours are the last sample before and the first after.
    """
    points = samples.groupBy(*keys, "time_ms").agg(F.min_by("distance", "seq").alias("distance"))
    points = points.select(*keys, (F.col("time_ms") / 1000.0).cast("double").alias("tm"), F.lit(0).alias("kind"), F.struct((F.col("time_ms") / 1000.0).cast("double").alias("t"), F.col("distance").cast("double").alias("d")).alias("p"), F.lit(None).cast("struct<frame_number:bigint,time_seconds:double>").alias("f"))
    asked = frames.select(*keys, (F.col("time_seconds") + F.lit(offset)).alias("tm"), F.lit(1).alias("kind"), F.lit(None).cast("struct<t:double,d:double>").alias("p"), F.struct(F.col("frame_number").cast("long").alias("frame_number"), F.col("time_seconds").cast("double").alias("time_seconds")).alias("f"))
    both = points.unionByName(asked)
    w = Window.partitionBy(*keys)
    forth = w.orderBy("tm", "kind")
    # backwards in the same order: a sample at the frame's own time is found by the first window already
    both = both.withColumns({"a": F.last("p", ignorenulls=True).over(so_far(forth)), "b": F.first("p", ignorenulls=True).over(onwards(forth)), "_max": F.max("p.t").over(w)})
    pick = F.when(F.col("b").isNull() | (F.abs(F.col("a.t") - F.col("tm")) <= F.abs(F.col("b.t") - F.col("tm"))), F.col("a.d")).otherwise(F.col("b.d"))
    depth = F.when((F.col("tm") >= 0) & (F.col("tm") <= F.col("_max")), F.when(F.col("a").isNull(), F.col("b.d")).otherwise(pick))
    return both.where("kind = 1").select(*keys, "f.frame_number", "f.time_seconds", depth.alias("ultrawide_depth_m"))


def interpolate_counts_join(samples: DataFrame, frames: DataFrame, offset: float = 0.0, keys: Sequence[str] = KEYS, columns: Sequence[str] = COUNTS) -> DataFrame:
    """Every sample with the counts of the frames around it, linear in time; 0 outside the frames' range."""
    fields = [F.col(c).cast("double").alias(c) for c in columns]
    known_type = "struct<t:double," + ",".join(f"{c}:double" for c in columns) + ">"
    known = frames.select(*keys, F.col("time_seconds").cast("double").alias("tm"), F.lit(0).alias("kind"), F.struct(F.col("time_seconds").cast("double").alias("t"), *fields).alias("p"), F.lit(None).cast("struct<seq:bigint,time_ms:bigint,distance:double>").alias("s"))
    asked = samples.select(*keys, ((F.col("time_ms") / 1000.0).cast("double") - F.lit(offset)).alias("tm"), F.lit(1).alias("kind"), F.lit(None).cast(known_type).alias("p"), F.struct(F.col("seq").cast("long").alias("seq"), F.col("time_ms").cast("long").alias("time_ms"), F.col("distance").cast("double").alias("distance")).alias("s"))
    both = known.unionByName(asked)
    w = Window.partitionBy(*keys).orderBy("tm", "kind")
    both = both.withColumns({"a": F.last("p", ignorenulls=True).over(so_far(w)), "b": F.first("p", ignorenulls=True).over(onwards(w))})

    def value(c: str):  # at the last frame exactly there is no next one: its own value
        slope = (F.col(f"b.{c}") - F.col(f"a.{c}")) / (F.col("b.t") - F.col("a.t"))
        return F.when(F.col("a").isNull(), 0.0).when(F.col("a.t") == F.col("tm"), F.col(f"a.{c}")).when(F.col("b").isNull(), 0.0).otherwise(slope * (F.col("tm") - F.col("a.t")) + F.col(f"a.{c}")).alias(c)

    return both.where("kind = 1").select(*keys, "s.seq", "s.time_ms", "s.distance", *[value(c) for c in columns])


def clip_markers(times: DataFrame, lasts: DataFrame, offset: float = 0.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Detection times moved by the offset and kept within [0, last]; the colour group is the parity of the unclipped index."""
    index = F.row_number().over(Window.partitionBy(*keys).orderBy("time_seconds")) - 1
    moved = times.withColumn("color_group", (index % 2).cast("int")).withColumn("synced_time", F.col("time_seconds") + F.lit(offset))
    return moved.join(lasts, list(keys)).where("synced_time between 0 and last_seconds").select(*keys, "time_seconds", "synced_time", "color_group")


def offset_sweep(times: DataFrame, lasts: DataFrame, low: float, high: float, step: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Markers shown per candidate offset, on the grid low, low + step, ..., high.

    A marker at t is shown for the offsets in [-t, last - t]: it adds +1 at the first such grid point and -1 past the
    last, and counts are running sums. No grid is joined with the markers; offsets where the count stays the same are
    one row (`first_offset`, `offsets`, `shown`).
    """
    n = int(round((high - low) / step)) + 1
    joined = times.join(lasts, list(keys))
    first = F.greatest(F.ceil((-F.col("time_seconds") - F.lit(low)) / F.lit(step) - 1e-9), F.lit(0))
    past = F.least(F.floor((F.col("last_seconds") - F.col("time_seconds") - F.lit(low)) / F.lit(step) + 1e-9) + 1, F.lit(n))
    edges = joined.select(*keys, first.cast("long").alias("first"), past.cast("long").alias("past")).where("first < past")
    ends = edges.select(*keys, F.explode(F.array(F.struct(F.col("first").alias("g"), F.lit(1).alias("change")), F.struct(F.col("past").alias("g"), F.lit(-1).alias("change")))).alias("e")).select(*keys, "e.g", "e.change")
    ends = ends.groupBy(*keys, "g").agg(F.sum("change").alias("change")).where("change <> 0")
    w = Window.partitionBy(*keys).orderBy("g")
    runs = ends.withColumns({"shown": F.sum("change").over(so_far(w)), "next": F.lead("g").over(w)}).where("shown > 0")
    return runs.select(*keys, F.col("g").alias("first_step"), (F.lit(low) + F.col("g") * F.lit(step)).alias("first_offset"), (F.col("next") - F.col("g")).alias("offsets"), "shown")
