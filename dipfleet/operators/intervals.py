"""Joining points with the intervals that hold them: range buckets on both sides make it an equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipfleet.functions.series import KEYS
from dipfleet.functions.storage import checkpointed

#: Buckets that an interval is copied to at most, but for one at its end; longer ones go to wider buckets.
FANOUT = 64
#: Buckets that can each hold more than a so many-th of all points: no more than this are hot.
HOT = 10_000


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str] = KEYS, at: str = "i", start: str = "start_idx", end: str = "end_idx", width: int | None = None, hot_rows: int = 100_000) -> DataFrame:
    """Every pair of a point and an interval of its key with `start <= at <= end`: the columns of both, keys once.

    Positions are cut into buckets of `width` (by default the mean length of an interval, so that intervals are copied about
    twice); an interval is copied to each bucket it touches, a point lies in one, and both meet by key and bucket. An interval of
    more than `FANOUT` widths goes to a level of wider buckets, and points are copied once for each level in use: lengths of
    intervals decide the number of levels, some ten at most. Buckets with more than `hot_rows` points and more than a
    ten-thousandth of all (so at most 10,000 of them) are dealt into slices, and their intervals copied to each slice.

    Null keys or positions match nothing, nor do intervals that end before they start; repeated points and intervals give a
    row for each pair; intervals may overlap and share their ends. Columns of one name on both sides, but for keys, raise.
    """
    if clash := sorted((set(points.columns) & set(intervals.columns)) - set(keys)):
        raise ValueError(f"columns on both sides: {', '.join(clash)}")
    spans = intervals.where(F.col(start) <= F.col(end))
    shape = spans.agg(F.ceil(F.avg(F.col(end) - F.col(start) + 1)).cast("long").alias("mean"), F.max(F.col(end) - F.col(start) + 1).cast("long").alias("most")).first()
    width = max(1, width or shape["mean"] or 1)
    widths = [width]
    while widths[-1] * FANOUT < (shape["most"] or 0):
        widths.append(widths[-1] * FANOUT)
    bucket = lambda c, w: F.floor(F.col(c) / w).cast("long")
    length, level = F.col(end) - F.col(start) + 1, F.lit(0)
    for k in range(1, len(widths)):
        level = F.when(length > widths[k - 1] * FANOUT, k).otherwise(level)
    touched = F.lit(None).cast("array<bigint>")
    for k, w in enumerate(widths):
        touched = F.when(F.col("_level") == k, F.sequence(bucket(start, w), bucket(end, w))).otherwise(touched)
    spans = spans.withColumn("_level", level).withColumn("_bucket", F.explode(touched))
    places = F.array(*[F.struct(F.lit(k).alias("_level"), bucket(at, w).alias("_bucket")) for k, w in enumerate(widths)])
    placed = points.where(F.col(at).isNotNull()).withColumn("_place", F.explode(places)).withColumns({"_level": F.col("_place._level"), "_bucket": F.col("_place._bucket")}).drop("_place")
    by = [*keys, "_level", "_bucket"]
    counts = checkpointed(placed.groupBy(*by).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    least = max(hot_rows, total // HOT)
    hot = F.broadcast(counts.where(F.col("_n") > least).select(*by, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_slices")))
    slices = F.coalesce("_slices", F.lit(1))
    plain = [c for c, t in placed.dtypes if not t.startswith(("map", "variant"))]
    # the partition is hashed along, so that equal rows spread too
    dealt = placed.join(hot, by, "left").withColumn("_slice", F.pmod(F.xxhash64(F.spark_partition_id(), *plain), slices).cast("int")).drop("_slices")
    spans = spans.join(hot, by, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("_slices")
    joined = dealt.join(spans, [*by, "_slice"])
    return joined.where(F.col(at).between(F.col(start), F.col(end))).drop("_level", "_bucket", "_slice")


def dip_rows(samples: DataFrame, dips: DataFrame, keys: Sequence[str] = KEYS, **buckets) -> DataFrame:
    """The rows of every stored dip, both ends included, from a log read apart: samples with their position `i` and the
    columns of the dip (keys, `dip_id, start_idx, end_idx`, ...). Dips may share rows."""
    return interval_join(samples, dips, keys, "i", "start_idx", "end_idx", **buckets)
