"""Windows and column expressions over ordered samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("sensor_id",)


def ordered(keys: Sequence[str] = KEYS, time: str = "time_ms", seq: str = "seq") -> WindowSpec:
    """One series per key, by time; `seq` makes equal times deterministic."""
    return Window.partitionBy(*keys).orderBy(time, seq)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def earlier(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def onwards(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.currentRow, Window.unboundedFollowing)


def is_below(distance: str | Column, line: float | Column) -> Column:
    """Null and NaN distances are not below any line."""
    return F.coalesce(F.col(distance) < line if isinstance(distance, str) else distance < line, F.lit(False))


def digits(value: Column, n: int = 6) -> Column:
    """Rounded; sums of doubles differ in their last bits with the order of their rows, and the nudge keeps those bits from deciding ties."""
    return F.round(value + 3e-8, n)


def positioned(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds `i`, the 0-based position in the series."""
    return samples.withColumn("i", F.row_number().over(ordered(keys)) - 1)


def numbered(df: DataFrame, group: str, bucket: Column, order: Sequence[str | Column], name: str) -> DataFrame:
    """Adds gapless numbers from 1 within each group, in `order`. No task sorts a group: `bucket` cuts it into stretches of the
    order, prefix sums of their counts say where each begins, and only stretches are sorted."""
    cut = df.withColumn("_bucket", bucket)
    counts = cut.groupBy(F.col(group).alias("_group"), F.col("_bucket").alias("_of")).agg(F.count("*").alias("_count"))
    before = Window.partitionBy("_group").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_group", "_of", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_base"))  # a row for each stretch
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    joined = cut.join(counts, cut[group].eqNullSafe(counts["_group"]) & cut["_bucket"].eqNullSafe(counts["_of"]))
    return joined.withColumn(name, F.col("_base") + F.row_number().over(inside)).drop("_bucket", "_group", "_of", "_base")


def box_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def aspect_ratio(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Width over height; null unless the height is positive."""
    return F.when(y2 - y1 > 0, (x2 - x1).cast("double") / (y2 - y1))


def box_similarity(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """0.4 x ratio of the areas + 0.6 x closeness of the centres, measured in mean box sizes up to two."""
    area_a, area_b = box_area(*a).cast("double"), box_area(*b).cast("double")
    ratio = F.when(F.greatest(area_a, area_b) > 0, F.least(area_a, area_b) / F.greatest(area_a, area_b)).otherwise(0.0)
    dx, dy = (a[0] + a[2]) / 2.0 - (b[0] + b[2]) / 2.0, (a[1] + a[3]) / 2.0 - (b[1] + b[3]) / 2.0
    size = F.sqrt((area_a + area_b) / 2.0)
    close = F.when(size > 0, F.greatest(F.lit(0.0), 1.0 - F.sqrt(dx * dx + dy * dy) / size / 2.0)).otherwise(0.0)
    return ratio * 0.4 + close * 0.6
