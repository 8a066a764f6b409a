"""Statistics and shape features of dips, from rows or from stored arrays, and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dipfleet.functions.params import DipParams
from dipfleet.functions.series import KEYS


def _shape(n: Column, height: Column, fill: Column, plateau: Column, params: DipParams) -> Column:
    """Fixed category names."""
    boxy, flat = fill > params.box_fill, plateau < params.flat_plateau
    return (
        F.when(n < 3, "Undefined")
        .when(height <= 0, "Noise")
        .when(boxy & flat, "Boxy_Flat (Likely Vehicle)")
        .when(boxy, "Boxy_Irregular")
        .when(flat, "Peaked_Flat")
        .otherwise("Peaked_Irregular (Likely Pedestrian/Bike)")
    )


def _shaped(dips: DataFrame, params: DipParams) -> DataFrame:
    """Height, fill factor, plateau variance and category from the columns of `dip_features`; 0 for dips too small."""
    height = F.when(F.col("frame_count") >= 3, F.col("max_depth") - F.col("min_depth")).otherwise(0.0)
    dips = dips.withColumn("dip_height", height)
    shaped = (F.col("frame_count") >= 3) & (F.col("dip_height") > 0)
    dips = dips.withColumn("fill_factor", F.when(shaped, (F.col("max_depth") - F.col("line_integral")) / F.col("dip_height")).otherwise(0.0))
    dips = dips.withColumn("plateau_variance", F.when(shaped, F.coalesce("_plateau", F.lit(0.0))).otherwise(0.0)).drop("_plateau")
    return dips.withColumn("shape_category", _shape(F.col("frame_count"), F.col("dip_height"), F.col("fill_factor"), F.col("plateau_variance"), params))


def dip_features(slices: DataFrame, params: DipParams = DipParams(), keys: Sequence[str] = KEYS, counts: bool = False) -> DataFrame:  # noqa: B008
    """One row of features per dip of `dip_slices`. With `counts`, also the mean counts per dip and what passed.

    Everything comes from windows and sums over rows clustered by key already; the array of a dip is not needed. Rows lie from the
    last to the first: sums in that order have the bits that the SQL's have, which decide a fill factor just at its bound.
    """
    dip = Window.partitionBy(*keys, "dip_id")
    path = dip.orderBy(F.desc("i"))
    d = F.col("distance").cast("double")
    rows = slices.withColumns({"_step": F.abs(d - F.lead(d).over(path)), "_n": F.count("*").over(dip), "_m": F.avg(d).over(dip)})
    rows = rows.withColumn("_k", F.col("_n") - F.row_number().over(path))
    middle = (F.col("_k") >= F.floor(F.col("_n") * 0.25)) & (F.col("_k") < F.floor(F.col("_n") * 0.75))
    ends = F.first(d).over(path.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) + F.last(d).over(path.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_ends", ends)
    n = F.count("*")
    aggs = [
        n.alias("frame_count"), F.min("i").alias("start_frame_idx"), F.max("i").alias("end_frame_idx"), (F.min("time_ms") / 1000.0).cast("double").alias("time_of_dip_seconds"), ((F.max("time_ms") - F.min("time_ms")) / 1000.0).cast("double").alias("dip_duration_seconds"),
        F.max(d).alias("max_depth"), F.min(d).alias("min_depth"), F.avg(d).alias("avg_depth"), F.var_pop(d).alias("depth_variance"), F.avg(F.pow(d - F.col("_m"), 4)).alias("depth_fourth_moment"),
        F.coalesce(F.avg("_step"), F.lit(0.0)).alias("avg_depth_gradient"), F.coalesce(F.max("_step"), F.lit(0.0)).alias("max_depth_gradient"),
        F.when(n >= 2, (F.sum(d) - F.first("_ends") / 2.0) / (n - 1)).otherwise(0.0).alias("line_integral"), F.var_pop(F.when(middle, d)).alias("_plateau"),
    ]
    if counts:
        aggs += [F.avg(f"{c}_in_frame").alias(f"avg_{c}") for c in ("vehicles", "bicycles", "people")]
        aggs.append(dip_object(F.max("vehicles_in_frame"), F.max("bicycles_in_frame"), F.max("people_in_frame")).alias("object"))
    return _shaped(rows.groupBy(*keys, "dip_id").agg(*aggs), params)


def dip_object(vehicles: Column, bicycles: Column, people: Column) -> Column:
    """What passed, by the largest counts during the dip: V before B before P, N for nothing."""
    return F.when(vehicles > 0, "V").when(bicycles > 0, "B").when(people > 0, "P").otherwise("N")


def dip_arrays(slices: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The depths of each dip in order; memory grows with the longest dip, so features do not depend on it."""
    packed = F.array_sort(F.collect_list(F.struct("i", F.col("distance").cast("double").alias("d"))))
    return slices.groupBy(*keys, "dip_id").agg(F.transform(packed, lambda x: x["d"]).alias("dip_array"))


def features_of_arrays(dips: DataFrame, array: str = "dip_array", params: DipParams = DipParams()) -> DataFrame:  # noqa: B008
    """The same features from stored arrays, in array functions, summed from the last to the first; an empty or null array gives zeros
    and 'Undefined'."""
    a = F.coalesce(F.col(array), F.array().cast("array<double>"))
    dips = dips.withColumn("_a", a).withColumn("frame_count", F.size("_a").cast("long"))
    a, n = F.col("_a"), F.col("frame_count")

    def total(x: Column) -> Column:
        return F.aggregate(F.reverse(x), F.lit(0.0), lambda s, v: s + v)

    dips = dips.withColumn("avg_depth", F.when(n > 0, total(a) / n))
    m = F.col("avg_depth")
    steps = F.transform(F.sequence(F.lit(1), n.cast("int") - 1), lambda k: F.abs(F.get(a, k) - F.get(a, k - 1)))
    dips = dips.withColumn("_steps", F.when(n >= 2, steps).otherwise(F.array().cast("array<double>")))
    low, high = F.floor(n * 0.25).cast("int"), F.floor(n * 0.75).cast("int")
    dips = dips.withColumn("_mid", F.when(high > low, F.slice(a, low + 1, high - low)).otherwise(F.array().cast("array<double>")))
    some, mid_mean = F.nullif(n.cast("double"), F.lit(0.0)), total(F.col("_mid")) / F.nullif(F.size("_mid").cast("double"), F.lit(0.0))
    dips = dips.withColumns({
        "max_depth": F.array_max(a), "min_depth": F.array_min(a),
        "depth_variance": F.coalesce(total(F.transform(a, lambda v: (v - m) * (v - m))) / some, F.lit(0.0)),
        "depth_fourth_moment": F.coalesce(total(F.transform(a, lambda v: F.pow(v - m, 4))) / some, F.lit(0.0)),
        "avg_depth_gradient": F.when(n >= 2, total(F.col("_steps")) / (n - 1)).otherwise(0.0),
        "max_depth_gradient": F.coalesce(F.array_max("_steps"), F.lit(0.0)),
        "line_integral": F.when(n >= 2, (total(a) - (F.get(a, F.lit(0)) + F.get(a, n.cast("int") - 1)) / 2.0) / (n - 1)).otherwise(0.0),
        "_midmean": mid_mean,
    })
    dips = dips.withColumn("_plateau", total(F.transform("_mid", lambda v: (v - F.col("_midmean")) * (v - F.col("_midmean")))) / F.nullif(F.size("_mid").cast("double"), F.lit(0.0)))
    return _shaped(dips, params).drop("_a", "_steps", "_mid", "_midmean")


def dip_summary(dips: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Overall and per-key summary in one pass (`rollup`); the overall row has null keys."""
    return dips.rollup(*keys).agg(
        F.count("*").alias("dips"), F.avg("dip_duration_seconds").alias("mean_duration"), F.avg("max_depth").alias("mean_max_depth"), F.avg("depth_variance").alias("mean_variance"),
        F.min("min_depth").alias("least_depth"), F.max("max_depth").alias("greatest_depth"), F.avg("avg_depth").alias("mean_depth"),
    )


def object_distribution(dips: DataFrame) -> DataFrame:
    """Dips and percent per object, most frequent first."""
    counts = dips.groupBy("object").agg(F.count("*").alias("dips"))
    return counts.withColumn("percent", F.col("dips") * 100.0 / F.sum("dips").over(Window.partitionBy())).orderBy(F.desc("dips"), "object")
