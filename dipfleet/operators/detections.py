"""Detections of objects in video frames: filters, frame counts and track rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dipfleet.functions.params import CLASS_NAMES, MIN_CONFIDENCE, TrackParams
from dipfleet.functions.series import aspect_ratio, box_area, box_similarity, so_far

VIDEO = ("video_id",)


def filter_detections(detections: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Known classes above the confidence; both predicates reach the scan."""
    return detections.where(F.col("class_id").isin(*CLASS_NAMES) & (F.col("confidence") > min_confidence))


def class_name(class_id: str = "class_id") -> Column:
    return F.create_map(*[F.lit(x) for kv in CLASS_NAMES.items() for x in kv])[F.col(class_id)]


def truncated_boxes(detections: DataFrame) -> DataFrame:
    """Box corners as whole pixels, cut toward zero."""
    return detections.withColumns({c: F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")})


def roi_filter(detections: DataFrame, rois: DataFrame | None = None, keys: Sequence[str] = VIDEO, small: int = 100_000) -> DataFrame:
    """Boxes whose centre lies in a region of their video, edges included, each once; a video without a region keeps all.

    A video may have any number of regions, also overlapping ones. A grid indexes them: a region is copied to the cells that it
    touches, a centre lies in one, and both meet by video and cell. Cells are as wide as regions are on average; regions many
    times larger go to a level of wider cells. The index is broadcast if it has at most `small` rows, and else shuffled.
    Regions with a null or negative extent hold nothing; a box with a null corner is in none.
    """
    if rois is None:
        return detections
    places = rois.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")]).where("x is not null and y is not null and w >= 0 and h >= 0")
    shape = places.agg(F.avg(F.greatest("w", "h")).alias("mean"), F.max(F.greatest("w", "h")).alias("most")).first()
    sides = [max(shape["mean"] or 0.0, 1.0)]
    while sides[-1] * 16 < (shape["most"] or 0.0):
        sides.append(sides[-1] * 16)
    level = F.lit(0)
    for k in range(1, len(sides)):
        level = F.when(F.greatest("w", "h") > sides[k - 1] * 16, k).otherwise(level)
    side = F.element_at(F.array(*[F.lit(s) for s in sides]), F.col("_level") + 1)
    cell = lambda c: F.floor(c / side).cast("long")
    index = places.withColumn("_level", level).withColumn("_gx", F.explode(F.sequence(cell(F.col("x")), cell(F.col("x") + F.col("w")))))
    index = index.withColumn("_gy", F.explode(F.sequence(cell(F.col("y")), cell(F.col("y") + F.col("h")))))
    few = len(index.limit(small + 1).select("_level").take(small + 1)) <= small if small else False
    sized = F.broadcast if few else (lambda df: df)
    videos = rois.select(*keys).distinct()
    free = detections.join(sized(videos), list(keys), "left_anti")
    cx, cy = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
    rest, found = detections.withColumns({"_cx": cx, "_cy": cy}), []
    for k, s in enumerate(sides):  # a few: the sizes of regions decide
        of = index.where(F.col("_level") == k).select(*[F.col(c).alias(f"r_{c}") for c in (*keys, "_gx", "_gy", "x", "y", "w", "h")])
        placed = rest.withColumns({"_gx": F.floor(F.col("_cx") / s).cast("long"), "_gy": F.floor(F.col("_cy") / s).cast("long")})
        inside = F.col("_cx").between(F.col("r_x"), F.col("r_x") + F.col("r_w")) & F.col("_cy").between(F.col("r_y"), F.col("r_y") + F.col("r_h"))
        for c in (*keys, "_gx", "_gy"):
            inside = inside & (placed[c] == of[f"r_{c}"])
        found.append(placed.join(sized(of), inside, "left_semi").drop("_gx", "_gy"))
        rest = placed.join(sized(of), inside, "left_anti").drop("_gx", "_gy") if k + 1 < len(sides) else rest
    for hit in found:
        free = free.unionByName(hit.drop("_cx", "_cy"))
    return free


def frame_time(frames: DataFrame, fps: float, start_s: float = 0.0, total_frames: int | None = None) -> DataFrame:
    """Frames from the start second on, with their time; a start past the last frame gives nothing."""
    first = int(start_s * fps)
    if total_frames is not None and first >= total_frames:
        return frames.withColumn("time_seconds", F.lit(0.0)).limit(0)
    return frames.where(F.col("frame_number") >= first).withColumn("time_seconds", F.col("frame_number") / F.lit(float(fps)))


def consecutive_frame_similarity(detections: DataFrame, threshold: float = TrackParams.similarity, keys: Sequence[str] = VIDEO) -> DataFrame:
    """Pairs of boxes in neighbouring frames of a video whose similarity is over the threshold: an equi-join on the frame."""
    box = ["x1", "y1", "x2", "y2"]
    a = detections.select(*keys, "frame_number", "det_idx", *box)
    b = detections.select(*keys, (F.col("frame_number") - 1).alias("frame_number"), F.col("det_idx").alias("next_idx"), *[F.col(c).alias(f"b_{c}") for c in box])
    pairs = a.join(b, [*keys, "frame_number"]).withColumn("similarity", box_similarity([F.col(c) for c in box], [F.col(f"b_{c}") for c in box]))
    return pairs.where(F.col("similarity") > threshold).select(*keys, "frame_number", "det_idx", "next_idx", "similarity")


def frame_class_counts(detections: DataFrame, keys: Sequence[str] = VIDEO) -> DataFrame:
    """Detections per class and frame."""
    of = lambda k: F.count_if(F.col("class_id") == k)
    return detections.groupBy(*keys, "frame_number").agg(of(0).alias("people_in_frame"), of(1).alias("bicycles_in_frame"), of(2).alias("vehicles_in_frame"), F.count("*").alias("total_in_frame"))


def frame_timeline(counts: DataFrame, fps: float, keys: Sequence[str] = VIDEO) -> DataFrame:
    """A row for every frame up to the last of each video, zeros where nothing was seen."""
    frames = counts.groupBy(*keys).agg(F.max("frame_number").alias("_last")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last").cast("long"))).alias("frame_number"))
    joined = frames.join(counts, [*keys, "frame_number"], "left").na.fill(0, ["people_in_frame", "bicycles_in_frame", "vehicles_in_frame", "total_in_frame"])
    return joined.withColumn("time_seconds", F.col("frame_number") / F.lit(float(fps)))


def cumulative_counts(tracked: DataFrame, keys: Sequence[str] = VIDEO) -> DataFrame:
    """Per frame, the objects first counted there and the running totals per class."""
    new = lambda c: F.count_if(F.col("is_new") & c)
    per_frame = tracked.groupBy(*keys, "frame_number").agg(*[new(F.col("class_id") == k).alias(n) for k, n in ((0, "_p"), (1, "_b"), (2, "_v"))], new(F.lit(True)).alias("newly_counted_this_frame"))
    w = so_far(Window.partitionBy(*keys).orderBy("frame_number"))
    totals = {"total_people_counted": "_p", "total_bicycles_counted": "_b", "total_vehicles_counted": "_v", "total_objects_counted": "newly_counted_this_frame"}
    return per_frame.withColumns({k: F.sum(v).over(w) for k, v in totals.items()}).drop("_p", "_b", "_v")


def frame_table(tracked: DataFrame, fps: float, keys: Sequence[str] = VIDEO) -> DataFrame:
    """The frame table: a row for every frame up to the last of each video, with what is seen there per class, the objects first
    counted there, the running totals, and the detections themselves in order. One aggregation by frame and one window.

    `tracked` holds boxes with `class_id, confidence, det_idx, is_new`. Boxes of other classes count in the totals of a frame alone.
    """
    of, new = (lambda k: F.count_if(F.col("class_id") == k)), (lambda c: F.count_if(F.col("is_new") & c))
    boxes = F.sort_array(F.collect_list(F.struct("det_idx", class_name().alias("class"), "confidence", F.array("x1", "y1", "x2", "y2").alias("bbox"))))  # as many as one frame holds
    seen = F.transform(boxes, lambda b: F.struct(b["class"].alias("class"), b["confidence"].alias("confidence"), b["bbox"].alias("bbox")))
    names = {"people": 0, "bicycles": 1, "vehicles": 2}
    per = tracked.groupBy(*keys, "frame_number").agg(
        *[of(k).alias(f"{n}_in_frame") for n, k in names.items()], F.count("*").alias("total_in_frame"), *[new(F.col("class_id") == k).alias(f"_{n}") for n, k in names.items()],
        new(F.lit(True)).alias("newly_counted_this_frame"), seen.alias("detected_objects"),
    )
    frames = per.groupBy(*keys).agg(F.max("frame_number").alias("_last")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last").cast("long"))).alias("frame_number"))
    full = frames.join(per, [*keys, "frame_number"], "left").na.fill(0)
    full = full.withColumn("detected_objects", F.coalesce("detected_objects", F.array().cast(per.schema["detected_objects"].dataType)))
    run = so_far(Window.partitionBy(*keys).orderBy("frame_number"))
    totals = {f"total_{n}_counted": F.sum(f"_{n}").over(run) for n in names} | {"total_objects_counted": F.sum("newly_counted_this_frame").over(run)}
    out = full.withColumns({**totals, "time_seconds": F.col("frame_number") / F.lit(float(fps)), "total_detections": F.size("detected_objects").cast("long")})
    return out.select(
        *keys, "time_seconds", "frame_number", *[f"{n}_in_frame" for n in (*names, "total")], *[f"total_{n}_counted" for n in (*names, "objects")], "newly_counted_this_frame", "detected_objects", "total_detections"
    )


def visibility_stats(frames: DataFrame, keys: Sequence[str] = VIDEO) -> DataFrame:
    """Duration and frames; per class and for all objects: frames with any, percent, mean and most."""
    aggs = [F.max("time_seconds").alias("duration"), F.count("*").alias("frames")]
    for c in ("people", "bicycles", "vehicles", "total"):
        n = F.col(f"{c}_in_frame")
        aggs += [F.count_if(n > 0).alias(f"{c}_frames"), (F.count_if(n > 0) * 100.0 / F.count("*")).alias(f"{c}_percent"), F.avg(n).alias(f"{c}_mean"), F.max(n).alias(f"{c}_most")]
    if "total_objects_counted" in frames.columns:
        aggs += [F.max_by(f"total_{c}_counted", "frame_number").alias(f"final_{c}") for c in ("people", "bicycles", "vehicles", "objects")]
    return frames.groupBy(*keys).agg(*aggs)


def track_metrics(tracked: DataFrame, params: TrackParams = TrackParams(), keys: Sequence[str] = VIDEO, track: str = "object_id") -> DataFrame:  # noqa: B008
    """Duration, mean aspect ratio and relative spread of the areas of each track, with the verdict of each rule."""
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    area = box_area(*box).cast("double")
    stats = tracked.groupBy(*keys, track).agg(
        F.count("*").alias("boxes"), ((F.max("frame_number") - F.min("frame_number")) / F.lit(float(params.fps))).alias("duration_seconds"),
        F.avg(aspect_ratio(*box)).alias("mean_aspect"), F.when(F.avg(area) > 0, F.stddev_pop(area) / F.avg(area)).otherwise(0.0).alias("area_cv"),
    )
    return stats.withColumns({
        "valid_vehicle": F.coalesce((F.col("duration_seconds") >= params.vehicle_seconds) & F.col("mean_aspect").between(params.min_aspect, params.max_aspect) & ((F.col("boxes") <= 2) | (F.col("area_cv") <= params.max_area_cv)), F.lit(False)),
        "valid_person": F.col("duration_seconds") >= params.person_seconds,
        "valid_other": F.col("duration_seconds") > params.other_seconds,
    })
