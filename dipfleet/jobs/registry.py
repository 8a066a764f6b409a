"""Every registered query of the sensor library, with the SQL it is held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dipfleet.functions.params import FEATURES, CompactParams, DipParams, EventParams, LiveParams, TrackParams
from dipfleet.functions.series import digits, numbered, positioned
from dipfleet.functions.storage import checkpointed
from dipfleet.functions.storage import fresh_folder as _folder
from dipfleet.jobs import files as file_jobs
from dipfleet.jobs import oracles
from dipfleet.jobs.adaptors import FPS, RETENTION, detections, frames, sensor
from dipfleet.operators import detections as det
from dipfleet.operators import features as feat
from dipfleet.operators import intervals, longseries, models, segment, sync, tracking, trees
from dipfleet.sources import devicelog, files
from dipfleet.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES = oracles.ORACLES

DIPS, EVENTS = DipParams(), EventParams()
LIVE, COMPACT = LiveParams(calibration_ms=3_000), CompactParams(calibration_samples=10)
TRACKS = TrackParams(fps=FPS, retention_frames=RETENTION)
FOLD_FOREST = trees.TreeParams(depth=5, min_leaf=3, tried=3, trees=10)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: digits(F.col(c)) for c in names})


# --- timelines -------------------------------------------------------------------------------------------------------


@query
def filter_start_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.filter_start_time(sensor(spark, sf_dir), 5_000).select("sensor_id", "seq", "time_ms", "distance", F.col("i").cast("long").alias("i"))


def _starts(samples: DataFrame) -> DataFrame:
    """The time of each sensor's sixth sample, as the time that an operator looked up."""
    return samples.where("seq = 5").select("sensor_id", F.col("time_ms").alias("start_ms"))


@query
def start_at_exact_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = sensor(spark, sf_dir)
    return sync.start_at_exact_time(samples, _starts(samples))


@query
def rebase_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = sensor(spark, sf_dir)
    return sync.rebase_timeline(samples, sync.start_at_exact_time(samples, _starts(samples))).select("sensor_id", "seq", "time_seconds", "distance")


@query
def vehicle_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.vehicle_times(frames(spark, sf_dir))


@query
def nearest_depth_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.nearest_depth_join(frames(spark, sf_dir), sensor(spark, sf_dir), 0.1)


def _with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.interpolate_counts_join(sensor(spark, sf_dir), frames(spark, sf_dir), 0.1)


@query
def interpolate_counts_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_with_counts(spark, sf_dir), *sync.COUNTS)


def _lasts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("sensor_id").agg((F.max("time_ms") / 1000.0).cast("double").alias("last_seconds"))


@query
def clip_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.clip_markers(sync.vehicle_times(frames(spark, sf_dir)), _lasts(sensor(spark, sf_dir)), -2.5)


@query
def offset_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers shown over all sensors for each offset from -30 to 30 s in steps of 0.5."""
    runs = sync.offset_sweep(sync.vehicle_times(frames(spark, sf_dir)), _lasts(sensor(spark, sf_dir)), -30.0, 30.0, 0.5)
    steps = runs.select(F.explode(F.sequence(F.col("first_step"), F.col("first_step") + F.col("offsets") - 1)).alias("step"), "shown")
    return steps.groupBy("step").agg(F.sum("shown").alias("shown"), F.count("*").alias("sensors"))


# --- segmentation ----------------------------------------------------------------------------------------------------


@query
def raw_dips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.raw_dips(sensor(spark, sf_dir), DIPS.baseline)


@query
def merged_dips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.merge_dips(segment.raw_dips(sensor(spark, sf_dir), DIPS.baseline), DIPS.merge_gap_ms)


@query
def filtered_dips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.filter_short_dips(segment.merge_dips(segment.raw_dips(sensor(spark, sf_dir), DIPS.baseline), DIPS.merge_gap_ms), DIPS.min_duration_ms)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.event_stats(segment.segment_events(sensor(spark, sf_dir), EVENTS))


@query
def segment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_events(spark, sf_dir), "variance", "avg_gradient")


@query
def gate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segment.gate_events(_events(spark, sf_dir), EVENTS), "variance", "avg_gradient")


@query
def classify_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.classify_events(segment.gate_events(_events(spark, sf_dir), EVENTS), EVENTS).select("sensor_id", "event_id", "time_ms", "duration", "min_depth", "type")


@query
def event_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.event_report(segment.classify_events(segment.gate_events(_events(spark, sf_dir), EVENTS), EVENTS))


#: Buckets of the long forms, in milliseconds: some fifteen to a sensor on this data.
BUCKET_MS = 2_000


@query
def long_dips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `filtered_dips` gives, without a window over a whole sensor."""
    raw = longseries.long_raw_dips(sensor(spark, sf_dir), DIPS.baseline, bucket_ms=BUCKET_MS)
    return segment.filter_short_dips(longseries.long_merge_dips(raw, DIPS.merge_gap_ms, bucket_ms=4 * BUCKET_MS), DIPS.min_duration_ms)


@query
def long_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `segment_events` gives, without a window over a whole sensor."""
    return rounded(longseries.long_events(sensor(spark, sf_dir), EVENTS, bucket_ms=BUCKET_MS), "variance", "avg_gradient")


@query
def long_events_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `segment_events_live` gives, without a window over a whole sensor."""
    return rounded(longseries.long_events(sensor(spark, sf_dir), LIVE, bucket_ms=BUCKET_MS), "variance", "avg_gradient")


@query
def dip_slice_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of a log in each dip of a table that was stored apart; raw dips share their boundary rows."""
    folder = _folder(spark)
    samples = sensor(spark, sf_dir)
    files.write_table(segment.raw_dips(samples, DIPS.baseline), f"{folder}/dips")
    files.write_sensor_log(samples, f"{folder}/log")
    log = positioned(files.read_sensor_log(spark, f"{folder}/log")).withColumn("sensor_id", F.col("sensor_id").cast("long"))
    joined = intervals.dip_rows(checkpointed(log), spark.read.parquet(f"{folder}/dips"))
    return joined.select("sensor_id", "dip_id", F.col("i").cast("long").alias("i"), "time_ms", "distance")


@query
def segment_events_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segment.event_stats(segment.segment_events_live(sensor(spark, sf_dir), LIVE)), "variance", "avg_gradient")


@query
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dips approximated by sessions of samples below the line."""
    return rounded(segment.session_events(sensor(spark, sf_dir).where("time_ms >= 0"), DIPS.baseline, DIPS.merge_gap_ms), "variance")


@query
def session_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors by how many merged dips they have, and how many sessions."""
    samples = sensor(spark, sf_dir).where("time_ms >= 0")
    dips = segment.merge_dips(segment.raw_dips(samples, DIPS.baseline), DIPS.merge_gap_ms).groupBy("sensor_id").agg(F.count("*").alias("dips"))
    sessions = segment.session_events(samples, DIPS.baseline, DIPS.merge_gap_ms).groupBy("sensor_id").agg(F.count("*").alias("sessions"))
    return dips.join(sessions, "sensor_id").groupBy("dips", "sessions").agg(F.count("*").alias("sensors"))


@query
def segment_events_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A buffer of five samples, so that overflows happen on this data."""
    return rounded(segment.segment_events_compact(sensor(spark, sf_dir), CompactParams(capacity=5), line=215.0), "variance")


@query
def longest_stretch_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.longest_stretch_start(sensor(spark, sf_dir))


@query
def calibrate_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.calibrate_mode(sensor(spark, sf_dir), LIVE)


@query
def calibrate_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(segment.calibrate_mean(sensor(spark, sf_dir), COMPACT), "baseline")


@query
def live_events_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `live_detector` gives live, by windows."""
    events = segment.live_events(sensor(spark, sf_dir), LIVE)
    return rounded(events, "variance", "avg_gradient").select("sensor_id", "time_ms", "samples", "duration", "min_depth", "variance", "avg_gradient", "baseline", "type")


# --- features --------------------------------------------------------------------------------------------------------


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.dip_slices(_with_counts(spark, sf_dir), DIPS)


def _dips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.dip_features(_slices(spark, sf_dir), DIPS, counts=True)


@query
def dip_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.dip_slices(sensor(spark, sf_dir), DIPS).select("sensor_id", "dip_id", "i", "time_ms", "distance")


@query
def dip_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["frame_count", "start_frame_idx", "end_frame_idx", "time_of_dip_seconds", "dip_duration_seconds", "max_depth", "min_depth"]
    sums = ["avg_depth", "depth_variance", "avg_depth_gradient", "max_depth_gradient", "line_integral"]
    plain = feat.dip_features(segment.dip_slices(sensor(spark, sf_dir), DIPS), DIPS)
    return rounded(plain, *sums).select("sensor_id", "dip_id", *columns, *sums, F.round(F.col("depth_fourth_moment") + 3e-4, 2).alias("depth_fourth_moment"))


@query
def dip_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = feat.dip_features(segment.dip_slices(sensor(spark, sf_dir), DIPS), DIPS)
    return rounded(plain, "dip_height", "fill_factor", "plateau_variance").select("sensor_id", "dip_id", "dip_height", "fill_factor", "plateau_variance", "shape_category")


@query
def dip_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_dips(spark, sf_dir), "avg_vehicles", "avg_bicycles", "avg_people").select("sensor_id", "dip_id", "object", "avg_vehicles", "avg_bicycles", "avg_people")


@query
def dip_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths in whole hundredths, as text."""
    arrays = feat.dip_arrays(segment.dip_slices(sensor(spark, sf_dir), DIPS))
    return arrays.select("sensor_id", "dip_id", F.array_join(F.transform("dip_array", lambda d: F.round(d * 100).cast("long").cast("string")), ",").alias("depths"))


@query
def array_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features again, from the arrays alone."""
    columns = ["avg_depth", "depth_variance", "avg_depth_gradient", "line_integral", "plateau_variance"]
    arrays = feat.features_of_arrays(feat.dip_arrays(segment.dip_slices(sensor(spark, sf_dir), DIPS)))
    return rounded(arrays, *columns).select("sensor_id", "dip_id", "frame_count", *columns, "shape_category")


@query
def dip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = feat.dip_features(segment.dip_slices(sensor(spark, sf_dir), DIPS), DIPS)
    return rounded(feat.dip_summary(plain), "mean_duration", "mean_max_depth", "mean_variance", "mean_depth")


@query
def object_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feat.object_distribution(_dips(spark, sf_dir)), "percent")


# --- detections ------------------------------------------------------------------------------------------------------


@query
def filter_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = det.truncated_boxes(det.filter_detections(detections(spark, sf_dir))).withColumn("class", det.class_name())
    return rounded(named, "confidence").select("video_id", "frame_number", "det_idx", "class", "confidence", "x1", "y1", "x2", "y2")


@query
def roi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second video has a region."""
    boxes = det.filter_detections(detections(spark, sf_dir))
    rois = boxes.where("video_id % 2 = 0").select("video_id").distinct().selectExpr("video_id", "150 as x", "0 as y", "400 as w", "400 as h")
    return det.roi_filter(boxes, rois).select("video_id", "frame_number", "det_idx", "class_id", "x1", "y1", "x2", "y2")


@query
def roi_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two videos of three have three regions each, of which two overlap."""
    boxes = det.filter_detections(detections(spark, sf_dir))
    rois = boxes.where("video_id % 3 <> 0").select("video_id").distinct().selectExpr("video_id", "stack(3, 150, 0, 200, 400, 300, 100, 200, 27, 640, 0, 30, 1000) as (x, y, w, h)")
    return det.roi_filter(boxes, rois).select("video_id", "frame_number", "det_idx", "class_id", "x1", "y1", "x2", "y2")


@query
def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from the tenth second of a video on, with their time; a video that is over by then has none."""
    table = det.frame_timeline(det.frame_class_counts(det.filter_detections(detections(spark, sf_dir))), FPS).drop("time_seconds")
    return det.frame_time(table, FPS, start_s=10.3).select("video_id", "frame_number", "time_seconds", "total_in_frame")


@query
def box_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(det.consecutive_frame_similarity(det.filter_detections(detections(spark, sf_dir))), "similarity")


@query
def frame_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.frame_class_counts(det.filter_detections(detections(spark, sf_dir)))


@query
def frame_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.frame_timeline(det.frame_class_counts(det.filter_detections(detections(spark, sf_dir))), FPS)


def _lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections tracked by their lane; new where a lane is first seen."""
    boxes = det.filter_detections(detections(spark, sf_dir))
    first = F.row_number().over(Window.partitionBy("video_id", "lane").orderBy("frame_number", "det_idx")) == 1
    return boxes.withColumn("is_new", first)


@query
def cumulative_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.cumulative_counts(_lanes(spark, sf_dir))


@query
def visibility_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = det.visibility_stats(det.frame_table(_lanes(spark, sf_dir), FPS))
    return rounded(stats, *[f"{c}_{x}" for c in ("people", "bicycles", "vehicles", "total") for x in ("percent", "mean")])


def _as_text(frames: DataFrame) -> DataFrame:
    """The detections of a frame as text: class, confidence in millionths, corners."""
    one = lambda d: F.concat_ws(" ", d["class"], F.round(d["confidence"] * 1e6).cast("long").cast("string"), F.array_join(F.transform(d["bbox"], lambda x: x.cast("string")), ","))
    return frames.withColumn("detected_objects", F.array_join(F.transform("detected_objects", one), ";"))


@query
def frame_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(det.frame_table(_lanes(spark, sf_dir), FPS))


@query
def track_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = det.track_metrics(det.filter_detections(detections(spark, sf_dir)), TRACKS, track="lane")
    return rounded(metrics, "mean_aspect", "area_cv")


@query
def valid_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_metrics(spark, sf_dir).where("valid_vehicle").select("video_id", "lane", "boxes", "duration_seconds")


@query
def valid_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_metrics(spark, sf_dir).where("valid_person").select("video_id", "lane", "boxes", "duration_seconds")


@query
def track_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.track_objects(det.filter_detections(detections(spark, sf_dir)), TRACKS)


@query
def track_objects_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `track_objects` gives, by parts of a video that cannot reach each other."""
    return tracking.track_crowded(det.filter_detections(detections(spark, sf_dir)), TRACKS)


# --- models ----------------------------------------------------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.fill_missing_features(models.label_is_vehicle(_dips(spark, sf_dir)))


@query
def label_fill_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_labelled(spark, sf_dir), *FEATURES).select("sensor_id", "dip_id", "is_vehicle", *FEATURES)


@query
def rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.rule_score(_labelled(spark, sf_dir)).select("sensor_id", "dip_id", "rule_variance", "rule_gradient")


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.stratified_split(_labelled(spark, sf_dir), ["sensor_id", "dip_id"]).select("sensor_id", "dip_id", "is_vehicle", "in_train", "in_test")


@query
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = models.rule_score(_labelled(spark, sf_dir))
    return rounded(models.classification_report(scored, prediction="rule_variance"), "precision", "recall", "f1", "support")


def _labelled_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled dips with what the models take of them, computed once: splits and fits pass over them many times."""
    return checkpointed(_labelled(spark, sf_dir).select("sensor_id", "dip_id", "is_vehicle", *FEATURES))


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.assemble_features(_labelled_once(spark, sf_dir))


def _shuffled() -> dict:
    """A hashed order of the dips, in 4,096 stretches."""
    h = models.hashed("sensor_id", "dip_id")
    return {"order": [h, "sensor_id", "dip_id"], "stretch": F.shiftright(h, 52)}


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.assemble_features(checkpointed(models.stratified_split(_labelled_once(spark, sf_dir), **_shuffled())))


@query
def score_dips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest, trained on 70 %, on all dips."""
    split = _split(spark, sf_dir)
    scored = models.score_dips(models.train_random_forest(split.where("in_train")), split)
    return scored.select("sensor_id", "dip_id", "is_vehicle", "in_test", "ml_vehicle_prob", "ml_prediction", "ml_prediction_label")


@query
def cross_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.cross_validate(_assembled(spark, sf_dir), **_shuffled())


@query
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.feature_importance(models.train_random_forest(_split(spark, sf_dir).where("in_train")), spark)


@query
def tree_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.tree_rules(models.train_decision_tree(_split(spark, sf_dir).where("in_train")), spark)


def _split_dips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled dips, features to six digits, split by their ids; computed once."""
    rows = rounded(_labelled_once(spark, sf_dir), *FEATURES)
    return checkpointed(models.stratified_split(rows, ["sensor_id", "dip_id"]))


def _trees(split: DataFrame, params: trees.TreeParams) -> DataFrame:
    return checkpointed(trees.train_trees(trees.bagged(split.where("in_train"), params, ["sensor_id", "dip_id"]), params))


@query
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of an exact decision tree, trained on 70 %, with their conditions in words."""
    return rounded(trees.rules(_trees(_split_dips(spark, sf_dir), trees.TREE)), "threshold", "gain").drop("model", "path")


@query
def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact forest, trained on 70 %, as columns over all dips."""
    split = _split_dips(spark, sf_dir)
    scored = trees.score_by_columns(split, _trees(split, trees.FOREST))
    return rounded(scored, "ml_vehicle_prob").select("sensor_id", "dip_id", "is_vehicle", "in_test", "ml_vehicle_prob", "ml_prediction", "ml_prediction_label")


@query
def forest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the forest on the held-out part."""
    split = _split_dips(spark, sf_dir)
    scored = trees.score_by_columns(split.where("in_test"), _trees(split, trees.FOREST))
    return rounded(models.classification_report(scored, prediction="ml_prediction"), "precision", "recall", "f1", "support")


@query
def forest_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trees.importances(_trees(_split_dips(spark, sf_dir), trees.FOREST)), "importance")


@query
def forest_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five stratified folds of ten trees each, all grown together."""
    rows = rounded(_labelled_once(spark, sf_dir), *FEATURES)
    dealt = numbered(rows, "is_vehicle", F.col("sensor_id"), ["sensor_id", "dip_id"], "_n").withColumn("fold", F.pmod("_n", F.lit(5)).cast("int")).drop("_n")
    return rounded(trees.cross_validated(checkpointed(dealt), ["sensor_id", "dip_id"], FOLD_FOREST), "accuracy", "mean_accuracy", "two_std")


# --- streams ---------------------------------------------------------------------------------------------------------


#: Arrivals that a feed is cut into, and files of each at least; a micro-batch reads so many files, of one arrival or two.
ARRIVALS, FILES = 4, 4
#: Rows that a file of detections holds at most, about: larger arrivals have more files, which as many tasks write and read.
FILE_ROWS = 250_000
#: Rows of a bundle of videos in all arrivals, about.
BUNDLE_ROWS = 50_000
#: Milliseconds of a sensor's time in an arrival, and how much later than in order a sample may arrive.
STRETCH, JITTER = 31_000 // ARRIVALS, 1_500
FOREVER = 10**12


def _arriving(table: DataFrame, part: Column, folder: str, arrivals: int = ARRIVALS, files_each: int = FILES) -> str:
    """A table as files that arrive one arrival after the other. It is computed once."""
    spark = table.sparkSession
    table.withColumn("_part", F.greatest(F.least(part, F.lit(arrivals - 1)), F.lit(0))).write.parquet(f"{folder}/all")
    for k in range(arrivals):
        spark.read.parquet(f"{folder}/all").where(F.col("_part") == k).drop("_part").repartition(files_each).write.parquet(f"{folder}/in/part={k}")
    return f"{folder}/in/*"


def _delayed(*columns: str) -> Column:
    """Milliseconds that a row arrives late by, from 0 to JITTER."""
    return F.pmod(F.xxhash64(*columns), F.lit(JITTER))


def _feed(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The sensor table as arrivals out of order, with a trigger per sensor; at last a row of a sensor of its own moves the
    watermark past all. A micro-batch may hold files of two arrivals, so rows may be a stretch and their own delay behind."""
    samples = sensor(spark, sf_dir)
    feed = live.with_triggers(samples, samples.groupBy("sensor_id").agg(F.min("time_ms").alias("time_ms")))
    feed = feed.unionByName(spark.createDataFrame([(-1, -1, FOREVER, 0.0, live.TRIGGER)], feed.schema))
    part = F.when(F.col("time_ms") == FOREVER, ARRIVALS).otherwise(F.least(F.floor((F.col("time_ms") + _delayed("sensor_id", "seq")) / STRETCH), F.lit(ARRIVALS - 1)).cast("int"))
    path = _arriving(feed, part, folder, ARRIVALS + 1)
    return live.reordered(live.sample_feed(spark, path, files_per_batch=FILES), STRETCH + JITTER)


def _boxes_arrivals(spark: SparkSession, sf_dir: str, folder: str, closing: bool, jitter: int, ranked: bool = True) -> tuple[DataFrame, int, int]:
    """Detections as arrivals, each a stretch of frames, and rows up to `jitter` frames late, so that arrivals cut through frames;
    by how many milliseconds a row may be behind; and the number of rows. A closing row without a video, long after all, moves the watermark on. If not `ranked`,
    detections have no `det_idx`, which takes a sort of them all, and only the columns that are counted."""
    boxes = det.filter_detections(detections(spark, sf_dir)).withColumn("at", F.timestamp_seconds(F.col("frame_number") / FPS))
    most, rows = boxes.agg(F.max("frame_number"), F.count("*")).first()
    most, files_each = most or 0, FILES * max(1, -(-rows // (ARRIVALS * FILES * FILE_ROWS)))
    late = F.pmod(F.xxhash64("video_id", "frame_number", *(["det_idx"] if ranked else ["lane", "class_id", "x1", "y1"])), F.lit(jitter + 1))
    boxes = boxes.select("video_id", "frame_number", "class_id", "at", *["det_idx", "x1", "y1", "x2", "y2"] * ranked, late.alias("_late"))
    if closing:
        last = spark.range(1).select(F.lit(FOREVER).alias("frame_number"), F.timestamp_seconds(F.lit(4e9)).alias("at"))
        boxes = boxes.unionByName(last, allowMissingColumns=True)
    part = F.when(F.col("frame_number") == FOREVER, ARRIVALS).otherwise(F.least(F.floor((F.col("frame_number") + F.col("_late")) * ARRIVALS / (most + 1)), F.lit(ARRIVALS - 1)).cast("int"))
    path = _arriving(boxes, part, folder, ARRIVALS + closing, files_each)
    # a micro-batch may hold files of two arrivals
    return spark.readStream.schema(boxes.drop("_late").schema).option("maxFilesPerTrigger", files_each).parquet(path), int((most / ARRIVALS + jitter + 2) * 1000 / FPS), rows


def _boxes_feed(spark: SparkSession, sf_dir: str, folder: str, closing: bool = False) -> DataFrame:
    return _boxes_arrivals(spark, sf_dir, folder, closing, 0)[0]


@query
def live_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    live.use_rocksdb(spark)
    folder = _folder(spark)
    events = live.on_time(live.run_to_end(live.live_detector(_feed(spark, sf_dir, folder), LIVE), folder))
    return rounded(events, "variance", "avg_gradient").drop("close_ms")


@query
def compact_live_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    live.use_rocksdb(spark)
    folder = _folder(spark)
    return rounded(live.on_time(live.run_to_end(live.compact_live_detector(_feed(spark, sf_dir, folder), COMPACT), folder)), "variance")


@query
def late_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late samples of each sensor: every fiftieth comes after all others, and is late if later ones of its sensor were stepped by
    then, which are those more than the allowed delay behind the newest."""
    live.use_rocksdb(spark)
    folder, samples = _folder(spark), sensor(spark, sf_dir).withColumn("kind", F.lit(live.SAMPLE))
    samples = samples.unionByName(spark.createDataFrame([(-1, 0, 10**8, 0.0, live.SAMPLE)], samples.schema))
    part = F.when(F.col("sensor_id") == -1, 1).when(F.col("seq") % 50 == 7, 2).otherwise(0)
    feed = live.sample_feed(spark, _arriving(samples, part, folder, 3, 1))
    return live.late_counts(live.run_to_end(live.compact_live_detector(live.reordered(feed, JITTER, grace_ms=2 * 10**8), COMPACT), folder))


@query
def track_objects_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `track_objects` gives, live, from detections out of order and frames in pieces."""
    live.use_rocksdb(spark)
    folder = _folder(spark)
    feed, delay, rows = _boxes_arrivals(spark, sf_dir, folder, True, 3)
    boxes = live.reordered(feed, delay, F.unix_millis("at"))
    return live.on_time(live.run_to_end(live.track_objects_live(boxes, TRACKS, max(256, rows // BUNDLE_ROWS)), folder))


@query
def frame_counts_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `frame_class_counts` gives, live."""
    live.use_rocksdb(spark)
    folder = _folder(spark)
    feed, delay, _ = _boxes_arrivals(spark, sf_dir, folder, True, 3, ranked=False)
    return live.run_to_end(live.frame_counts_live(feed, "at", f"{delay} milliseconds"), folder).where("video_id is not null")


# --- files -----------------------------------------------------------------------------------------------------------


@query
def sensor_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sensor table written as logs and read again."""
    folder = _folder(spark)
    files.write_sensor_log(sensor(spark, sf_dir), folder)
    return files.read_sensor_log(spark, folder)


@query
def lenient_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with blanks for commas and with lines that hold no sample."""
    folder = _folder(spark)
    samples = sensor(spark, sf_dir)
    line = F.concat(F.col("time_ms").cast("string"), F.when(F.col("seq") % 2 == 0, " ").otherwise(" , "), F.col("distance").cast("string"))
    lines = samples.select("sensor_id", "time_ms", "seq", F.posexplode(F.when(F.col("seq") % 10 == 3, F.array(line, F.lit("restarted"), F.lit(""), F.lit("12"))).otherwise(F.array(line))).alias("_k", "value"))
    devicelog.write_lines(lines, folder, ("time_ms", "seq", "_k"))
    return files.read_sensor_log_lenient(spark, folder)


def _faulty_log(spark: SparkSession, sf_dir: str) -> str:
    """The sensor table as logs with lines that hold no sample."""
    folder = _folder(spark)
    samples = sensor(spark, sf_dir)
    line = F.concat_ws(",", F.col("time_ms").cast("string"), F.col("distance").cast("string"))
    lines = samples.select("sensor_id", "time_ms", "seq", F.posexplode(F.when(F.col("seq") % 10 == 3, F.array(line, F.lit("restarted"), F.lit(""), F.lit("12"))).otherwise(F.array(line))).alias("_k", "value"))
    devicelog.write_lines(lines, folder, ("time_ms", "seq", "_k"))
    return folder


@query
def bad_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of logs that hold no sample, by sensor and offset."""
    bad = devicelog.bad_lines(devicelog.log_lines(spark, _faulty_log(spark, sf_dir)))
    return bad.select("sensor_id", "at", "line", "reason")


@query
def device_log_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `compact_live_detector` gives, from logs that are read as a stream of lines."""
    live.use_rocksdb(spark)
    samples = devicelog.log_samples(devicelog.log_lines(spark, _faulty_log(spark, sf_dir), stream=True))
    feed = samples.withColumns({"sensor_id": F.col("sensor_id").cast("long"), "kind": F.lit(live.SAMPLE)})
    return rounded(live.on_time(live.run_to_end(live.compact_live_detector(feed, COMPACT), _folder(spark))), "variance")


@query
def bucketed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `dip_shape` gives, from a table in buckets by sensor: no shuffle after it is written."""
    name = f"samples_{uuid.uuid4().hex}"
    files.write_bucketed(sensor(spark, sf_dir), name, f"{_folder(spark)}/samples", buckets=8)
    plain = feat.dip_features(segment.dip_slices(spark.table(name), DIPS), DIPS)
    return rounded(plain, "dip_height", "fill_factor", "plateau_variance").select("sensor_id", "dip_id", "dip_height", "fill_factor", "plateau_variance", "shape_category")


@query
def merged_tables_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment job: logs and frame counts to samples with counts, read again under their logical names."""
    folder = _folder(spark)
    files.write_sensor_log(sensor(spark, sf_dir), f"{folder}/log")
    file_jobs.merge_and_dips(spark, f"{folder}/log", frames(spark, sf_dir), f"{folder}/out", 0.1, DIPS)
    merged = spark.read.parquet(f"{folder}/out/samples_with_counts").withColumn("time_s", (F.col("time_ms") / 1000.0).cast("double"))
    named = files.with_column_mapping(merged, {"time": "time_s", "depth": "distance"})
    return rounded(named, "vehicles", "people", "bicycles").select("sensor_id", "seq", "time", "depth", "vehicles", "people", "bicycles")


@query
def frames_with_depth_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment job's other table: frames with the depth nearest in time."""
    folder = _folder(spark)
    files.write_sensor_log(sensor(spark, sf_dir), f"{folder}/log")
    file_jobs.merge_and_dips(spark, f"{folder}/log", frames(spark, sf_dir), f"{folder}/out", 0.1, DIPS)
    return spark.read.parquet(f"{folder}/out/frames_with_depth").select("sensor_id", "frame_number", "time_seconds", "ultrawide_depth_m")


@query
def scored_dips_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dips with the scores of the forest, written as CSV and read again."""
    folder = _folder(spark)
    files.write_csv(forest_scores(spark, sf_dir).drop("in_test"), folder)
    return spark.read.schema("sensor_id long, dip_id long, is_vehicle int, ml_vehicle_prob double, ml_prediction int, ml_prediction_label string").csv(folder, header=True)


@query
def frame_counts_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame table of all videos written as CSV and read again."""
    folder = _folder(spark)
    files.write_csv(det.frame_table(_lanes(spark, sf_dir), FPS).drop("video_id"), folder)
    return _as_text(files.read_frame_counts(spark, folder))


@query
def dip_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dips with features, objects and depths written as CSV and read again."""
    folder = _folder(spark)
    slices = _slices(spark, sf_dir)
    dips = feat.dip_features(slices, DIPS, counts=True).join(feat.dip_arrays(slices).select("sensor_id", "dip_id", "dip_array"), ["sensor_id", "dip_id"])
    files.write_dips(dips.select(*[c.split(" ")[0] for c in files.DIP_FEATURES.split(", ")]), folder)
    back = files.read_dip_features(spark, folder)
    depths = F.array_join(F.transform("dip_array", lambda d: F.round(d * 100).cast("long").cast("string")), ",").alias("depths")
    kept = ["time_of_dip_seconds", "dip_duration_seconds", "frame_count", "start_frame_idx", "end_frame_idx", "min_depth", "object", "shape_category"]
    sums = ["avg_depth", "depth_variance", "avg_depth_gradient", "line_integral", "fill_factor", "plateau_variance", "avg_vehicles", "avg_bicycles", "avg_people"]
    return rounded(back, *sums).select(*kept, *sums, depths)


@query
def log_to_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event report, from the sensor table written as logs."""
    folder = _folder(spark)
    files.write_sensor_log(sensor(spark, sf_dir), folder, " ")
    return file_jobs.log_to_report(spark, folder, EVENTS)
