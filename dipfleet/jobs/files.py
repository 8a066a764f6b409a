"""Jobs from files to files: logs and frame counts in, merged tables, dips and event reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dipfleet.functions.params import DipParams, EventParams
from dipfleet.functions.storage import checkpointed
from dipfleet.operators import features, segment, sync
from dipfleet.sources import files


def log_to_report(spark: SparkSession, log: str, params: EventParams = EventParams()) -> DataFrame:  # noqa: B008
    """Vehicles and events of each sensor of a log, by the batch counter."""
    events = segment.event_stats(segment.segment_events(files.read_sensor_log_lenient(spark, log), params))
    return segment.event_report(segment.classify_events(segment.gate_events(events, params), params))


def merge_and_dips(spark: SparkSession, log: str, frames: DataFrame, out: str, offset: float, params: DipParams = DipParams()) -> bool:  # noqa: B008
    """Align a log with the frames of the same sites (`sensor_id`), write frames with depths, samples with counts, and the dips
    with features and objects. Returns whether there were dips; where not, a warning is logged and none are written."""
    samples = checkpointed(files.read_sensor_log(spark, log))  # the log is read once
    frames = frames.withColumn("sensor_id", F.col("sensor_id").cast("string"))
    files.write_table(sync.nearest_depth_join(frames, samples, offset), f"{out}/frames_with_depth")
    files.write_table(sync.interpolate_counts_join(samples, frames, offset), f"{out}/samples_with_counts")
    counted = spark.read.parquet(f"{out}/samples_with_counts")
    dips = features.dip_features(segment.dip_slices(counted, params), params, counts=True)
    return files.write_dips(dips, f"{out}/dips")
