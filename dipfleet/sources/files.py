"""Reading and writing the library's tables as files."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dipfleet.functions.series import ordered
from dipfleet.functions.storage import checkpointed
from dipfleet.sources import devicelog

#: Logical column names of a merged table and the physical names they have by default.
DEFAULT_MAPPING = {"time": "time_seconds", "depth": "ultrawide_depth_m", "vehicles": "vehicles_in_frame", "bicycles": "bicycles_in_frame", "people": "people_in_frame"}
DETECTED = "array<struct<class:string,confidence:double,bbox:array<int>>>"
FRAME_COUNTS = (
    "time_seconds double, frame_number long, people_in_frame int, bicycles_in_frame int, vehicles_in_frame int, total_in_frame int, total_people_counted int, total_bicycles_counted int, "
    "total_vehicles_counted int, total_objects_counted int, newly_counted_this_frame int, detected_objects string, total_detections int"
)
DIP_FEATURES = (
    "time_of_dip_seconds double, min_depth double, avg_depth double, object string, dip_duration_seconds double, line_integral double, avg_depth_gradient double, max_depth_gradient double, depth_variance double, "
    "depth_fourth_moment double, avg_vehicles double, avg_bicycles double, avg_people double, frame_count long, start_frame_idx long, end_frame_idx long, dip_array string, dip_height double, fill_factor double, plateau_variance double, shape_category string"
)


def write_sensor_log(samples: DataFrame, path: str, separator: str = ",") -> None:
    """Lines of time and distance in the order of time, a folder for each sensor."""
    line = F.concat_ws(separator, F.col("time_ms").cast("string"), F.col("distance").cast("string"))
    devicelog.write_lines(samples.withColumn("value", line), path)


def _numbered(rows: DataFrame) -> DataFrame:
    """`seq` by time, and in the order of file and offset among equal times."""
    w = ordered(("sensor_id",), "time_ms", "_at")
    return rows.withColumn("_at", F.struct("file", "at")).withColumn("seq", (F.row_number().over(w) - 1).cast("long")).select("sensor_id", "seq", "time_ms", "distance")


def read_sensor_log(spark: SparkSession, path: str) -> DataFrame:
    """Headerless logs of `time,distance`, one file per sensor: the sensor is the file name. Blank lines are skipped."""
    rows = devicelog.log_lines(spark, path).withColumn("_row", F.from_csv("line", "time_ms long, distance double"))
    return _numbered(rows.select("sensor_id", "file", "at", "_row.*").where("time_ms is not null"))


def read_sensor_log_lenient(spark: SparkSession, path: str) -> DataFrame:
    """Lines of `t,d` or `t d`; lines that hold neither are skipped."""
    return _numbered(devicelog.parsed(devicelog.log_lines(spark, path)).where("time_ms is not null and distance is not null"))


def read_frame_counts(spark: SparkSession, path: str) -> DataFrame:
    """Frame counts with a header; the list of detected objects is read from its text."""
    rows = spark.read.schema(FRAME_COUNTS).csv(path, header=True, quote='"', escape='"')
    return rows.withColumn("detected_objects", F.from_json("detected_objects", DETECTED))


def bad_frame_counts(spark: SparkSession, path: str) -> DataFrame:
    """Lines of frame counts that do not fit their columns, for a side table: `file, line, reason`."""
    rows = spark.read.schema(FRAME_COUNTS + ", _line string").csv(path, header=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_line")
    names = [c.split(" ")[0] for c in FRAME_COUNTS.split(", ")]
    empty = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in names])
    # every column is read, as a line is only held against those
    return rows.withColumn("reason", F.concat(F.lit("not read: "), empty)).where("_line is not null").select(F.col("_metadata.file_path").alias("file"), F.col("_line").alias("line"), "reason")


def with_column_mapping(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Columns renamed from physical to logical names; `mapping` overrides the defaults. Missing ones raise."""
    names = {**DEFAULT_MAPPING, **(mapping or {})}
    if missing := sorted(set(names.values()) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.withColumnsRenamed({physical: logical for logical, physical in names.items()})


def read_dip_features(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(DIP_FEATURES).csv(path, header=True, quote='"', escape='"')
    return rows.withColumn("dip_array", F.from_json("dip_array", "array<double>"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON text."""
    nested = {f.name: F.to_json(f.name) for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")}
    df.withColumns(nested).write.csv(path, header=True, quote='"', escape='"')


def write_dips(dips: DataFrame, path: str) -> bool:
    """Dip results as CSV. Where there are none, nothing is written but a warning to the log."""
    dips = checkpointed(dips)  # looked at and written
    if dips.isEmpty():
        logging.getLogger(__name__).warning("no dips found: nothing is written to %s", path)
        return False
    write_csv(dips, path)
    return True


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet, nested columns as they are, one folder per value of `partition_by`."""
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, keys: tuple[str, ...] = ("sensor_id",), order: tuple[str, ...] = ("time_ms", "seq"), buckets: int = 16) -> None:
    """A table whose files are buckets by key, each sorted: what works by these keys reads it without a shuffle."""
    dealt = df.repartition(buckets, *keys)  # a file for each bucket
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys, *order).format("parquet").option("path", path).saveAsTable(table)
