"""The driver's tables in the shapes of the library: samples, frame counts and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# the key has its final name before the numbering, so that one shuffle by it serves what follows
_SENSOR = """
select sensor_id,
       cast(row_number() over (partition by sensor_id order by ts, event_id) - 1 as bigint) as seq,
       ({US}(ts) - 1704067200000000) {DIV} 86400000 as time_ms,
       greatest(cast(250.0 as double) - value, cast(1.0 as double)) as distance
from (select user_id as sensor_id, ts, event_id, value from {EVENTS}) e"""

_FRAMES = """
select user_id as sensor_id,
       ({US}(ts) - 1704067200000000) {DIV} 21600000000 as frame_number,
       cast((({US}(ts) - 1704067200000000) {DIV} 21600000000) as double) / 4 as time_seconds,
       count(case when event_type in ('view', 'signup') then 1 end) as people_in_frame,
       count(case when event_type = 'click' then 1 end) as bicycles_in_frame,
       count(case when event_type = 'purchase' then 1 end) as vehicles_in_frame
from {EVENTS} group by 1, 2, 3"""

_DETECTIONS = """
select video_id, frame_number,
       cast(row_number() over (partition by video_id, frame_number order by l_orderkey, l_linenumber, l_partkey, l_quantity,
            l_extendedprice, l_discount, l_tax) - 1 as bigint) as det_idx,
       lane, class_id, confidence, x1, y1, x1 + 60 + q % 7 as x2, y1 + 50 + q % 5 as y2
from (select *, l_suppkey as video_id, cast(l_linenumber as bigint) as lane,
             ({US}(l_shipdate) - 788918400000000) {DIV} 604800000000 as frame_number,
             case l_returnflag when 'R' then 2 when 'N' then 0 else 1 end as class_id,
             cast(0.4 as double) + l_discount * 5 as confidence,
             cast(floor(l_quantity) as bigint) as q,
             cast(l_linenumber as bigint) * 100 + cast(floor(l_quantity) as bigint) % 10 as x1,
             100 + cast(round(l_tax * 100) as bigint) as y1
      from {LINEITEM}) z"""

FPS, RETENTION = 4.0, 8


def _duck(template: str) -> str:
    return template.replace("{US}", "epoch_us").replace("{DIV}", "//").replace("{EVENTS}", "events").replace("{LINEITEM}", "lineitem")


SENSOR_SQL, FRAMES_SQL, DETECTIONS_SQL = _duck(_SENSOR), _duck(_FRAMES), _duck(_DETECTIONS)


def _spark(template: str) -> str:
    since = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', "
    return template.replace("{US}(", since).replace("{DIV}", "div").replace("{EVENTS}", "{events}").replace("{LINEITEM}", "{lineitem}")


def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day of events plays one second of a sensor."""
    return spark.sql(_spark(_SENSOR), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four frames a scaled second."""
    return spark.sql(_spark(_FRAMES), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes: suppliers are videos, weeks are frames."""
    return spark.sql(_spark(_DETECTIONS), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
