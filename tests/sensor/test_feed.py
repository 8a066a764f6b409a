"""Every sample is fed to the live detectors, whatever its time."""

import os

from pyspark.sql import functions as F

from dipfleet.functions.params import CompactParams, LiveParams
from dipfleet.jobs import registry
from dipfleet.operators import detections as det
from dipfleet.operators import segment
from dipfleet.streaming import live

DATA = "/root/testdata/sf0.001"


def test_samples_before_the_epoch_are_fed(spark, tmp_path, monkeypatch):
    times = [-40_000, -1, 0, 7_000, 40_000]
    samples = spark.createDataFrame([(1, i, t, 200.0) for i, t in enumerate(times)], "sensor_id long, seq long, time_ms long, distance double")
    monkeypatch.setattr(registry, "sensor", lambda *_: samples)
    registry._feed(spark, "", str(tmp_path))
    fed = spark.read.parquet(f"{tmp_path}/in").where("kind = 'sample'")
    assert sorted(r.time_ms for r in fed.collect()) == times


def batches(folder):
    """Micro-batches that a stream committed."""
    return len([f for f in os.listdir(f"{folder}/state/commits") if f.isdigit()])


def rows(df, columns):
    return sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.select(*columns).collect())


def test_every_arrival_is_a_batch_of_its_own(spark, tmp_path):
    """State has to carry events, tracks and counts over at least four batches."""
    live.use_rocksdb(spark)
    streams = {
        "live": lambda f: live.live_detector(registry._feed(spark, DATA, f), registry.LIVE),
        "compact": lambda f: live.compact_live_detector(registry._feed(spark, DATA, f), registry.COMPACT),
        "tracks": lambda f: live.track_objects_live(registry._boxes_feed(spark, DATA, f), registry.TRACKS),
        "counts": lambda f: live.frame_counts_live(registry._boxes_feed(spark, DATA, f, closing=True), "at"),
    }
    found = {}
    for name, stream in streams.items():
        found[name] = live.run_to_end(stream(f"{tmp_path}/{name}"), f"{tmp_path}/{name}")
        assert batches(f"{tmp_path}/{name}") >= 4, name
    columns = ["video_id", "frame_number", "det_idx", "object_id", "is_new"]
    assert rows(found["tracks"], columns) == rows(registry.track_objects(spark, DATA), columns)
    counts = det.frame_class_counts(det.filter_detections(registry.detections(spark, DATA)))
    assert rows(found["counts"].where("video_id is not null"), counts.columns) == rows(counts, counts.columns)


def test_large_arrivals_have_more_files(spark, tmp_path, monkeypatch):
    """A batch still reads as many as an arrival has; frames are cut, and counted without a sort of their detections."""
    monkeypatch.setattr(registry, "FILE_ROWS", 100)
    monkeypatch.setattr(registry, "_folder", lambda _: str(tmp_path))
    boxes = det.filter_detections(registry.detections(spark, DATA))
    got = registry.frame_counts_live(spark, DATA)
    want = det.frame_class_counts(boxes)
    assert rows(got, want.columns) == rows(want, want.columns)
    files = [len([f for f in os.listdir(f"{tmp_path}/in/part={k}") if f.endswith(".parquet")]) for k in range(registry.ARRIVALS)]
    assert min(files) == max(files) >= boxes.count() / registry.ARRIVALS / 100 > registry.FILES
    assert 4 <= batches(tmp_path) <= 7
    fed = spark.read.parquet(f"{tmp_path}/in").where("video_id is not null")
    assert "det_idx" not in fed.columns and fed.count() == boxes.count()
    assert fed.groupBy("video_id", "frame_number").agg(F.count_distinct("part").alias("n")).where("n > 1").count() > 10


def test_null_and_nan_distances_live_as_in_batch(spark, tmp_path):
    """They are samples that enter no depth, variance or step, wherever they fall: calibration, dips, ends of dips."""
    table = []
    for sensor in range(4):
        for i in range(160):
            deep = (i // 17) % 2 == 1 and i > 20
            d = 120.0 + 3 * (i % 4) if deep else 230.0
            if (i * 7 + sensor * 3) % 11 == 0 or i in (1, 2):
                d = None if (i + sensor) % 2 else float("nan")
            table.append((sensor, i, i * 60, d))
    samples = spark.createDataFrame(table, "sensor_id long, seq long, time_ms long, distance double")
    feed = live.with_triggers(samples, samples.groupBy("sensor_id").agg(F.min("time_ms").alias("time_ms")))
    for k in range(5):
        feed.where(F.floor(F.col("time_ms") / 2000) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live.use_rocksdb(spark)
    params, compact = LiveParams(calibration_ms=1000), CompactParams(calibration_samples=8)
    columns = ["sensor_id", "time_ms", "samples", "duration", "min_depth", "variance", "avg_gradient", "baseline", "type"]
    want = rows(segment.live_events(samples, params), columns)
    got = live.run_to_end(live.live_detector(live.sample_feed(spark, f"{tmp_path}/in"), params), f"{tmp_path}/live")
    assert len(want) > 4 and rows(got, columns) == want and "nan" not in str(want)
    columns = ["sensor_id", "time_ms", "close_ms", "samples", "duration_ms", "variance", "type"]
    want = rows(segment.segment_events_compact(samples, compact), columns)
    got = live.run_to_end(live.compact_live_detector(live.sample_feed(spark, f"{tmp_path}/in"), compact), f"{tmp_path}/compact")
    assert len(want) > 4 and rows(got, columns) == want
