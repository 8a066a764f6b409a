"""Live equals batch, in any cut of the feed into micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from dipfleet.functions.params import CompactParams, LiveParams, TrackParams
from dipfleet.operators import segment
from dipfleet.operators.tracking import track_objects
from dipfleet.streaming import live

LIVE, COMPACT = LiveParams(calibration_ms=500), CompactParams(calibration_samples=5, capacity=6)
SCHEMA = "sensor_id long, seq long, time_ms long, distance double"


@pytest.fixture(scope="module")
def samples(spark):
    rnd, rows = random.Random(16), []
    for k in range(6):
        t, low = 0, False
        for i in range(150):
            t += rnd.choice([40, 50, 90, 150, 260])
            low = not low if rnd.random() < (0.15 if i > 8 else 0) else low
            rows.append((k, i, t, float(rnd.randint(50, 190) if low else rnd.randint(224, 226))))
    return spark.createDataFrame(rows, SCHEMA).cache()


def feed(spark, df, folder, cuts=5):
    for k in range(cuts):
        df.where((F.col("time_ms") >= k * 4000) & ((F.col("time_ms") < (k + 1) * 4000) | F.lit(k == cuts - 1))).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    live.use_rocksdb(spark)
    return live.sample_feed(spark, f"{folder}/in")


def comparable(df, columns):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def test_live_detector(spark, samples, tmp_path):
    stream = feed(spark, live.with_triggers(samples, samples.groupBy("sensor_id").agg(F.min("time_ms").alias("time_ms"))), str(tmp_path))
    got = live.on_time(live.run_to_end(live.live_detector(stream, LIVE), str(tmp_path)))
    columns = ["sensor_id", "time_ms", "samples", "duration", "min_depth", "variance", "avg_gradient", "baseline", "type"]
    want = comparable(segment.live_events(samples, LIVE), columns)
    assert len(want) > 5 and comparable(got, columns) == want


def test_compact_detector(spark, samples, tmp_path):
    stream = feed(spark, live.with_triggers(samples, samples.limit(0)), str(tmp_path))
    got = live.on_time(live.run_to_end(live.compact_live_detector(stream, COMPACT), str(tmp_path)))
    columns = ["sensor_id", "time_ms", "close_ms", "samples", "duration_ms", "variance", "type"]
    want = comparable(segment.segment_events_compact(samples, COMPACT), columns)
    assert len(want) > 5 and comparable(got, columns) == want


def test_without_a_trigger_nothing_is_detected(spark, samples, tmp_path):
    stream = feed(spark, live.with_triggers(samples, samples.limit(0)), str(tmp_path))
    assert live.run_to_end(live.live_detector(stream, LIVE), str(tmp_path)).count() == 0


def test_tracker(spark, tmp_path):
    rnd = random.Random(17)
    rows = [(v, f, i, rnd.randint(0, 2), x, 0, x + 50, 50) for v in range(3) for f in range(40) for i in range(2) if (x := rnd.choice([0, 200]) + rnd.randint(0, 9)) >= 0]
    schema = "video_id long, frame_number long, det_idx long, class_id int, x1 long, y1 long, x2 long, y2 long"
    df, params = spark.createDataFrame(rows, schema), TrackParams(fps=4.0, retention_frames=8)
    for k in range(4):
        df.where(F.floor(F.col("frame_number") / 10) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live.use_rocksdb(spark)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    columns = ["video_id", "frame_number", "det_idx", "object_id", "is_new"]
    assert comparable(live.run_to_end(live.track_objects_live(stream, params), str(tmp_path)), columns) == comparable(track_objects(df, params), columns)


def test_frame_counts(spark, tmp_path):
    rows = [(1, f, c, f"2024-01-01 00:00:{f:02d}") for f in range(30) for c in (0, 0, 2)] + [(1, 50, 1, "2024-01-01 00:01:30")]
    df = spark.createDataFrame(rows, "video_id long, frame_number long, class_id int, at string").withColumn("at", F.to_timestamp("at"))
    for k in (0, 1):
        df.where((F.col("frame_number") >= 50) == bool(k)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = live.run_to_end(live.frame_counts_live(stream, "at"), str(tmp_path)).collect()
    assert len(got) == 30 and all((r.people_in_frame, r.bicycles_in_frame, r.vehicles_in_frame) == (2, 0, 1) for r in got)


def test_frames_of_a_second_share_a_row_of_state(spark, tmp_path):
    """And each keeps counts of its own: also frames before the first, without a number or a class, or with times in two seconds."""
    rnd = random.Random(19)
    rows = [(v, f, rnd.choice([0, 1, 2, None]), 100_000 + f * 250) for v in range(3) for f in range(-8, 40) for _ in range(rnd.randint(0, 3))]
    rows += [(1, None, 2, 101_000), (1, None, 0, 101_900), (2, 5, 1, 107_000), (None, None, None, 10**9)]
    df = spark.createDataFrame(rows, "video_id long, frame_number long, class_id int, ms long").select("video_id", "frame_number", "class_id", F.timestamp_millis("ms").alias("at"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    live.use_rocksdb(spark)
    stream = live.frame_counts_live(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "at")
    of = lambda k: F.count_if(F.col("class_id") == k)
    want = df.where("video_id is not null").groupBy("video_id", "frame_number", F.window("at", "1 second")).agg(of(0), of(1), of(2), F.count("*")).drop("window")
    text = lambda d: sorted(str(list(r)) for r in d.collect())
    assert text(live.run_to_end(stream, f"{tmp_path}/a")) == text(want)
    again = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/b").trigger(availableNow=True).start()
    again.awaitTermination()
    written = sum(p["stateOperators"][0]["numRowsUpdated"] for p in again.recentProgress)
    assert stream.columns == ["video_id", "frame_number", "people_in_frame", "bicycles_in_frame", "vehicles_in_frame", "total_in_frame"] and written <= 3 * 12 + 3


def jumbled(spark, df, folder, time, delay, cuts, rnd_seed, closing):
    """Rows in arrivals by their time and a delay of their own; then a row of no key that moves the watermark past all."""
    late_by = F.pmod(F.xxhash64(F.lit(rnd_seed), *df.columns), F.lit(delay))
    step = df.agg(F.max(time)).first()[0] // cuts + 1
    arrival = F.floor((F.col(time) + late_by) / step)
    for k in range(cuts + 1 + delay // step):
        part = df.where(arrival == k)
        if not part.isEmpty():
            part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    closing.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    live.use_rocksdb(spark)
    return live.sample_feed(spark, f"{folder}/in", df.schema)


@pytest.mark.parametrize("cuts", [2, 9])
def test_event_time_restores_the_order(spark, samples, tmp_path, cuts):
    """Arrivals shuffled within the delay give exactly the batch result, for both detectors."""
    feed = live.with_triggers(samples, samples.groupBy("sensor_id").agg(F.min("time_ms").alias("time_ms")))
    closing = feed.limit(1).withColumns({"sensor_id": F.lit(-1).cast("long"), "time_ms": F.lit(10**9).cast("long")})
    stream = live.reordered(jumbled(spark, feed, str(tmp_path), "time_ms", 3_000, cuts, cuts, closing), 3_000)
    columns = ["sensor_id", "time_ms", "samples", "duration", "min_depth", "variance", "avg_gradient", "baseline", "type"]
    got = live.run_to_end(live.live_detector(stream, LIVE), f"{tmp_path}/a")
    want = comparable(segment.live_events(samples, LIVE), columns)
    assert got.where("late").count() == 0 and len(want) > 5 and comparable(live.on_time(got), columns) == want
    columns = ["sensor_id", "time_ms", "close_ms", "samples", "duration_ms", "variance", "type"]
    got = live.run_to_end(live.compact_live_detector(stream, COMPACT), f"{tmp_path}/b")
    assert got.where("late").count() == 0 and comparable(live.on_time(got), columns) == comparable(segment.segment_events_compact(samples, COMPACT), columns)


def test_late_rows_come_out_marked(spark, samples, tmp_path):
    """Rows that come after the watermark has let later ones of their sensor step are told, and the rest is as without them."""
    late = (F.col("seq") % 20 == 7) & (F.col("seq") < 140)
    feed = live.with_triggers(samples, samples.groupBy("sensor_id").agg(F.min("time_ms").alias("time_ms")))
    closing = feed.limit(1).withColumns({"sensor_id": F.lit(-1).cast("long"), "time_ms": F.lit(50_000_000).cast("long")})
    stream = live.reordered(jumbled(spark, feed.where(~late), str(tmp_path), "time_ms", 500, 4, 1, closing), 600)
    feed.where(late).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = live.run_to_end(live.live_detector(stream, LIVE), str(tmp_path))
    columns = ["sensor_id", "time_ms", "samples", "duration", "min_depth", "variance", "avg_gradient", "baseline", "type"]
    assert comparable(live.on_time(got), columns) == comparable(segment.live_events(samples.where(~late), LIVE), columns)
    assert {r.sensor_id: r.late_rows for r in live.late_counts(got).collect()} == {r.sensor_id: r["count"] for r in samples.where(late).groupBy("sensor_id").count().collect()}


def test_frames_in_pieces(spark, tmp_path):
    """Detections of a frame that arrive in different micro-batches, out of order, are tracked as in batch."""
    rnd = random.Random(18)
    rows = [(v, f, i, rnd.randint(0, 2), x, 0, x + 50, 50) for v in range(3) for f in range(1, 40) for i in range(rnd.randint(1, 4)) if (x := rnd.choice([0, 60, 200]) + rnd.randint(0, 9)) >= 0]
    schema = "video_id long, frame_number long, det_idx long, class_id int, x1 long, y1 long, x2 long, y2 long"
    df, params = spark.createDataFrame(rows, schema), TrackParams(fps=4.0, retention_frames=8)
    closing = df.limit(1).withColumns({"video_id": F.lit(-1).cast("long"), "frame_number": F.lit(10**6).cast("long")})
    stream = live.reordered(jumbled(spark, df, str(tmp_path), "frame_number", 6, 7, 3, closing), 2_000, F.col("frame_number") * 250)
    got = live.run_to_end(live.track_objects_live(stream, params), str(tmp_path))
    columns = ["video_id", "frame_number", "det_idx", "object_id", "is_new"]
    assert got.where("late").count() == 0 and comparable(live.on_time(got), columns) == comparable(track_objects(df, params), columns)


BOXES = "video_id long, frame_number long, det_idx long, class_id int, x1 long, y1 long, x2 long, y2 long"


def test_videos_share_state(spark, tmp_path):
    """A micro-batch of many videos touches a few rows of state for each bundle; each video is tracked as in batch, whatever its id, and one without an id is not."""
    rnd, rows = random.Random(20), []
    for v in [*range(-500, 500), 2**60 + 1, 2**61 + 1, None]:
        for f in range(1, 9):
            for i in range(rnd.randint(0, 2)):
                x = rnd.choice([0, 60, 200]) + rnd.randint(0, 9)
                rows.append((v, f, i, rnd.randint(0, 2), x, 0, x + 50, 50))
    df, params = spark.createDataFrame(rows, BOXES), TrackParams(fps=4.0, retention_frames=3)
    closing = spark.createDataFrame([(None, 10**6, None, None, None, None, None, None)], BOXES)
    stream = live.reordered(jumbled(spark, df, str(tmp_path), "frame_number", 3, 2, 5, closing), 1_500, F.col("frame_number") * 250)
    tracked = live.track_objects_live(stream, params)
    query = tracked.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got, columns = spark.read.schema(tracked.schema).parquet(f"{tmp_path}/out"), ["video_id", "frame_number", "det_idx", "class_id", "x1", "x2", "object_id", "is_new"]
    assert got.where("late").count() == 0 and comparable(live.on_time(got), columns) == comparable(track_objects(df, params), columns)
    assert max(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress) <= 6 * 256


def test_late_detections_come_out_marked(spark, tmp_path):
    """Videos of a bundle are late each by itself: one whose rows all come at the end has none that are."""
    rnd = random.Random(21)
    rows = [(v, f, i, 2, x, 0, x + 50, 50) for v in range(7) for f in range(1, 30) for i in range(2) if (x := 200 * i + rnd.randint(0, 9)) >= 0]
    df, params = spark.createDataFrame(rows, BOXES), TrackParams(fps=4.0, retention_frames=8)
    late, last = (F.col("frame_number") % 10 == 3) & (F.col("video_id") < 5), F.col("video_id") == 6
    closing = df.limit(1).withColumns({"video_id": F.lit(None).cast("long"), "frame_number": F.lit(10**4).cast("long")})
    stream = live.reordered(jumbled(spark, df.where(~late & ~last), str(tmp_path), "frame_number", 3, 3, 7, closing), 1_000, F.col("frame_number") * 250)
    df.where(late | last).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = live.run_to_end(live.track_objects_live(stream, params, bundles=2), str(tmp_path))
    columns = ["video_id", "frame_number", "det_idx", "object_id", "is_new"]
    assert comparable(live.on_time(got), columns) == comparable(track_objects(df.where(~late), params), columns)
    assert comparable(got.where("late"), columns[:3]) == comparable(df.where(late), columns[:3]) and got.where("late and object_id is not null").count() == 0


def test_events_longer_than_the_buffer(spark, tmp_path):
    """5,000 samples of an event are kept, live as in batch."""
    depths = [230.0] * 20 + [100.0 + i % 3 for i in range(5_200)] + [230.0] * 20
    df = spark.createDataFrame([(1, i, i + 1, d) for i, d in enumerate(depths)], SCHEMA)
    params = LiveParams(calibration_ms=10, gap_ms=5, min_seconds=0.1)
    stream = feed(spark, live.with_triggers(df, df.groupBy("sensor_id").agg(F.min("time_ms").alias("time_ms"))), str(tmp_path))
    got = live.on_time(live.run_to_end(live.live_detector(stream, params), str(tmp_path)))
    columns = ["sensor_id", "time_ms", "samples", "duration", "min_depth", "variance", "avg_gradient", "baseline", "type"]
    assert comparable(got, columns) == comparable(segment.live_events(df, params), columns) and got.first().samples == 5_000


def test_a_key_asks_its_state_for_no_more_than_it_has():
    """Every call is a message to the state server: empty lists and maps are not cleared, and nothing is built for a key without events."""
    import pandas as pd

    calls = []

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, call):
            return lambda *_: calls.append(f"{self.name}.{call}") or ([] if self.name == "waiting" else None)

    class Handle:
        def __getattr__(self, kind):
            return lambda name, *_: State(name)

    class Timers:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 1_000

    detector = live.LiveDetector(LIVE, True)
    detector.init(Handle())
    frame = pd.DataFrame({"time_ms": [80, 40], "seq": [1, 0], "distance": [230.0, None], "kind": [live.SAMPLE] * 2, "event_ms": [80, 40]})
    assert not list(detector.handleInputRows((1,), iter([frame]), Timers()))
    assert calls == ["place.get", "waiting.get", "core.get", "core.update", "place.update"]
