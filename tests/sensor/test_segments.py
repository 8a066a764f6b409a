"""Window forms against sequential models on random series, and the boundary cases by hand."""

import random

import pytest
from pyspark.sql import functions as F

from dipfleet.functions.params import CompactParams, DipParams, EventParams, LiveParams
from dipfleet.operators import segment
from dipfleet.streaming.live import LiveMachine
from tests.sensor import machines

STEPS = [40, 44, 50, 90, 150, 260, 310, 500]
HAND = {
    9001: [(0, 230), (40, 100), (340, 230), (380, 100), (420, 230), (900, 230)],  # a gap of exactly 300 ms after the last row below
    9002: [(0, 100), (40, 100), (80, 230), (900, 230)],  # below from the first row: no lead-in
    9003: [(0, 230), (40, 100), (80, 100)],  # below at the end
    9004: [(0, 230), (40, 100), (500, 230), (540, 100), (1000, 230), (1040, 230)],  # one row past the gap; a shared boundary row
    9005: [(0, 230), (50, 230)],
}


@pytest.fixture(scope="module")
def series():
    rnd, out = random.Random(12), dict(HAND)
    for k in range(120):
        rows, t, low = [], 0, False
        for _ in range(rnd.randint(3, 120)):
            t += rnd.choice(STEPS)
            low = not low if rnd.random() < 0.3 else low
            rows.append((t, float(rnd.randint(50, 210) if low else rnd.randint(216, 235))))
        out[k] = rows
    return out


@pytest.fixture(scope="module")
def samples(spark, series):
    rows = [(k, i, t, float(d)) for k, s in series.items() for i, (t, d) in enumerate(s)]
    return spark.createDataFrame(rows, "sensor_id long, seq long, time_ms long, distance double").repartition(4).cache()


def by_key(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r.sensor_id, []).append(tuple(r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


def want(series, f):
    return {k: v for k, s in series.items() if (v := sorted(f(s)))}


def test_dips(samples, series):
    raw = segment.raw_dips(samples, 215.0)
    assert by_key(raw, "start_idx", "end_idx") == want(series, lambda s: machines.raw_dips(s, 215))
    merged = segment.merge_dips(raw, 300)
    assert by_key(merged, "start_idx", "end_idx") == want(series, lambda s: machines.merge(machines.raw_dips(s, 215), s, 300))
    kept = segment.filter_short_dips(merged, 200)
    rows = segment.dip_slices(samples, DipParams(baseline=215.0))
    bounds = rows.groupBy("sensor_id", "dip_id").agg(F.min("i").alias("start_idx"), F.max("i").alias("end_idx"), F.count("*").alias("n")).where("n = end_idx - start_idx + 1")
    assert by_key(bounds, "dip_id", "start_idx", "end_idx") == by_key(kept, "dip_id", "start_idx", "end_idx")


def test_events(samples, series):
    stats = segment.event_stats(segment.segment_events(samples, EventParams()))
    assert by_key(stats, "start_idx", "end_idx") == want(series, lambda s: machines.events(s, 215, 300))
    assert stats.where("samples <> end_idx - start_idx + 1").count() == 0
    live = segment.event_stats(segment.segment_events_live(samples, LiveParams()))
    assert by_key(live, "start_idx", "end_idx") == want(series, lambda s: machines.live_events(s, 215, 200))


def test_compact_events(samples, series):
    for capacity in (3, 500):
        got = by_key(segment.segment_events_compact(samples, CompactParams(capacity=capacity), line=215.0), "time_ms", "close_ms", "samples", "variance")
        model = want(series, lambda s, c=capacity: machines.compact_events(s, 215, c, 200))
        assert got.keys() == model.keys()
        for k in got:
            assert [g[:3] for g in got[k]] == [m[:3] for m in model[k]] and all(abs(g[3] - m[3]) < 1e-6 for g, m in zip(got[k], model[k]))


def test_buffer_overflow(spark):
    for n, events in ((500, 1), (501, 0), (502, 1), (1002, 0)):
        rows = [(1, 0, 0, 230.0)] + [(1, i, 40 * i, 100.0) for i in range(1, n + 1)] + [(1, n + 1, 40 * (n + 6), 230.0)]
        df = spark.createDataFrame(rows, "sensor_id long, seq long, time_ms long, distance double")
        assert segment.segment_events_compact(df, CompactParams(), line=215.0).count() == events, n


def test_demo_stream(spark):
    depths = [230] * 50 + [230, 230, 230, 150, 148, 152, 150, 149, 230, 230, 180, 60, 120, 70, 150, 230, 230]
    df = spark.createDataFrame([(1, i, 40 * i, float(d)) for i, d in enumerate(depths)], "sensor_id long, seq long, time_ms long, distance double")
    got = [(r.time_ms, r.close_ms, r.duration_ms, round(r.variance, 2), r.type) for r in segment.segment_events_compact(df).orderBy("time_ms").collect()]
    assert got == [(2120, 2320, 200, 1.76, "VEHICLE"), (2400, 2600, 200, 2104.0, "VEHICLE")]


def test_missing_distances_are_not_below(spark):
    rows = [(1, 0, 0, 230.0), (1, 1, 40, 100.0), (1, 2, 80, None), (1, 3, 120, 100.0), (1, 4, 160, float("nan")), (1, 5, 600, 230.0)]
    df = spark.createDataFrame(rows, "sensor_id long, seq long, time_ms long, distance double")
    assert by_key(segment.raw_dips(df, 215.0), "start_idx", "end_idx") == {1: [(0, 2), (2, 4)]}


def test_gates(spark):
    rows = [(1, i, 0, 1, 0, 5, d, m, 10.0, 1.0) for i, (d, m) in enumerate([(0.5, 194.9), (0.49, 100.0), (10.0, 100.0), (10.01, 100.0), (1.0, 195.0)])]
    df = spark.createDataFrame(rows, "sensor_id long, event_id long, start_idx long, end_idx long, time_ms long, samples long, duration double, min_depth double, variance double, avg_gradient double")
    assert sorted(r.event_id for r in segment.gate_events(df).collect()) == [0, 2]


def test_calibration(spark):
    rows = [(1, i, 40 * i, d) for i, d in enumerate([230.0, 229.6, 200.0, 200.4, 100.0])] + [(2, 0, 0, 6000.0)]
    df = spark.createDataFrame(rows, "sensor_id long, seq long, time_ms long, distance double")
    assert {r.sensor_id: r.baseline for r in segment.calibrate_mode(df).collect()} == {1: 200.0, 2: 0.0}  # the lowest of equals
    assert {r.sensor_id: r.baseline for r in segment.calibrate_mean(df, CompactParams(calibration_samples=2)).collect()} == {1: 229.8, 2: None}


def test_longest_stretch(spark):
    rows = [(1, i, t, d) for i, (t, d) in enumerate([(0, 230.0), (1000, 230.0), (1100, 100.0), (1200, 230.0), (2200, 221.0), (2300, 220.0), (2400, 250.0)])]
    df = spark.createDataFrame(rows, "sensor_id long, seq long, time_ms long, distance double")
    assert [tuple(r) for r in segment.longest_stretch_start(df).collect()] == [(1, 0, 0, 1000)]


def test_events_at_a_bound_are_not_below_it(spark):
    """Steps of 35 in the mean, whose doubles come to a little less, in batch and live."""
    depths = [230.0, 171.0, 206.62, 229.42, 225.72, 222.56, 165.16, 228.48]
    rows = spark.createDataFrame([(1, 1, i, 100 * i, d) for i, d in enumerate(depths)], "sensor_id long, event_id long, i long, time_ms long, distance double")
    event = segment.classify_events(segment.event_stats(rows)).first()
    assert event.avg_gradient < 35 and event.type == "Person/Bike"
    machine = LiveMachine(LiveParams())
    machine.baseline, machine.buffer = 230.0, [(100 * i, d) for i, d in enumerate(depths)]
    assert machine.judged()["type"] == "Person/Bike"
