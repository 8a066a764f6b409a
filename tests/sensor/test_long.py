"""Long series by buckets against the window forms, and points joined with intervals against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from dipfleet.functions.params import EventParams, LiveParams
from dipfleet.operators import intervals, longseries, segment
from tests.sensor.test_segments import HAND, STEPS

SAMPLES = "sensor_id long, seq long, time_ms long, distance double"


@pytest.fixture(scope="module")
def samples(spark):
    rnd, rows = random.Random(31), [(k, i, t, float(d)) for k, s in HAND.items() for i, (t, d) in enumerate(s)]
    for k in range(60):
        t, low = rnd.choice([-900, 0, 5]), False
        for i in range(rnd.randint(1, 150)):
            t += rnd.choice([0, *STEPS])
            low = not low if rnd.random() < 0.3 else low
            rows.append((k, i, t, rnd.choice([None, float("nan")]) if rnd.random() < 0.05 else float(rnd.randint(50, 210) if low else rnd.randint(216, 235))))
    rows += [(None, 0, 0, 100.0), (None, 1, 40, 100.0)]
    return spark.createDataFrame(rows, SAMPLES).repartition(4).cache()


def rows_of(df, columns):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.where("sensor_id is not null").select(*columns).collect())


@pytest.mark.parametrize("bucket", [40, 700, 9_000, 10_000_000])
def test_long_dips(samples, bucket):
    columns = ["sensor_id", "dip_id", "start_idx", "end_idx", "start_ms", "end_ms"]
    raw = segment.raw_dips(samples, 215.0)
    assert rows_of(longseries.long_raw_dips(samples, 215.0, bucket_ms=bucket), columns) == rows_of(raw, columns)
    assert rows_of(longseries.long_merge_dips(raw.where("sensor_id is not null"), 300, bucket_ms=bucket), columns) == rows_of(segment.merge_dips(raw, 300), columns)


@pytest.mark.parametrize("bucket", [40, 700, 9_000, 10_000_000])
def test_long_events(samples, bucket):
    columns = ["sensor_id", "event_id", "start_idx", "end_idx", "time_ms", "samples", "duration", "min_depth", "variance", "avg_gradient"]
    for params, rows in ((EventParams(), segment.segment_events(samples)), (LiveParams(), segment.segment_events_live(samples)), (LiveParams(buffer=6), segment.segment_events_live(samples, LiveParams(buffer=6)))):
        want = segment.event_stats(rows)
        got = rows_of(longseries.long_events(samples, params, bucket_ms=bucket), columns)
        assert len(got) > 100 and got == rows_of(want, columns)


def test_no_task_holds_a_series(spark):
    """One sensor of 40,000 rows in buckets of 100: rows are shuffled by key and bucket, and no window has the key alone."""
    rows = spark.range(40_000).select(F.lit(1).cast("long").alias("sensor_id"), F.col("id").alias("seq"), (F.col("id") * 50).alias("time_ms"), F.when(F.col("id") % 40 < 5, 100.0).otherwise(230.0).alias("distance"))
    dips = longseries.long_raw_dips(rows, 220.0, bucket_ms=5_000)
    assert dips.count() == 1_000
    local = longseries._local(rows, 220.0, ("sensor_id",), 5_000)
    assert local.groupBy("_bucket").count().agg(F.max("count")).first()[0] == 100
    plan = dips._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x or "Window(" in x]
    assert all("_bucket" in x for x in windows)


def pairs(points, spans):
    return sorted((str(k), i, d) for k, i in points for s, d, a, b in spans if s == k and None not in (k, i, a, b) and a <= i <= b)


def test_interval_join(spark):
    rnd = random.Random(32)
    points = [(rnd.randint(0, 3), rnd.randint(-20, 300)) for _ in range(600)] + [(0, 5)] * 300 + [(None, 5), (1, None)]
    spans = [(rnd.randint(0, 3), d, a := rnd.randint(-30, 290), a + rnd.choice([0, 1, 3, 10, 200, -4])) for d in range(60)]
    spans += [(0, 100, 5, 5), (0, 101, 5, 9), (0, 102, 0, 5), (0, 103, -100_000, 1_000_000), (None, 104, 0, 9), (1, 105, None, 9), (2, 106, 7, 7), (2, 106, 7, 7)]
    left = spark.createDataFrame(points, "sensor_id long, i long").withColumn("note", F.lit("x")).repartition(5)
    right = spark.createDataFrame(spans, "sensor_id long, dip_id long, start_idx long, end_idx long").repartition(3)
    want = pairs(points, spans)
    for width, hot in ((None, 100_000), (1, 20), (7, 20), (1000, 50), (None, 1)):
        got = intervals.dip_rows(left, right, width=width, hot_rows=hot)
        assert sorted((str(r.sensor_id), r.i, r.dip_id) for r in got.collect()) == want, (width, hot)
    assert set(got.columns) == {"sensor_id", "i", "note", "dip_id", "start_idx", "end_idx"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_interval_join_of_nothing(spark):
    left, right = spark.createDataFrame([], "sensor_id long, i long"), spark.createDataFrame([], "sensor_id long, dip_id long, start_idx long, end_idx long")
    one = spark.createDataFrame([(1, 2)], "sensor_id long, i long")
    assert intervals.dip_rows(left, right).count() == intervals.dip_rows(one, right).count() == 0
    with pytest.raises(ValueError):
        intervals.dip_rows(one.withColumn("dip_id", F.lit(1)), right)
