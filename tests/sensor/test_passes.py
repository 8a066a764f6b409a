"""Inputs that cost much are passed over once or twice, not for each step that needs them."""

from dipfleet.jobs import registry
from dipfleet.operators import intervals


def test_points_are_counted_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for rows in batches:
            seen.add(len(rows))
            yield rows

    points = spark.createDataFrame([(k % 3, k) for k in range(300)], "sensor_id long, i long").mapInPandas(told, "sensor_id long, i long")
    spans = spark.createDataFrame([(0, 3, 30), (1, 100, 120)], "sensor_id long, start_idx long, end_idx long")
    assert intervals.interval_join(points, spans).count() == 10 + 7
    assert seen.value <= 2 * 300


def test_split_dips_are_computed_once(spark):
    plan = registry._split(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
