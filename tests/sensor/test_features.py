"""Golden dips: features recomputed from stored arrays and from rows."""

import pytest
from pyspark.sql import functions as F

from dipfleet.operators import features, models

NAMES = ["max_depth", "min_depth", "avg_depth", "line_integral", "avg_depth_gradient", "max_depth_gradient", "depth_variance", "depth_fourth_moment", "dip_height", "fill_factor", "plateau_variance"]
GOLDEN = {
    3: ([231, 74, 74, 88, 227, 81, 227], [231, 74, 143.1428571, 128.8333333, 100.3333333, 157, 5463.836735, 32621371.92, 157, 0.6507430998, 4158.1875], "Boxy_Irregular"),
    8: ([225, 71, 72, 72, 225, 226, 226, 225, 225, 70, 226], [226, 70, 169.3636364, 163.75, 62.1, 156, 5501.140496, 40001317.73, 156, 0.3990384615, 5236.222222], "Peaked_Irregular (Likely Pedestrian/Bike)"),
    11: ([225, 16, 16, 225, 185, 225], [225, 16, 148.6666667, 133.4, 99.6, 209, 9000.222222, 120524666.7, 209, 0.438277512, 9706.888889], "Peaked_Irregular (Likely Pedestrian/Bike)"),
    20: ([100, 100, 100], [100, 100, 100, 100, 0, 0, 0, 0, 0, 0, 0], "Noise"),
    21: ([230, 100], [230, 100, 165, 165, 130, 130, 4225, 17850625, 0, 0, 0], "Undefined"),
}


def check(rows):
    for r in rows:
        _, want, shape = GOLDEN[r.dip_id]
        for name, value in zip(NAMES, want):
            assert r[name] == pytest.approx(value, rel=1e-8, abs=1e-8), (r.dip_id, name)
        assert r.shape_category == shape
    assert len(rows) == len(GOLDEN)


def test_from_arrays(spark):
    df = spark.createDataFrame([(k, [float(x) for x in a]) for k, (a, _, _) in GOLDEN.items()], "dip_id long, dip_array array<double>")
    check(features.features_of_arrays(df).collect())
    empty = features.features_of_arrays(spark.createDataFrame([(1, []), (2, None), (3, [5.0])], "dip_id long, dip_array array<double>")).collect()
    assert all(r.line_integral == 0 and r.avg_depth_gradient == 0 and r.shape_category == "Undefined" for r in empty)


def test_from_rows(spark):
    rows = [(1, k, i, i, 40 * i, float(d)) for k, (a, _, _) in GOLDEN.items() for i, d in enumerate(a)]
    df = spark.createDataFrame(rows, "sensor_id long, dip_id long, i long, seq long, time_ms long, distance double")
    dips = features.dip_features(df)
    check(dips.collect())
    assert {r.dip_id: r.dip_array for r in features.dip_arrays(df).collect()} == {k: [float(x) for x in a] for k, (a, _, _) in GOLDEN.items()}
    summary = features.dip_summary(dips).where("sensor_id is null").first()
    assert summary.dips == 5 and summary.least_depth == 16


def test_object_order(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (0.0, 0.0, 0.1), (0.0, 0.2, 0.1), (0.1, 0.2, 0.1)], "v double, b double, p double")
    assert [r[0] for r in df.select(features.dip_object(F.col("v"), F.col("b"), F.col("p"))).collect()] == ["N", "P", "B", "V"]


def test_split_report_and_rules(spark):
    df = spark.createDataFrame([(i, int(i < 24)) for i in range(45)], "id long, is_vehicle int")
    split = models.stratified_split(df, ["id"])
    assert split.where("in_test").count() == 14 and split.where("in_train").count() == 31 and split.where("in_test and is_vehicle = 1").count() == 7
    small = models.stratified_split(df.where("id < 10"), ["id"])
    assert small.where("in_test and in_train").count() == 10
    report = {r["class"]: r for r in models.classification_report(spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 0)] * 4, "is_vehicle int, prediction int")).collect()}
    assert report["Vehicle"].recall == 0.75 and report["Vehicle"].precision == 1 and report["Non-Vehicle"].precision == 0.8 and report["accuracy"].f1 == 0.875
    filled = models.fill_missing_features(spark.createDataFrame([(None, float("nan"))], "min_depth double, avg_depth double"), ["min_depth", "avg_depth"]).first()
    assert tuple(filled) == (0.0, 0.0)


@pytest.mark.parametrize("depths", [[242.15, 208.52, 185.02, 179.02, 172.53, 236.64], [249.35, 140.4, 178.79, 151.75, 159.33, 203.43, 225.64]])
def test_fill_factors_at_their_bound_are_judged_as_in_sql(spark, depths):
    """13/20 exactly: the sum from the last to the first lies above, the other way below."""
    df = spark.createDataFrame([(1, 1, i, 40 * i, d) for i, d in enumerate(depths)], "sensor_id long, dip_id long, i long, time_ms long, distance double")
    for dips in (features.dip_features(df), features.features_of_arrays(features.dip_arrays(df))):
        r = dips.first()
        assert r.fill_factor > 0.65 and r.shape_category == "Boxy_Irregular"
