"""Tree models on a separable set: accuracy, importance, rules, splits and scores."""

import random

import pytest
from pyspark.sql import functions as F

from dipfleet.functions.params import FEATURES
from dipfleet.operators import models



def order():
    return [models.hashed("dip_id"), "dip_id"]


@pytest.fixture(scope="module")
def dips(spark):
    """Vehicles have a low variance and gradient; the other features say nothing."""
    rnd, rows = random.Random(21), []
    for i in range(400):
        vehicle = i % 5 < 2
        values = {f: rnd.uniform(0, 100) for f in FEATURES}
        values["depth_variance"] = rnd.gauss(1500, 300) if vehicle else rnd.gauss(6000, 900)
        values["avg_depth_gradient"] = rnd.gauss(9, 3) if vehicle else rnd.gauss(60, 15)
        rows.append((i, "V" if vehicle else rnd.choice("PBN"), *values.values()))
    df = spark.createDataFrame(rows, "dip_id long, object string, " + ", ".join(f"{f} double" for f in FEATURES))
    return models.assemble_features(models.fill_missing_features(models.label_is_vehicle(df))).cache()


def test_split_is_exact_and_stratified(dips):
    split = models.stratified_split(dips, order(), stretch=F.shiftright(models.hashed("dip_id"), 52))
    n = {(r.is_vehicle, r.in_test): r.n for r in split.groupBy("is_vehicle", "in_test").agg(F.count("*").alias("n")).collect()}
    assert n == {(1, True): 48, (1, False): 112, (0, True): 72, (0, False): 168}
    assert split.where("in_test = in_train").count() == 0
    plain = models.stratified_split(dips, order()).where("in_test").select("dip_id")
    assert sorted(plain.collect()) == sorted(split.where("in_test").select("dip_id").collect())


def test_forest_scores_and_importance(spark, dips):
    split = models.stratified_split(dips, order())
    model = models.train_random_forest(split.where("in_train"))
    scored = models.score_dips(model, split)
    tested = scored.where("in_test")
    assert tested.where("ml_prediction = is_vehicle").count() >= 0.93 * tested.count()
    assert scored.where("ml_vehicle_prob < 0 or ml_vehicle_prob > 1 or (ml_vehicle_prob > 0.5 and ml_prediction = 0) or (ml_vehicle_prob < 0.5 and ml_prediction = 1)").count() == 0
    assert scored.where("(ml_prediction_label = 'Vehicle') <> (ml_prediction = 1)").count() == 0
    ranked = [(r.feature, r.importance) for r in models.feature_importance(model, spark).collect()]
    assert {f for f, _ in ranked[:2]} == {"depth_variance", "avg_depth_gradient"} and abs(sum(v for _, v in ranked) - 1) < 1e-9 and ranked[1][1] > 5 * ranked[2][1]


def test_cross_validation(dips):
    rows = models.cross_validate(dips, order()).collect()
    assert sorted(r.fold for r in rows) == [0, 1, 2, 3, 4] and rows[0].mean_accuracy >= 0.96
    assert abs(rows[0].mean_accuracy - sum(r.accuracy for r in rows) / 5) < 1e-9 and rows[0].two_std >= 0


def test_tree_rules_name_features(spark, dips):
    rules = [r.rule for r in models.tree_rules(models.train_decision_tree(dips), spark).orderBy("line").collect()]
    assert any("depth_variance" in r or "avg_depth_gradient" in r for r in rules) and not any("feature " in r for r in rules[1:])


def test_small_sets_are_in_both_parts(spark, dips):
    split = models.stratified_split(dips.limit(12), order())
    assert split.where("in_train and in_test").count() == 12
