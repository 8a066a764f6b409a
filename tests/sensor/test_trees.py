"""Trees as tables: exact splits against a plain trainer, fitted models as columns, rules and folds."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from dipfleet.functions.params import FEATURES
from dipfleet.operators import models, trees

NAMES = list(FEATURES)


@pytest.fixture(scope="module")
def table():
    rnd, rows = random.Random(41), []
    for i in range(160):
        y = int(i % 5 < 2)
        values = [float(rnd.randint(0, 12)) for _ in NAMES]
        values[5] = round(rnd.gauss(1500, 700) if y else rnd.gauss(3000, 900), 1)
        values[4] = round(rnd.gauss(9, 6) if y else rnd.gauss(20, 15), 1)
        rows.append((i, y, *values))
    return rows


@pytest.fixture(scope="module")
def dips(spark, table):
    return spark.createDataFrame(table, "dip_id long, is_vehicle int, " + ", ".join(f"{f} double" for f in NAMES)).repartition(3).cache()


def plain_tree(rows, params, model):
    """rows: (weight, y, features) -> {node: (feature, threshold, n, n_1)}."""
    gini = lambda n, k: 2.0 * (k / n) * (1.0 - k / n)
    out = {}

    def grow(node, rows, depth):
        n, n_1 = sum(w for w, _, _ in rows), sum(w * y for w, y, _ in rows)
        best = None
        if depth < params.depth and 0 < n_1 < n and n >= 2 * params.min_leaf:
            order = sorted(range(len(NAMES)), key=lambda k: (hashlib.md5(f"{params.seed}:{model}:{node}:{k}".encode()).hexdigest(), k))
            for k in sorted(order[: params.tried or len(NAMES)]):
                values = sorted({f[k] for _, _, f in rows})
                for v, u in zip(values, values[1:]):
                    left, left_1 = sum(w for w, _, f in rows if f[k] <= v), sum(w * y for w, y, f in rows if f[k] <= v)
                    if min(left, n - left) < params.min_leaf:
                        continue
                    gain = round(gini(n, n_1) - left / n * gini(left, left_1) - (n - left) / n * gini(n - left, n_1 - left_1), 12)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, k, (v + u) / 2)
        out[node] = (best[1] if best else None, best[2] if best else None, n, n_1)
        if best:
            grow(2 * node, [r for r in rows if r[2][best[1]] <= best[2]], depth + 1)
            grow(2 * node + 1, [r for r in rows if r[2][best[1]] > best[2]], depth + 1)

    grow(1, rows, 0)
    return out


def as_dict(nodes):
    out = {}
    for r in nodes.collect():
        out.setdefault(r.model, {})[r.node] = (r.feature, r.threshold, r.n, r.n_1)
    return out


def test_exact_tree(dips, table, monkeypatch):
    want = plain_tree([(1, r[1], r[2:]) for r in table], trees.TREE, 0)
    assert as_dict(trees.train_trees(trees.bagged(dips, trees.TREE, ["dip_id"]))) == {0: want} and len(want) > 5
    monkeypatch.setattr(trees, "STRETCHES", 2)
    monkeypatch.setattr(trees, "SMALL", 0)
    assert as_dict(trees.train_trees(trees.bagged(dips, trees.TREE, ["dip_id"]))) == {0: want}


def weight(seed, tree, row):
    u = (int(hashlib.md5(f"{seed}:{tree}:{row}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
    return sum(u >= p for p in trees.POISSON)


def walk(tree, f):
    node = 1
    while tree[node][0] is not None:
        node = 2 * node + (f[tree[node][0]] > tree[node][1])
    return tree[node][3] / tree[node][2]


def test_forest(spark, dips, table):
    params = trees.TreeParams(depth=4, min_leaf=3, tried=3, trees=7)
    want = {t: plain_tree([(w, r[1], r[2:]) for r in table if (w := weight(42, t, r[0]))], params, t) for t in range(7)}
    nodes = trees.train_trees(trees.bagged(dips, params, ["dip_id"]), params).cache()
    assert as_dict(nodes) == want
    scores = {r[0]: sum(walk(t, r[2:]) for t in want.values()) / 7 for r in table}
    for got in (trees.score_by_columns(dips, nodes), trees.score_by_nodes(dips, nodes, ["dip_id"], params.depth)):
        assert all(abs(r.ml_vehicle_prob - scores[r.dip_id]) < 1e-12 for r in got.collect())
    ranked = {r.feature: r.importance for r in trees.importances(nodes).collect()}
    assert len(ranked) == 9 and abs(sum(ranked.values()) - 1) < 1e-9 and max(ranked, key=ranked.get) in ("depth_variance", "avg_depth_gradient")


def test_fitted_models_as_columns(spark, dips):
    """Scores by columns are those of the model, for a forest and for a tree."""
    assembled = models.assemble_features(dips)
    for model in (models.train_random_forest(assembled), models.train_decision_tree(assembled)):
        nodes = trees.fitted_nodes(model, spark)
        want = {r.dip_id: (r.ml_vehicle_prob, r.ml_prediction, r.ml_prediction_label) for r in models.score_dips(model, assembled).collect()}
        for r in trees.score_by_columns(dips, nodes).collect():
            prob, prediction, label = want[r.dip_id]
            assert abs(r.ml_vehicle_prob - prob) < 1e-9 and (abs(prob - 0.5) < 1e-9 or (r.ml_prediction, r.ml_prediction_label) == (prediction, label))
        assert nodes.where("node = 1").agg(F.sum("n")).first()[0] > 0


def test_rules_are_the_paths_of_nodes(spark, dips, table):
    nodes = trees.train_trees(trees.bagged(dips, trees.TREE, ["dip_id"])).cache()
    for r in trees.rules(nodes).collect():
        rows = dips.where(r.path) if r.path else dips
        assert (rows.count(), rows.where("is_vehicle = 1").count()) == (r.n, r.n_1)
    assert trees.rules(nodes).count() == nodes.count()


def test_folds(dips, table):
    params = trees.TreeParams(depth=3, min_leaf=3, tried=3, trees=5)
    got = trees.cross_validated(dips.withColumn("fold", F.col("dip_id") % 4), ["dip_id"], params, folds=4).collect()
    assert sorted((r.fold, r.rows) for r in got) == [(k, 40) for k in range(4)]
    for r in got:
        forest = {t: plain_tree([(w, x[1], x[2:]) for x in table if x[0] % 4 != r.fold and (w := weight(42, t, f"{x[0]}:{r.fold}"))], params, r.fold * 5 + t) for t in range(5)}
        right = sum((sum(walk(t, x[2:]) for t in forest.values()) / 5 > 0.5) == bool(x[1]) for x in table if x[0] % 4 == r.fold)
        assert abs(r.accuracy - right / 40) < 1e-12
    assert abs(got[0].mean_accuracy - sum(r.accuracy for r in got) / 4) < 1e-12


def test_awkward_tables(spark, dips):
    assert trees.train_trees(trees.bagged(dips.limit(0), trees.TREE, ["dip_id"])).count() == 0
    one = trees.train_trees(trees.bagged(dips.where("is_vehicle = 1"), trees.TREE, ["dip_id"])).collect()
    assert [(r.node, r.feature, r.n, r.n_1) for r in one] == [(1, None, 64.0, 64.0)]
    empty = dips.withColumns({f: F.lit(None).cast("double") for f in NAMES})
    assert trees.train_trees(trees.bagged(empty, trees.TREE, ["dip_id"])).count() == 1
