"""Decision trees and forests as tables of nodes: trained level by level for any number of models at once, or taken from a fitted
MLlib model; read as rules, and scored as Spark columns.

A node table has `model, node` (1 is the root, node k has the children 2k and 2k + 1), `feature` (its place, null in a leaf),
`threshold` (a value up to it goes to 2k), `n, n_1` (weight of all rows and of those of class 1), `gain` (of impurity).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import DecisionTreeClassificationModel, RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dipfleet.functions.params import FEATURES
from dipfleet.functions.series import so_far
from dipfleet.functions.storage import checkpointed

NODES = "model long, node long, feature int, threshold double, n double, n_1 double, gain double"
#: Of a Poisson law of mean 1: the probabilities of at most 0, 1, 2, 3, 4 and 5.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
#: Stretches that the values of a feature are summed in.
STRETCHES = 16
#: Split nodes that are broadcast to the rows at most.
SMALL = 200_000


@dataclass(frozen=True)
class TreeParams:
    """`tried`: features that a split chooses from, drawn for each node by a hash; all by default."""

    depth: int = 3
    min_leaf: int = 5
    tried: int | None = None
    trees: int = 1
    seed: int = 42


TREE, FOREST = TreeParams(), TreeParams(depth=5, min_leaf=3, tried=3, trees=50)


def bagged(rows: DataFrame, params: TreeParams, row_id: Sequence[str], first: Column | int = 0) -> DataFrame:
    """A copy of each row for each tree that draws it, with `model` (from `first` on) and `weight`: how often it does, by a Poisson
    law. The draw is a hash of seed, tree and row, so it is the same in every run and every engine."""
    if params.trees == 1:
        return rows.withColumns({"model": F.lit(first).cast("long") if isinstance(first, int) else first, "weight": F.lit(1)})
    drawn = rows.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(params.trees - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(str(params.seed)), F.col("_tree").cast("string"), *[F.col(c).cast("string") for c in row_id]))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    weight = sum(((F.col("_u") >= p).cast("int") for p in POISSON), F.lit(0))
    first = F.lit(first) if isinstance(first, int) else first
    return drawn.withColumn("_u", u).withColumns({"weight": weight, "model": (first + F.col("_tree")).cast("long")}).where("weight > 0").drop("_u", "_tree")


def _gini(n: Column, n_1: Column) -> Column:
    return 2.0 * (n_1 / n) * (1.0 - n_1 / n)


def _candidates(rows: DataFrame, open_nodes: DataFrame, bounds: Sequence[Sequence[float]], params: TreeParams) -> DataFrame:
    """Every split of every open node with rows enough on both sides: weights on the left, threshold and gain.

    Equal values are summed first. Weights up to a value are sums within stretches of the values and over the stretches before:
    no task sorts a node.
    """
    edges = F.array(*[F.array(*[F.lit(float(b)) for b in of]).cast("array<double>") for of in bounds])
    tried = rows.join(open_nodes, ["model", "node"]).withColumn("feature", F.explode("chosen")).withColumn("value", F.get(F.col("f"), F.col("feature")))
    by = ["model", "node", "feature"]
    sums = tried.groupBy(*by, "n", "n_1", "value").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("y")).alias("w_1"))
    sums = sums.withColumn("stretch", F.size(F.filter(F.get(edges, F.col("feature")), lambda b: b < F.col("value"))))
    inside = Window.partitionBy(*by, "stretch").orderBy("value")
    sums = sums.withColumns({"l": F.sum("w").over(so_far(inside)), "l_1": F.sum("w_1").over(so_far(inside)), "next": F.lead("value").over(inside)})
    totals = sums.groupBy(*by, "stretch").agg(F.sum("w").alias("w"), F.sum("w_1").alias("w_1"), F.min("value").alias("least"))
    order = Window.partitionBy(*by).orderBy("stretch")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "stretch", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("b"), F.coalesce(F.sum("w_1").over(before), F.lit(0)).alias("b_1"), F.lead("least").over(order).alias("then"))
    splits = sums.join(totals, [*by, "stretch"]).withColumns({"l": (F.col("l") + F.col("b")).cast("double"), "l_1": (F.col("l_1") + F.col("b_1")).cast("double"), "next": F.coalesce("next", "then")})
    splits = splits.where(F.col("next").isNotNull() & (F.col("l") >= params.min_leaf) & (F.col("n") - F.col("l") >= params.min_leaf))
    r, r_1 = F.col("n") - F.col("l"), F.col("n_1") - F.col("l_1")
    gain = _gini(F.col("n"), F.col("n_1")) - F.col("l") / F.col("n") * _gini(F.col("l"), F.col("l_1")) - r / F.col("n") * _gini(r, r_1)
    return splits.select(*by, "l", "l_1", ((F.col("value") + F.col("next")) / 2.0).alias("threshold"), F.round(gain, 12).alias("gain"))


def train_trees(rows: DataFrame, params: TreeParams = TREE, features: Sequence[str] = FEATURES, label: str = "is_vehicle") -> DataFrame:  # noqa: B008
    """The node table of one tree for each `model` among the rows (`model, weight`, features, and a label of 0 or 1).

    Splits are exact: halfway between neighbouring values, by the most gain of Gini impurity (to twelve digits), then the first
    feature, then the lowest value; both sides weigh `min_leaf` or more. Each level of all trees is one job; rows meet the splits
    of their node by a broadcast while those are at most 200,000, and by a shuffle beyond. Null features count as 0. A model
    whose rows are all of one class, or too few, is its root; no rows give an empty table.
    """
    f = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    rows = checkpointed(rows.select(F.col("model").cast("long").alias("model"), F.lit(1).cast("long").alias("node"), F.col("weight").cast("long").alias("weight"), F.col(label).cast("long").alias("y"), f.alias("f")))
    shares = [k / STRETCHES for k in range(1, STRETCHES)]
    cuts = rows.agg(*[F.percentile_approx(F.get("f", F.lit(k)), shares, 1000).alias(f"c{k}") for k in range(len(features))]).first()
    bounds = [sorted(set(c or ())) for c in cuts]
    frontier = checkpointed(rows.groupBy("model", "node").agg(F.sum("weight").cast("double").alias("n"), F.sum(F.col("weight") * F.col("y")).cast("double").alias("n_1")))
    draws = F.array_sort(F.array(*[F.struct(F.md5(F.concat_ws(":", F.lit(str(params.seed)), F.col("model").cast("string"), F.col("node").cast("string"), F.lit(str(k)))).alias("h"), F.lit(k).alias("k")) for k in range(len(features))]))
    chosen = F.transform(F.slice(draws, 1, params.tried), lambda d: d["k"]) if params.tried else F.array(*[F.lit(k) for k in range(len(features))])
    nodes = None
    for level in range(params.depth + 1):
        splits, few = None, 0
        if level < params.depth:
            open_nodes = frontier.where(F.col("n_1").between(1, F.col("n") - 1) & (F.col("n") >= 2 * params.min_leaf)).withColumn("chosen", chosen)
            best = F.max_by(F.struct("feature", "threshold", "gain", "l", "l_1"), F.struct("gain", -F.col("feature"), -F.col("threshold"))).alias("s")
            splits = checkpointed(_candidates(rows, open_nodes, bounds, params).groupBy("model", "node").agg(best).select("model", "node", "s.*").where("gain > 0"))
            few = splits.count()
        leaves = F.lit(None).cast
        here = frontier.join(splits, ["model", "node"], "left") if few else frontier.withColumns({"feature": leaves("int"), "threshold": leaves("double"), "gain": leaves("double")})
        here = here.select("model", "node", F.col("feature").cast("int").alias("feature"), "threshold", "n", "n_1", "gain")
        nodes = here if nodes is None else nodes.unionByName(here)
        if not few:
            break
        halves = frontier.join(splits, ["model", "node"]).select("model", F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("n"), F.col("l_1").alias("n_1")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("n") - F.col("l")).alias("n"), (F.col("n_1") - F.col("l_1")).alias("n_1")))).alias("h")).select("model", "h.*")
        frontier = checkpointed(halves)
        sized = F.broadcast if few <= SMALL else (lambda df: df)
        side = F.when(F.get(F.col("f"), F.col("feature")) <= F.col("threshold"), 0).otherwise(1)
        rows = rows.join(sized(splits.select("model", "node", "feature", "threshold")), ["model", "node"]).select("model", (F.col("node") * 2 + side).alias("node"), "weight", "y", "f")
    return nodes


def fitted_nodes(model: DecisionTreeClassificationModel | RandomForestClassificationModel, spark: SparkSession) -> DataFrame:
    """The node table of a fitted MLlib tree or forest with numeric features and two classes; trees count from 0."""
    trees = model.trees if isinstance(model, RandomForestClassificationModel) else [model]
    rows: list[tuple] = []

    def walk(tree: int, node: int, at) -> None:
        counts = list(at.impurityStats().stats())
        split = at.split() if at.subtreeDepth() > 0 else None
        rows.append((tree, node, split.featureIndex() if split else None, float(split.threshold()) if split else None, float(sum(counts)), float(counts[1]), float(at.gain()) if split else None))
        if split:
            walk(tree, 2 * node, at.leftChild())
            walk(tree, 2 * node + 1, at.rightChild())

    for k, tree in enumerate(trees):  # as many nodes as the model has
        walk(k, 1, tree._java_obj.rootNode())
    return spark.createDataFrame(rows, NODES)


def as_columns(nodes: DataFrame, features: Sequence[str] = FEATURES) -> dict[int, Column]:
    """For each model, the share of class 1 in the leaf of a row, as an expression of the features. Reads the node table to the
    driver: it is as large as the models, not as their data."""
    table: dict[int, dict[int, tuple]] = {}
    for r in nodes.collect():
        table.setdefault(r.model, {})[r.node] = (r.feature, r.threshold, r.n_1 / r.n if r.n else 0.0)

    def at(tree: Mapping[int, tuple], node: int) -> Column:
        feature, threshold, share = tree[node]
        if feature is None:
            return F.lit(share)
        return F.when(F.coalesce(F.col(features[feature]).cast("double"), F.lit(0.0)) <= threshold, at(tree, 2 * node)).otherwise(at(tree, 2 * node + 1))

    return {model: at(tree, 1) for model, tree in sorted(table.items())}


def score_by_columns(dips: DataFrame, nodes: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Adds `ml_vehicle_prob` (the mean over all models of the table), `ml_prediction` and its label, all within generated code."""
    from dipfleet.operators.models import prediction_label

    columns = list(as_columns(nodes, features).values())
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    scored = dips.withColumn("ml_vehicle_prob", total / float(len(columns)))
    scored = scored.withColumn("ml_prediction", (F.col("ml_vehicle_prob") > 0.5).cast("int"))
    return scored.withColumn("ml_prediction_label", prediction_label(F.col("ml_prediction")))


def score_by_nodes(dips: DataFrame, nodes: DataFrame, row_id: Sequence[str], depth: int, features: Sequence[str] = FEATURES, groups: str | None = None) -> DataFrame:
    """`row_id` and the mean share of class 1, by joins alone: every row walks down every tree of its `groups` (all trees where that is
    None). For models too many to be columns."""
    keys = ["model", "node"]
    named = nodes.select(*keys, "feature", "threshold", (F.col("n_1") / F.col("n")).alias("share"), *([groups] if groups else []))
    f = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    rows = dips.select(*row_id, f.alias("f"), *([groups] if groups else []))
    roots = named.where("node = 1").select("model", "node", *([groups] if groups else []))
    at = rows.join(roots, groups) if groups else rows.join(F.broadcast(roots))  # a row for each model
    walk = named.drop(groups) if groups else named
    for _ in range(depth):
        step = at.join(walk.where("feature is not null").drop("share"), keys, "left")
        side = F.when(F.get(F.col("f"), F.col("feature")) <= F.col("threshold"), 0).otherwise(1)
        at = step.withColumn("node", F.when(F.col("feature").isNull(), F.col("node")).otherwise(F.col("node") * 2 + side)).drop("feature", "threshold")
    return at.join(walk.drop("feature", "threshold"), keys).groupBy(*row_id).agg(F.avg("share").alias("ml_vehicle_prob"))


def rules(nodes: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """The node table in words: `path` is the condition of each node, features by name."""
    names = F.array(*[F.lit(f) for f in features])
    mine = nodes.withColumn("name", F.get(names, F.col("feature")))
    paths = mine.where("node = 1").select("model", "node", F.lit("").alias("path"))
    found, level = paths, paths
    parents = mine.where("feature is not null").select("model", "node", "name", F.col("threshold").cast("string").alias("t"))
    depth = (nodes.agg(F.max("node")).first()[0] or 1).bit_length() - 1
    for _ in range(depth):
        step = level.join(parents, ["model", "node"])
        both = F.array(*[F.struct((F.col("node") * 2 + k).alias("node"), F.concat_ws(" and ", F.nullif(F.col("path"), F.lit("")), F.concat("name", F.lit(op), "t")).alias("path")) for k, op in ((0, " <= "), (1, " > "))])
        level = step.select("model", F.explode(both).alias("b")).select("model", "b.*")
        found = found.unionByName(level)
    return mine.join(found, ["model", "node"]).select("model", "node", "path", F.col("name").alias("feature"), "threshold", "n", "n_1", "gain")


def importances(nodes: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """`feature, importance`: the gains of a feature's splits, weighed by their rows, as shares of each tree's and averaged over all trees with a
    split."""
    split = nodes.where("feature is not null").groupBy("model", "feature").agg(F.sum(F.col("n") * F.col("gain")).alias("g"))
    share = split.withColumn("g", F.col("g") / F.sum("g").over(Window.partitionBy("model")))
    trees = share.agg(F.countDistinct("model").alias("_trees"))
    summed = share.groupBy("feature").agg(F.sum("g").alias("g")).join(F.broadcast(trees))  # one row
    names = nodes.sparkSession.createDataFrame(list(enumerate(features)), "feature int, name string")
    return names.join(F.broadcast(summed), "feature", "left").select(F.col("name").alias("feature"), F.coalesce(F.col("g") / F.col("_trees"), F.lit(0.0)).alias("importance"))  # a row for each feature


def cross_validated(dips: DataFrame, row_id: Sequence[str], params: TreeParams = FOREST, features: Sequence[str] = FEATURES, label: str = "is_vehicle", fold: str = "fold", folds: int = 5) -> DataFrame:  # noqa: B008
    """`fold, rows, accuracy`, the mean accuracy and twice its deviation, of a forest for each fold trained on the other folds: all
    trees of all folds grow in the same jobs. `fold` numbers the folds of the rows from 0."""
    others = dips.withColumn("_for", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where(F.col("_for") != F.col(fold))
    drawn = bagged(others, params, [*row_id, "_for"], F.col("_for") * params.trees)
    nodes = train_trees(drawn, params, features, label).withColumn(fold, F.floor(F.col("model") / params.trees).cast("int"))
    scored = dips.select(*row_id, label).join(score_by_nodes(dips.withColumn(fold, F.col(fold).cast("int")), nodes, [*row_id, fold], params.depth, features, fold), list(row_id))
    per = scored.groupBy(fold).agg(F.count("*").alias("rows"), F.avg(((F.col("ml_vehicle_prob") > 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy"))
    w = Window.partitionBy()
    return per.withColumns({"mean_accuracy": F.avg("accuracy").over(w), "two_std": F.stddev_pop("accuracy").over(w) * 2})  # a row for each fold
