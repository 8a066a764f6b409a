"""Tree models that tell vehicles from other dips, and their reports."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from dipfleet.functions.params import FEATURES, RULE_GRADIENT, RULE_VARIANCE
from dipfleet.functions.series import numbered


def label_is_vehicle(dips: DataFrame) -> DataFrame:
    return dips.withColumn("is_vehicle", F.coalesce(F.col("object") == "V", F.lit(False)).cast("int"))


def fill_missing_features(dips: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Null and NaN features become 0."""
    return dips.na.fill(0.0, list(features))


def assemble_features(dips: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(dips)


def prediction_label(prediction: Column) -> Column:
    return F.when(prediction == 1, "Vehicle").otherwise("Non-Vehicle")


def rule_score(dips: DataFrame) -> DataFrame:
    """The published single-threshold rules as predictions."""
    return dips.withColumns({"rule_variance": (F.col("depth_variance") <= RULE_VARIANCE).cast("int"), "rule_gradient": (F.col("avg_depth_gradient") <= RULE_GRADIENT).cast("int")})


def stratified_split(dips: DataFrame, order: Sequence[str | Column], test_share: float = 0.3, label: str = "is_vehicle", least: int = 20, stretch: Column | None = None) -> DataFrame:
    """Adds `in_train` and `in_test`: an exact stratified split. Of each label the first rows in `order` are tested, floor(share x n) of
    them, and the largest remainders get one more up to ceil(share x all); with fewer than `least` rows both hold all. `stretch` cuts the order
    into stretches that are sorted apart; by default quantiles of its first column do."""
    share = F.lit(test_share)
    sizes = dips.groupBy(label).agg(F.count("*").alias("_of"))
    everything = Window.partitionBy()
    sizes = sizes.withColumns({"_all": F.sum("_of").over(everything), "_quota": F.floor(F.col("_of") * share)})
    extra = F.ceil(F.col("_all") * share) - F.sum("_quota").over(everything)
    sizes = sizes.withColumn("_extra", extra).withColumn("_rank", F.row_number().over(Window.orderBy((F.col("_of") * share - F.col("_quota")).desc(), F.col(label))))
    sizes = sizes.withColumn("_quota", F.col("_quota") + (F.col("_rank") <= F.col("_extra")).cast("long"))  # a row for each label
    ranked = numbered(dips, label, stretches(dips, order[0]) if stretch is None else stretch, order, "_r").join(F.broadcast(sizes), label)
    test = (F.col("_all") < least) | (F.col("_r") <= F.col("_quota"))
    return ranked.withColumns({"in_test": test, "in_train": (F.col("_all") < least) | ~test}).drop("_of", "_all", "_quota", "_extra", "_rank", "_r")


def stretches(df: DataFrame, first: str | Column, n: int = 64) -> Column:
    """Which of some `n` stretches of about equal size a row lies in, by the first column of an order: it never falls as that
    rises. Text and other values without quantiles are a stretch each."""
    first = F.col(first) if isinstance(first, str) else first
    if not isinstance(df.select(first.alias("v")).schema["v"].dataType, NumericType):
        return first
    cuts = df.agg(F.percentile_approx(first, [k / n for k in range(1, n)], 1000).alias("c")).first()["c"] or []
    return F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < first)) if cuts else F.lit(0)


def hashed(*columns: str, seed: int = 42) -> Column:
    return F.xxhash64(*columns, F.lit(seed))


def train_random_forest(train: DataFrame, label: str = "is_vehicle", seed: int = 42) -> RandomForestClassificationModel:
    return RandomForestClassifier(labelCol=label, numTrees=50, maxDepth=5, minInstancesPerNode=3, seed=seed).fit(train)


def train_decision_tree(train: DataFrame, label: str = "is_vehicle", seed: int = 42) -> DecisionTreeClassificationModel:
    return DecisionTreeClassifier(labelCol=label, maxDepth=3, minInstancesPerNode=5, seed=seed).fit(train)


def cross_validate(assembled: DataFrame, order: Sequence[str | Column], folds: int = 5, label: str = "is_vehicle", stretch: Column | None = None) -> DataFrame:
    """Accuracy of the forest per fold with their mean and twice their deviation; folds are stratified by label. All folds are
    fitted at once, and their scores are one job."""
    spark = assembled.sparkSession
    dealt = numbered(assembled, label, stretches(assembled, order[0]) if stretch is None else stretch, order, "_n").withColumn("_fold", F.pmod("_n", F.lit(folds)).cast("int")).drop("_n").cache()
    with ThreadPool(folds) as pool:
        fitted = pool.map(inheritable_thread_target(spark)(lambda k: train_random_forest(dealt.where(F.col("_fold") != k), label)), range(folds))
    hits = None
    for k, model in enumerate(fitted):
        scored = model.transform(dealt.where(F.col("_fold") == k)).select("_fold", (F.col("prediction") == F.col(label)).cast("double").alias("hit"))
        hits = scored if hits is None else hits.unionByName(scored)
    rows = [(r["_fold"], r["accuracy"]) for r in hits.groupBy("_fold").agg(F.avg("hit").alias("accuracy")).orderBy("_fold").collect()]  # a row for each fold
    dealt.unpersist()
    w = Window.partitionBy()
    return spark.createDataFrame(rows, "fold int, accuracy double").withColumns({"mean_accuracy": F.avg("accuracy").over(w), "two_std": F.stddev_pop("accuracy").over(w) * 2})


def classification_report(scored: DataFrame, label: str = "is_vehicle", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, f1 and support per class, then accuracy, macro and weighted averages; 0 where undefined."""
    cells = scored.groupBy(F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("p")).agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("double")
    classes = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("class")) for k, c in ((0, "Non-Vehicle"), (1, "Vehicle"))])
    both = cells.withColumn("_c", F.explode(classes)).select("y", "p", "n", "_c.*")
    y, p = F.col("y") == F.col("k"), F.col("p") == F.col("k")
    per = both.groupBy("class").agg(total(y & p).alias("tp"), total(p).alias("predicted"), total(y).alias("support"), F.sum("n").cast("double").alias("all"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per = per.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    wanted = ["class", "precision", "recall", "f1", "support"]
    accuracy = F.sum("tp") / F.first("all")
    overall = per.agg(F.lit("accuracy").alias("class"), accuracy.alias("precision"), accuracy.alias("recall"), accuracy.alias("f1"), F.sum("support").alias("support"))
    macro = per.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in wanted[1:4]], F.sum("support").alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("class"), *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in wanted[1:4]], F.sum("support").alias("support"))
    return per.select(wanted).unionByName(overall).unionByName(macro).unionByName(weighted)


def feature_importance(model: RandomForestClassificationModel, spark, features: Sequence[str] = FEATURES) -> DataFrame:
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def tree_rules(model: DecisionTreeClassificationModel, spark, features: Sequence[str] = FEATURES) -> DataFrame:
    """The tree as lines of text, features by name."""
    text = model.toDebugString
    for i in reversed(range(len(features))):
        text = text.replace(f"feature {i} ", f"{features[i]} ")
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.splitlines())], "line int, rule string")


def score_dips(model, assembled: DataFrame) -> DataFrame:
    """Probability of a vehicle, prediction and label on all rows."""
    scored = model.transform(assembled)
    return scored.withColumns({"ml_vehicle_prob": vector_to_array("probability")[1], "ml_prediction": F.col("prediction").cast("int"), "ml_prediction_label": prediction_label(F.col("prediction"))}).drop("features", "rawPrediction", "probability", "prediction")
