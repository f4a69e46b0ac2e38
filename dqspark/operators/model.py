"""The good/bad classifier on dataset features, with MLlib."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F

from dqspark.functions.ordering import row_positions
from dqspark.functions.scalars import col
from dqspark.functions.scratch import written
from dqspark.operators.features import FEATURES8
from dqspark.operators.quality import rating

# Settings of the production forest and the promotion rule.
FOREST = {"numTrees": 100, "maxDepth": 15, "minInstancesPerNode": 2, "seed": 42}
BETTER, WORSE, BETTER_NEEDED = 0.02, -0.01, 2
SWEEP_TREES, DEPTHS = 200, (2, 3, 5, 7, 10, 15, 20)
PENALTIES = (0.001, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0)
CURVE_FOLDS, SHARES = 5, (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
# Fits that run side by side: one on a training table leaves most of a cluster idle.
FITS_AT_ONCE = 8
METRICS = ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "auc_roc")


def with_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced class weights: rows / (classes * rows of the class)."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total = sum(counts.values())
    weight: Column = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(col(label) == value, total / (len(counts) * n)).otherwise(weight)
    return df.withColumn("weight", weight)


def _stages(names: Sequence[str], *learner) -> Pipeline:
    clean = [f"__{n}" for n in names]
    return Pipeline(stages=[
        Imputer(inputCols=list(names), outputCols=clean, strategy="mean"),
        VectorAssembler(inputCols=clean, outputCol="vector"),
        *learner,
    ])


def _forest(**settings) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="vector", labelCol="label", weightCol="weight", **{**FOREST, **settings})


def _penalty(c: float, rows: int) -> float:
    return 1.0 / (c * max(rows, 1))


def _logistic(penalty: float = 0.0) -> LogisticRegression:
    return LogisticRegression(featuresCol="vector", labelCol="label", weightCol="weight",
                              regParam=penalty, standardization=False, maxIter=200)


def forest(names: Sequence[str] = FEATURES8, **settings) -> Pipeline:
    return _stages(names, _forest(**settings))


def logistic(rows: int, names: Sequence[str] = FEATURES8, c: float = 0.1) -> Pipeline:
    return _stages(names, _logistic(_penalty(c, rows)))


def _typed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[col(n).cast("double").alias(n) for n in names], col("label").cast("double").alias("label"))


def train(df: DataFrame, names: Sequence[str] = FEATURES8, learner: Pipeline | None = None) -> PipelineModel:
    return (learner or forest(names)).fit(with_weights(_typed(df, names)))


def at_once(jobs: Sequence[Callable[[], Any]]) -> list[Any]:
    """The results of independent fits, ``FITS_AT_ONCE`` of them side by side."""
    if not jobs:
        return []
    with ThreadPool(min(FITS_AT_ONCE, len(jobs))) as pool:
        return pool.map(lambda job: job(), jobs, chunksize=1)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add quality, confidence (0-100) and both probabilities.

    A dataset without rows is BAD with certainty zero.
    """
    doubles = set(model.stages[0].getInputCols())
    typed = df.select(*[col(c).cast("double").alias(c) if c in doubles else col(c) for c in df.columns])
    out = model.transform(typed)
    p = vector_to_array("probability")
    good = F.col("prediction") == 1
    return out.select(
        *[col(c) for c in df.columns], F.col("prediction").cast("int").alias("prediction"),
        F.when(good, "GOOD").otherwise("BAD").alias("quality"),
        (F.when(good, p[1]).otherwise(p[0]) * 100).alias("score"),
        p[1].alias("probability_good"), p[0].alias("probability_bad"),
    )


def report(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Whole-number score, its word and the importance of every feature."""
    names = model.stages[0].getInputCols()
    weights = model.stages[-1].featureImportances.toArray().tolist()
    scored = score(model, df)
    whole = F.floor(F.col("probability_good") * 100).cast("int")
    importance = F.map_from_arrays(F.array(*[F.lit(n) for n in names]),
                                   F.array(*[F.lit(float(w)) for w in weights]))
    return scored.withColumn("quality_score", whole).withColumn(
        "rating", rating(F.col("quality_score"))).withColumn("feature_importance", importance)


# -- metrics -----------------------------------------------------------------

def confusion(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return predicted.groupBy(col(label).cast("int").alias("label"),
                             col(prediction).cast("int").alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def class_metrics(predicted: DataFrame, label: str = "label",
                  prediction: str = "prediction") -> DataFrame:
    """One row of accuracy, balanced accuracy, precision, recall and F1 of class 1."""
    y, p = col(label).cast("int"), col(prediction).cast("int")
    counts = predicted.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    tp, fp, fn, tn = [F.col(c) for c in ("tp", "fp", "fn", "tn")]
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(tp, tp + fp), zero)
    recall = F.coalesce(F.try_divide(tp, tp + fn), zero)
    sides = F.array_compact(F.array(F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)))
    balanced = F.try_divide(F.aggregate(sides, zero, lambda a, b: a + b), F.size(sides))
    return counts.select(
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        balanced.alias("balanced_accuracy"), precision.alias("precision"), recall.alias("recall"),
        F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero).alias("f1"),
        "tp", "fp", "fn", "tn")


def evaluate(predicted: DataFrame) -> dict[str, float]:
    """The six promotion metrics of scored rows as numbers."""
    row = class_metrics(predicted).first().asDict()
    pairs = predicted.select(col("label").cast("double").alias("label"),
                             F.col("probability_good").cast("double").alias("rawPrediction"))
    auc = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction").evaluate(pairs)
    return {**{m: row[m] for m in METRICS if m in row}, "auc_roc": float(auc)}


def stratified_folds(df: DataFrame, key: str, folds: int, seed: int = 42) -> DataFrame:
    """Add ``fold``: rows of each label dealt out in hash order."""
    out = None
    for value in (0, 1):
        part = df.where(col("label") == value).withColumn("__order", F.xxhash64(col(key), F.lit(seed)))
        dealt = row_positions(part, "__order", "__at").select(
            *[col(c) for c in df.columns], F.pmod(F.col("__at"), F.lit(folds)).cast("int").alias("fold"))
        out = dealt if out is None else out.unionByName(dealt)
    return out


def dealt_once(df: DataFrame, key: str, folds: int, seed: int = 42) -> DataFrame:
    """``stratified_folds`` written once: a fit makes many passes, each with as many tasks as the files need."""
    return written(stratified_folds(df, key, folds, seed), "folds")


def cross_validate(df: DataFrame, key: str, names: Sequence[str] = FEATURES8,
                   folds: int | None = None, **settings) -> DataFrame:
    """One row per fold with its metrics; two folds for two classes by default."""
    classes = df.select("label").distinct().count()
    folds = folds or min(5, classes)
    dealt = dealt_once(df, key, folds)

    def one(k: int) -> tuple:
        model = train(dealt.where(F.col("fold") != k), names, forest(names, **settings))
        found = evaluate(score(model, dealt.where(F.col("fold") == k)))
        return (k, *[float(found[m]) for m in METRICS])

    rows = at_once([lambda k=k: one(k) for k in range(folds)])
    return df.sparkSession.createDataFrame(rows, "fold INT, " + ", ".join(f"{m} DOUBLE" for m in METRICS))


def hold_out(df: DataFrame, key: str = "dataset_id", share: float = 0.2,
             seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; of each label the same share is taken, in hash order of the unique key."""
    parts = round(1 / share)
    dealt = dealt_once(df, key, parts, seed)
    return dealt.where("fold <> 0").drop("fold"), dealt.where("fold = 0").drop("fold")


def compare(predictions: Mapping[str, DataFrame]) -> DataFrame:
    """Models ranked by accuracy on the rows they scored."""
    out = None
    for name, df in predictions.items():
        row = class_metrics(df).select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.col("accuracy").desc(), "model")


# -- promotion ---------------------------------------------------------------

def promotion(pairs: DataFrame) -> DataFrame:
    """Deltas and decision for rows ``(current_*, candidate_*)`` of f1, balanced accuracy, AUC."""
    watched = ("f1", "balanced_accuracy", "auc_roc")
    out = pairs
    for m in watched:
        out = out.withColumn(f"{m}_delta", F.col(f"candidate_{m}") - F.col(f"current_{m}"))
    better: Column = F.lit(0)
    worse: Column = F.lit(0)
    for m in watched:
        better = better + (F.col(f"{m}_delta") > BETTER).cast("int")
        worse = worse + (F.col(f"{m}_delta") < WORSE).cast("int")
    return (
        out.withColumn("improved", better).withColumn("degraded", worse)
        .withColumn("promoted", (F.col("improved") >= BETTER_NEEDED) & (F.col("degraded") == 0))
        .withColumn("reason", F.when(F.col("promoted"), "meaningful improvement")
                    .when(F.col("degraded") > 0, "degradation detected")
                    .otherwise("insufficient improvement"))
    )


def shadow_validate(current: PipelineModel | None, candidate: PipelineModel,
                    test: DataFrame) -> DataFrame:
    """One row: both models on the same held-out rows, and whether to promote."""
    spark = test.sparkSession
    new = evaluate(score(candidate, test))
    old: dict[str, Any] = evaluate(score(current, test)) if current is not None else {}
    fields = [(f"current_{m}", old.get(m)) for m in METRICS] + [(f"candidate_{m}", new[m]) for m in METRICS]
    pairs = spark.createDataFrame([tuple(v for _, v in fields)], ", ".join(f"{n} DOUBLE" for n, _ in fields))
    decided = promotion(pairs)
    if current is None:
        decided = decided.withColumn("promoted", F.lit(True)).withColumn(
            "reason", F.lit("no current model"))
    return decided


def evaluate_by_label(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Accuracy and mean confidence per label over many labelled datasets."""
    return score(model, df).groupBy("label").agg(
        F.count(F.lit(1)).alias("datasets"),
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
        F.avg("score").alias("mean_confidence"))


# -- studies -----------------------------------------------------------------

def _accuracy(predicted: DataFrame) -> float:
    return class_metrics(predicted).first()["accuracy"]


def sweep(df: DataFrame, names: Sequence[str] = FEATURES8, depths: Sequence[int] = DEPTHS,
          cs: Sequence[float] = PENALTIES, trees: int = SWEEP_TREES) -> DataFrame:
    """Training and hold-out accuracy over forest depths and logistic penalties.

    Features are filled and packed once; the grids of both learners are fitted side by side.
    """
    fit, test = hold_out(df)
    ready = with_weights(_typed(fit, names))
    packed = _stages(names).fit(ready)
    parts = [packed.transform(ready).persist(), packed.transform(_typed(test, names)).persist()]
    try:
        rows_fit = parts[0].count()
        deep, flat = _forest(numTrees=trees), _logistic()
        grids = [
            ("forest_depth", deep, depths, ParamGridBuilder().addGrid(deep.maxDepth, list(depths)).build()),
            ("logistic_c", flat, cs, ParamGridBuilder().addGrid(flat.regParam, [_penalty(c, rows_fit) for c in cs]).build())]

        def one(kind: str, learner, value: float, settings: dict) -> tuple:
            model = learner.fit(parts[0], settings)
            return kind, float(value), *[_accuracy(model.transform(part)) for part in parts]

        rows = at_once([
            lambda kind=kind, learner=learner, value=value, settings=settings: one(kind, learner, value, settings)
            for kind, learner, values, grid in grids for value, settings in zip(values, grid)])
    finally:
        for part in parts:
            part.unpersist()
    return df.sparkSession.createDataFrame(rows, "setting STRING, value DOUBLE, train_accuracy DOUBLE, test_accuracy DOUBLE")


def learning_curve(df: DataFrame, key: str, names: Sequence[str] = FEATURES8,
                   shares: Sequence[float] = SHARES, folds: int = CURVE_FOLDS, **settings) -> DataFrame:
    """Per share of the training rows used: mean and deviation of both accuracies over all folds."""
    place = F.pmod(F.xxhash64(col(key)), F.lit(1000))
    dealt = dealt_once(df, key, folds).withColumn("__place", place)

    def one(share: float, k: int) -> tuple:
        part = dealt.where((F.col("fold") != k) & (F.col("__place") < round(share * 1000)))
        model = train(part, names, forest(names, **settings))
        seen, unseen = [_accuracy(score(model, rows)) for rows in (part, dealt.where(F.col("fold") == k))]
        return share, part.count(), seen, unseen

    points = at_once([lambda s=s, k=k: one(s, k) for s in shares for k in range(folds)])
    return df.sparkSession.createDataFrame(
        points, "share DOUBLE, rows LONG, seen DOUBLE, unseen DOUBLE").groupBy("share").agg(
        F.avg("rows").alias("rows"), F.avg("seen").alias("train_accuracy"), F.stddev_pop("seen").alias("train_deviation"),
        F.avg("unseen").alias("accuracy"), F.stddev_pop("unseen").alias("deviation"))


def dominance(df: DataFrame, names: Sequence[str] = FEATURES8) -> DataFrame:
    """Accuracy of a shallow tree on each feature alone."""
    fit, test = hold_out(df)

    def one(n: str) -> tuple:
        tree = DecisionTreeClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxDepth=3)
        return n, _accuracy(score(train(fit, [n], _stages([n], tree)), test))

    rows = at_once([lambda n=n: one(n) for n in names])
    return df.sparkSession.createDataFrame(rows, "feature STRING, accuracy DOUBLE")
