"""Feedback to a new model: combine, validate, train, compare, log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from dqspark.operators import feedback as L, model as M
from dqspark.operators.features import FEATURES8


@dataclass
class Retrained:
    success: bool
    promoted: bool
    model: PipelineModel | None
    log: DataFrame | None
    reason: str


def training_table(originals: DataFrame, feedback: DataFrame) -> DataFrame:
    """Original feature rows and usable feedback rows under one key."""
    usable = L.training_rows(feedback)
    new = usable.select(
        F.concat(F.lit("feedback_"), F.col("id").cast("string")).alias("dataset_id"), "label",
        *[F.col("features")[i].alias(n) for i, n in enumerate(FEATURES8)])
    old = originals.select(
        F.col("dataset_id").cast("string").alias("dataset_id"), F.col("label").cast("int").alias("label"),
        *[F.col(n).cast("double").alias(n) for n in FEATURES8])
    return old.unionByName(new)


def retrain(originals: DataFrame, feedback: DataFrame, current: PipelineModel | None = None, *,
            min_rows: int = L.RETRAIN_EVERY, folds: int | None = None, **settings) -> Retrained:
    """Train on originals and feedback; promote only a model that is clearly better."""
    spark = originals.sparkSession
    usable = L.training_rows(feedback).count()
    if usable < min_rows:
        return Retrained(False, False, None, None, f"insufficient samples: {usable}/{min_rows}")
    table = training_table(originals, feedback).persist()
    try:
        cv = M.cross_validate(table, "dataset_id", folds=folds, **settings).agg(
            F.avg("balanced_accuracy")).first()[0]
        candidate = M.train(table, learner=M.forest(**settings))
        _, test = M.hold_out(originals, "dataset_id")
        decided = M.shadow_validate(current, candidate, test)
        row = decided.first()
        entry = decided.select(
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
            F.lit(float(cv)).alias("cv_score"), F.lit(usable).cast("int").alias("feedback_samples"),
            F.lit(table.count()).cast("int").alias("total_training_samples"),
            F.lit("RandomForestClassificationModel").alias("model_type"),
            F.lit("retrain").alias("action"), "promoted",
            F.col("reason").alias("validation_reason"),
            F.struct("f1_delta", "balanced_accuracy_delta", "auc_roc_delta").alias("improvement"))
        fixed = spark.createDataFrame([entry.first()], entry.schema)
    finally:
        table.unpersist()
    return Retrained(True, row["promoted"], candidate, fixed, row["reason"])
