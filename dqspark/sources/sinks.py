"""Writers for tables, results, the retrain log and stored features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LOG_SCHEMA = (
    "timestamp STRING, cv_score DOUBLE, feedback_samples INT, total_training_samples INT, "
    "model_type STRING, action STRING, promoted BOOLEAN, validation_reason STRING, "
    "improvement STRUCT<f1_delta: DOUBLE, balanced_accuracy_delta: DOUBLE, auc_roc_delta: DOUBLE>"
)
FEATURE_SCHEMA = "dataset_hash STRING, features ARRAY<DOUBLE>, saved_at TIMESTAMP"


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Raw, cleaned or enriched tables."""
    if fmt == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")


def write_result(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result tables (statistics, checks, chart specs) as JSON lines."""
    df.write.mode(mode).json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The retrain log; fields absent in old entries are NULL."""
    return spark.read.schema(LOG_SCHEMA).json(path)


def model_history(log: DataFrame, last: int = 10) -> DataFrame:
    return log.orderBy(F.col("timestamp").desc()).limit(last)


def save_features(rows: DataFrame, path: str) -> None:
    """Append ``(dataset_hash, features, saved_at)`` rows."""
    rows.write.mode("append").parquet(path)


def lookup_features(stored: DataFrame, hashes: DataFrame) -> DataFrame:
    """Newest stored features for each wanted hash."""
    newest = stored.groupBy("dataset_hash").agg(F.max_by("features", "saved_at").alias("features"))
    return hashes.select("dataset_hash").distinct().join(newest, "dataset_hash", "left")
