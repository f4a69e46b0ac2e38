"""Rules of the feedback loop on a table of feedback rows.

Rows: ``id, dataset_hash, predicted_score, actual_label, features, ts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dqspark.functions.ordering import row_positions
from dqspark.operators.quality import age_status, decay, hours_to_retrain

PER_DATASET = 3
RETRAIN_EVERY = 20
RETRAIN_EVERY_DEMO = 5
RETAINED = 500
FEATURE_COUNT = 8
LOW_SCORE, HIGH_SCORE = 50, 70


def is_valid() -> Column:
    """Label 0..3 and a finite score within 0..100."""
    score, label = F.col("predicted_score"), F.col("actual_label")
    finite = score.isNotNull() & ~F.isnan(score)
    return F.coalesce(
        finite & (score >= 0) & (score <= 100) & label.isNotNull() & label.between(0, 3), F.lit(False))


def gate(rows: DataFrame) -> DataFrame:
    """Add ``accepted`` and ``reason``: only answers that contradict the model teach it."""
    score, label = F.col("predicted_score"), F.col("actual_label")
    low = (label >= 2) & (score < LOW_SCORE)
    high = (label == 0) & (score > HIGH_SCORE)
    valid = is_valid()
    reason = (
        F.when(~valid, "invalid").when(label == 1, "neutral")
        .when(low, "good_data_low_score").when(high, "bad_data_high_score").otherwise("agrees"))
    return rows.withColumn("accepted", valid & (low | high)).withColumn("reason", reason)


def quarantine(rows: DataFrame) -> DataFrame:
    return rows.where(~is_valid())


def first_per_dataset(accepted: DataFrame, limit: int = PER_DATASET) -> DataFrame:
    """The first accepted rows per dataset in order of arrival.

    Each task drops all but its own first rows before the shuffle, so a
    dataset with a third of all feedback costs a few rows per task.
    """
    arrival = Window.partitionBy("dataset_hash").orderBy("ts", "id")
    return accepted.withColumn("arrival", F.row_number().over(arrival)).where(F.col("arrival") <= limit)


def accepted_per_dataset(rows: DataFrame) -> DataFrame:
    return gate(rows).where("accepted").groupBy("dataset_hash").agg(F.count(F.lit(1)).alias("accepted_rows"))


def training_rows(rows: DataFrame, last: int | None = None) -> DataFrame:
    """Rows with exactly eight features; labels 2 and 3 are good."""
    usable = rows.where(F.size("features") == FEATURE_COUNT).select(
        "id", "features", F.when(F.col("actual_label") >= 2, 1).otherwise(0).alias("label"))
    return usable if last is None else newest(usable, last)


def newest(rows: DataFrame, keep: int = RETAINED, key: str = "id") -> DataFrame:
    return rows.orderBy(F.col(key).desc()).limit(keep)


def retrain_points(rows: DataFrame, every: int = RETRAIN_EVERY, key: str = "id",
                   buckets: int | None = None) -> DataFrame:
    """Rows whose arrival fills a batch, with the running count at that point."""
    counted = row_positions(rows, key, "feedback_count", buckets).withColumn(
        "feedback_count", F.col("feedback_count") + 1)
    return counted.where(triggers(F.col("feedback_count"), every))


def triggers(count: Column, every: int = RETRAIN_EVERY) -> Column:
    return (count >= every) & (F.pmod(count, F.lit(every)) == 0)


def rows_to_retrain(count: Column, every: int = RETRAIN_EVERY) -> Column:
    return F.lit(every) - F.pmod(count, F.lit(every))


def health(rows: DataFrame) -> DataFrame:
    """One row: usable and unusable feedback and a status."""
    counts = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce(F.size("features") == FEATURE_COUNT, F.lit(False))).alias("valid"))
    pct = F.coalesce(F.try_divide(F.col("valid") * 100.0, F.col("total")), F.lit(100.0))
    label = (F.when(F.col("total") == 0, "no_data").when(pct > 90, "healthy")
             .when(pct > 70, "degraded").otherwise("poor"))
    return counts.select(
        F.col("total").alias("total_feedbacks"), F.col("valid").alias("valid_with_features"),
        (F.col("total") - F.col("valid")).alias("invalid_features"),
        pct.alias("health_percentage"), label.alias("status"))


def loop_stats(log: DataFrame, as_of: Column, window: int = 10) -> DataFrame:
    """One row over the newest retrain log entries ``(ts, cv_score)``."""
    recent = log.orderBy(F.col("ts").desc()).limit(window)
    last, first = F.max_by("cv_score", "ts"), F.min_by("cv_score", "ts")
    hours = (F.unix_timestamp(as_of.cast("timestamp"))
             - F.unix_timestamp(F.col("latest").cast("timestamp"))) / 3600.0
    one = recent.agg(
        F.count(F.lit(1)).alias("models_trained"), last.alias("current_cv_score"),
        first.alias("first_cv_score"), F.max("ts").alias("latest"))
    gain = F.when(
        (F.col("models_trained") > 1) & (F.col("first_cv_score") > 0),
        (F.col("current_cv_score") - F.col("first_cv_score")) / F.col("first_cv_score") * 100)
    return one.withColumn("hours", hours).select(
        "models_trained", "current_cv_score", F.col("latest").alias("latest_retrain_at"),
        gain.alias("improvement_percentage"), F.col("hours").alias("hours_since_retrain"),
        decay(F.col("hours")).alias("decay_factor"), age_status(F.col("hours")).alias("model_status"),
        hours_to_retrain(F.col("hours")).alias("next_retrain_recommended_at"))
