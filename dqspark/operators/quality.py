"""Intake quality scores and the scoring rules built on them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from dqspark.functions.ordering import quantiles
from dqspark.functions.scalars import col, parse_timestamp, to_number
from dqspark.operators.dedup import duplicate_summary
from dqspark.operators.profile import Fences, fences_from, outside
from dqspark.operators.schema import logical_types, numeric_columns

CAP = 0.99
UNTESTED = 0.95     # no typed column / no number to test
MIN_ROWS, MIN_COLS = 3, 2

# Weights of the five intake scores.
WEIGHTS = {
    "completeness": 0.25, "consistency": 0.25, "accuracy": 0.20,
    "uniqueness": 0.15, "outliers": 0.15,
}


def _capped(c: Column) -> Column:
    """At most the cap; NULL stays NULL (``least`` alone would skip it)."""
    return F.when(c.isNotNull(), F.least(c, F.lit(CAP)))


def size_guard(df: DataFrame) -> DataFrame:
    """One row: is the table big enough to be worth a run?"""
    cols = len(df.columns)
    rows = F.count(F.lit(1))
    fits = (F.col("num_rows") >= MIN_ROWS) & F.lit(cols >= MIN_COLS)
    reason = F.concat(
        F.col("num_rows").cast("string"),
        F.lit(f" rows by {cols} columns; a run takes {MIN_ROWS} by {MIN_COLS} or more"))
    return df.agg(rows.alias("num_rows")).select(
        "num_rows", F.lit(cols).cast("bigint").alias("num_columns"), fits.alias("is_dataset"),
        F.when(~fits, reason).alias("rejection_reason"),
    )


def _parses(name: str, kind: str) -> Column:
    c = col(name)
    if kind in ("integer", "float", "numeric"):
        return to_number(c.cast("string")).isNotNull()
    if kind == "datetime":
        return parse_timestamp(c.cast("string")).isNotNull()
    return F.lit(True)


def outlier_parts(df: DataFrame, row_id: str | None = None, approx: bool = False,
                  rows: int | None = None,
                  marks: dict[str, list[float | None]] | None = None,
                  ) -> tuple[list[str], Fences, list[Column]]:
    """Fences where the middle half has a width, and the aggregates that use them."""
    numbers = [n for n in numeric_columns(df) if n != row_id]
    marks = marks or quantiles(df, numbers, [0.25, 0.75], approx=approx, rows=rows)
    fences = fences_from({n: m if None not in m and m[-1] > m[0] else [None, None]
                          for n, m in marks.items()})
    aggs = []
    for i, n in enumerate(numbers):
        aggs += [F.count(col(n)).alias(f"points{i}"),
                 F.count_if(outside(n, fences)).alias(f"outs{i}")]
    return numbers, fences, aggs


def _total(prefix: str, size: int) -> Column:
    out: Column = F.lit(0).cast("bigint")
    for i in range(size):
        out = out + F.col(f"{prefix}{i}")
    return out


def quality_scores(df: DataFrame, declared: Mapping[str, str] | None = None,
                   row_id: str | None = None, approx: bool = False) -> DataFrame:
    """One row: the five scores and their weighted confidence.

    With ``declared`` types a text column is tested against its type; without,
    the schema already guarantees them.
    """
    data = [c for c in df.columns if c != row_id]
    types = logical_types(df)
    claims = {n: (declared or {}).get(n, types[n]) for n in data}
    typed = [n for n in data if claims[n] not in ("categorical", "boolean")]
    checked = [n for n in typed if types[n] == "categorical"]
    rows = df.count()
    numbers, _, aggs = outlier_parts(df, row_id, approx, rows)
    copies = duplicate_summary(df, row_id).first()["duplicates"]
    aggs += [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count(col(n)).alias(f"k{i}") for i, n in enumerate(data)]
    aggs += [F.count_if(col(n).isNull() | _parses(n, claims[n])).alias(f"ok{i}")
             for i, n in enumerate(checked)]
    whole = F.col("rows").cast("double")
    known = _total("k", len(data))
    complete = _capped(F.try_divide(known, whole * len(data)))
    passed = _total("ok", len(checked)) + F.col("rows") * (len(typed) - len(checked))
    consistent = (_capped(F.try_divide(passed, whole * len(typed))) if typed
                  else F.lit(UNTESTED))
    holds = F.lit(len(data) - len(checked))
    for i in range(len(checked)):
        holds = holds + (F.col(f"ok{i}") == F.col("rows")).cast("int")
    points, outs = _total("points", len(numbers)), _total("outs", len(numbers))
    outlier = F.coalesce(_capped(1.0 - F.try_divide(outs, points)), F.lit(UNTESTED))
    scores = df.agg(*aggs).select(
        F.col("rows").alias("num_rows"),
        F.coalesce(complete, F.lit(0.0)).alias("completeness"),
        F.coalesce(consistent, F.lit(0.0)).alias("consistency"),
        _capped(holds / F.lit(float(len(data)))).alias("accuracy"),
        F.coalesce(_capped(1.0 - F.try_divide(F.lit(copies), whole)), F.lit(0.0)).alias("uniqueness"),
        outlier.alias("outliers"),
    )
    return scores.withColumn("confidence", weighted_confidence())


def weighted_confidence() -> Column:
    total: Column = F.lit(0.0)
    for n, w in WEIGHTS.items():
        total = total + F.col(n) * F.lit(w)
    return _capped(total)


# -- rules on scores ---------------------------------------------------------

def rule_label(features: DataFrame, name: Column | None = None) -> DataFrame:
    """Points off for gaps, copies and constant columns; 70 and more is good.

    Needs ``missing_ratio, duplicate_ratio, constant_cols, num_columns``.
    """
    m, d = F.col("missing_ratio"), F.col("duplicate_ratio")
    score = (
        F.lit(100)
        - F.when(m > 0.2, 30).when(m > 0.1, 15).when(m > 0.05, 5).otherwise(0)
        - F.when(d > 0.1, 20).when(d > 0.05, 10).otherwise(0)
        - F.when(F.col("constant_cols") > F.col("num_columns") * 0.2, 15).otherwise(0)
    )
    suspect = F.lit(False)
    if name is not None:
        lowered = F.lower(name)
        for word in ("messy", "dirty", "corrupt", "real_world"):
            suspect = suspect | lowered.contains(word)
    return features.withColumn("rule_score", score.cast("bigint")).withColumn(
        "rule_label", F.when(suspect, 0).when(F.col("rule_score") >= 70, 1).otherwise(0)
    )


def score_label(score: Column) -> Column:
    return (F.when(score >= 0.90, "Good").when(score >= 0.75, "Acceptable")
            .otherwise("Needs Review"))


def rating(score: Column) -> Column:
    """Word for a 0-100 score."""
    return (F.when(score >= 85, "EXCELLENT").when(score >= 60, "GOOD")
            .when(score >= 30, "FAIR").otherwise("POOR"))


def decay(hours: Column) -> Column:
    """Trust in an ageing model: from 1 down to 0.7 over 90 days."""
    days = hours / 24.0
    return (F.when(days <= 0, 1.0).when(days >= 90, 0.70)
            .otherwise(F.greatest(F.lit(0.70), 1.0 - days / 90.0 * 0.30)))


def age_status(hours: Column) -> Column:
    days = hours / 24.0
    return (F.when(days < 7, "fresh").when(days < 30, "good").when(days < 90, "aging")
            .otherwise("stale"))


def hours_to_retrain(hours: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(30 * 24.0) - hours)
