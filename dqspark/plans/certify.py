"""A whole run: intake, cleaning, profile, charts, validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from dqspark.functions.scalars import col
from dqspark.functions.settle import settle
from dqspark.operators import checks as C, clean as K, dedup, explore, features as X, insights
from dqspark.operators import model as M, profile, quality, relations, schema
from dqspark.operators.charts import chart_plan


@dataclass
class Certificate:
    """Result tables of a run.  The cleaned table stays cached until ``release``."""

    scout: DataFrame
    cleaned: DataFrame
    plan: K.CleaningPlan
    metrics: DataFrame
    stats: DataFrame
    categories: DataFrame
    pairs: DataFrame
    anomalies: DataFrame
    insights: DataFrame
    charts: DataFrame
    checks: DataFrame
    dimensions: DataFrame
    verdict: DataFrame

    def release(self) -> None:
        self.cleaned.unpersist()


def scout(df: DataFrame, row_id: str, approx: bool = False) -> DataFrame:
    """Intake report as one row: size, types, preview, scores and confidence."""
    types = schema.logical_types(df)
    data = [c for c in df.columns if c != row_id]
    names = F.map_from_arrays(F.array(*[F.lit(c) for c in data]),
                              F.array(*[F.lit(types[c]) for c in data]))
    sample = [r.asDict() for r in explore.preview(df, row_id).select(*[col(c) for c in data]).collect()]
    scores = quality.quality_scores(df, row_id=row_id, approx=approx)
    fits = (F.col("num_rows") >= quality.MIN_ROWS) & F.lit(len(data) >= quality.MIN_COLS)
    return scores.select(
        fits.alias("is_dataset"), "num_rows", F.lit(len(data)).alias("num_columns"),
        names.alias("dtypes"), _samples(sample).alias("sample_data"),
        "completeness", "consistency", "accuracy", "uniqueness", "outliers",
        F.round("confidence", 2).alias("confidence_score"),
    )


def _samples(rows: list[dict[str, str | None]]) -> Column:
    return F.array(*[
        F.map_from_arrays(F.array(*[F.lit(k) for k in r]),
                          F.array(*[F.lit(v).cast("string") for v in r.values()]))
        for r in rows
    ]).cast("array<map<string,string>>")


def certify(df: DataFrame, row_id: str, profile_: K.CleaningProfile = K.CleaningProfile(), *,
            classifier: PipelineModel | None = None, approx: bool = False,
            trend: bool = True) -> Certificate:
    """Run every stage.  The cleaned table is cached once; what a stage found is worked out once, as a local table."""
    # Intake and fitting pass over the raw table many times; it is let go before the profile.
    held = df.is_cached
    if not held:
        df.persist(StorageLevel.MEMORY_AND_DISK)
    intake = settle(scout(df, row_id, approx))
    plan, staged = K.fit_staged(df, profile_, row_id)
    if not held:
        df.unpersist()
    cleaned = K.finish(staged, plan)
    if cleaned is not staged:       # nothing to fill or filter leaves the cached table itself
        cleaned = cleaned.persist(StorageLevel.MEMORY_AND_DISK)
        rows = cleaned.count()
        staged.unpersist()
    else:
        rows = plan.rows_distinct
    rid = plan.row_id
    data = cleaned.drop(rid)
    numbers = [n for n in schema.numeric_columns(cleaned) if n != rid]

    marks = profile.quartiles(cleaned, numbers, approx, rows)

    stats = settle(profile.column_stats(
        cleaned, data.columns, row_id=rid if trend else None, marks=marks))
    categories = settle(profile.categorical_insights(data))
    pairs = settle(relations.pearson_pairs(data, numbers))
    found = settle(profile.anomalies(cleaned, numbers, rid, fences=profile.fences_from(marks)))
    charts = settle(chart_plan(data, stats, pairs, categories))
    words = settle(insights.key_insights(data, stats, pairs, found))

    tests = C.sanity_checks(cleaned, rows, len(data.columns), rid)
    tests = tests.unionByName(C.consistency_checks(
        stats.where(F.col("mean").isNotNull()), profile.moments(data, numbers)))
    tests = tests.unionByName(C.correlation_checks(pairs, relations.pearson_pairs(data, numbers, None)))
    tests = tests.unionByName(C.outlier_check(cleaned, rid, approx, marks))
    tests = tests.unionByName(C.chart_check(charts))
    tests = tests.unionByName(C.required_outputs(
        {"analysis": (stats, "error"), "charts": (charts, "error"), "cleaned": (data, "error")}, data))
    if classifier is not None:
        tests = tests.unionByName(C.model_check(
            M.score(classifier, X.features8(X.measures(data)))))
    tests = settle(tests)
    dimensions = settle(C.dimension_scores(tests))
    return Certificate(
        intake, cleaned, plan, settle(K.clean_metrics(cleaned, plan)), stats, categories, pairs, found,
        words, charts, tests, dimensions, C.verdict(tests, dimensions),
    )


def skip_if_unchanged(df: DataFrame, profile_: K.CleaningProfile, markers: DataFrame) -> DataFrame:
    """Has this table been cleaned with this profile before?"""
    return dedup.unchanged(df, profile_.digest(), markers)
