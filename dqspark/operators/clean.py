"""Cleaning in two steps: ``fit`` looks at the table, ``transform`` is a projection.

The plan that links them holds names, fill values and fences: as many entries
as the table has columns.  It can be applied to other tables and to streams.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from typing import Any, Literal

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from dqspark.functions.ordering import forward_fill, quantiles
from dqspark.functions.scalars import adjusted_skew, col, to_number
from dqspark.functions.scratch import written
from dqspark.operators.corrupt import draw
from dqspark.operators.dedup import drop_duplicate_rows, duplicate_summary
from dqspark.operators.profile import Fences, fences_from, value_counts
from dqspark.operators.schema import (
    COERCE_SHARE, convert_to_numbers, hinted, nan_to_null, numeric_columns, standard_names,
)

SKEW_LIMIT = 0.5
SKEW_MIN_ROWS = 8
UNKNOWN = "Unknown"
# Rows that a plan is learned from where a sample will do.
SAMPLE_ROWS = 100_000


@dataclass(frozen=True)
class CleaningProfile:
    drop_empty_rows: bool = True
    drop_empty_cols: bool = True
    drop_duplicates: bool = True
    standardize_column_names: bool = True
    auto_detect_dtypes: bool = True
    fill_missing_strategy: Literal["drop", "ffill", "mean", "median", "smart", "none"] = "smart"
    handle_outliers: bool = False
    outlier_method: Literal["iqr", "iqr_sequential", "zscore"] = "iqr"
    hint_match: Literal["substring", "token"] = "substring"

    def digest(self) -> str:
        return hashlib.md5(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


# Renames, drops empty rows and copies, and leaves the values alone.
MINIMAL = CleaningProfile(
    drop_empty_cols=False, auto_detect_dtypes=False, fill_missing_strategy="none"
)


@dataclass
class Fill:
    strategy: str
    value: Any
    filled: int


@dataclass
class CleaningPlan:
    profile: CleaningProfile
    source_names: list[str]
    names: list[str]
    kept: list[str]
    numbers: list[str] = field(default_factory=list)
    fills: dict[str, Fill] = field(default_factory=dict)
    fences: Fences = field(default_factory=dict)
    row_id: str | None = None
    rows_input: int = 0
    empty_rows: int = 0
    rows_distinct: int = 0
    missing_before: int = 0

    @property
    def columns_standardized(self) -> int:
        return sum(a != b for a, b in zip(self.source_names, self.names))


# -- single steps ------------------------------------------------------------

def drop_empty_rows(df: DataFrame, row_id: str | None = None) -> DataFrame:
    return df.dropna(how="all", subset=[c for c in df.columns if c != row_id] or None)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count(col(c)).alias(f"k{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[col(c) for i, c in enumerate(df.columns) if counts[i] > 0])


def fill_with(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    """Replace NULLs; numbers become doubles, other types keep theirs."""
    types = dict(df.dtypes)
    numbers = set(numeric_columns(df))

    def filled(name: str) -> Column:
        value = values.get(name)
        if value is None:
            return col(name)
        if name in numbers:
            return F.coalesce(col(name).cast("double"), F.lit(float(value))).alias(name)
        return F.coalesce(col(name), F.lit(str(value)).try_cast(types[name])).alias(name)

    return df.select(*[filled(c) for c in df.columns])


def column_modes(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Most frequent text per column, the smallest one on a tie."""
    counted = value_counts(df, names, nulls=False)
    best = F.min(F.struct((-F.col("n")).alias("order"), F.col("value")))
    return counted.groupBy("column").agg(best.alias("best")).select(
        "column", F.col("best.value").alias("mode")
    )


def choose_strategy(known: Column, skew: Column) -> Column:
    """Mean for a roughly symmetric column with enough rows, median for all others."""
    symmetric = (known >= SKEW_MIN_ROWS) & (F.abs(skew) < SKEW_LIMIT)
    return F.when(F.coalesce(symmetric, F.lit(False)), "mean").otherwise("median")


def _numeric_fills(df: DataFrame, names: Sequence[str], strategy: str, rows: int) -> dict[str, Fill]:
    if not names:
        return {}
    aggs = []
    for i, n in enumerate(names):
        c = col(n).cast("double")
        aggs += [F.count(c).alias(f"k{i}"), F.avg(c).alias(f"m{i}"), F.skewness(c).alias(f"g{i}")]
    marks = df.agg(*aggs)
    row = marks.select(*[
        e for i in range(len(names)) for e in (
            F.col(f"k{i}"), F.col(f"m{i}"),
            choose_strategy(F.col(f"k{i}"), adjusted_skew(F.col(f"k{i}"), F.col(f"g{i}"))).alias(f"s{i}"),
        )
    ]).first()
    chosen = {n: (strategy if strategy != "smart" else row[f"s{i}"]) for i, n in enumerate(names)}
    by_median = [n for n in names if chosen[n] == "median"]
    medians = quantiles(df, by_median, [0.5], rows=rows)
    out = {}
    for i, n in enumerate(names):
        value = medians[n][0] if chosen[n] == "median" else row[f"m{i}"]
        out[n] = Fill(chosen[n], value, 0)
    return out


def zscore_limits(df: DataFrame, names: Sequence[str]) -> Fences:
    row = df.agg(*[
        f(col(n).cast("double")).alias(f"{p}{i}")
        for i, n in enumerate(names) for p, f in (("m", F.avg), ("s", F.stddev_pop))
    ]).first()
    out: Fences = {}
    for i, n in enumerate(names):
        mean, std = row[f"m{i}"], row[f"s{i}"]
        out[n] = (None, None) if mean is None or std is None else (mean - 3 * std, mean + 3 * std)
    return out


def keep_inside(df: DataFrame, fences: Fences, keep_null: bool = True) -> DataFrame:
    """Rows whose values lie within all fences."""
    test = F.lit(True)
    for n, (low, high) in fences.items():
        if low is None:
            continue
        inside = col(n).between(F.lit(low), F.lit(high))
        test = test & F.coalesce(inside, F.lit(keep_null))
    return df.where(test)


def filter_outliers(df: DataFrame, names: Sequence[str] | None = None,
                    approx: bool = False) -> DataFrame:
    """Fences of all columns from one pass, one filter; NULLs stay."""
    names = list(names or numeric_columns(df))
    return keep_inside(df, fences_from(quantiles(df, names, [0.25, 0.75], approx=approx)))


def filter_outliers_in_turn(df: DataFrame, names: Sequence[str] | None = None,
                            approx: bool = False) -> DataFrame:
    """Column by column with fences from the rows still left; NULLs go."""
    for n in list(names or numeric_columns(df)):
        df = keep_inside(df, fences_from(quantiles(df, [n], [0.25, 0.75], approx=approx)),
                         keep_null=False)
    return df


# -- fit and transform -------------------------------------------------------

def _staged(df: DataFrame, plan: CleaningPlan) -> DataFrame:
    named = nan_to_null(df.toDF(*plan.names))
    if plan.profile.drop_empty_rows:
        named = drop_empty_rows(named, plan.row_id)
    return named.select(*[col(c) for c in plan.kept])


def fit_staged(df: DataFrame, profile: CleaningProfile = CleaningProfile(),
               row_id: str | None = None, everywhere: bool = False) -> tuple[CleaningPlan, DataFrame]:
    """The plan, and the renamed and de-duplicated table it was learned from.

    The table is cached because several passes read it; the caller frees it.  With
    ``everywhere``, columns without gaps get fill values too.
    """
    names = standard_names(df.columns) if profile.standardize_column_names else list(df.columns)
    id_name = names[df.columns.index(row_id)] if row_id else None
    plan = CleaningPlan(profile, list(df.columns), names, list(names), row_id=id_name)
    named = nan_to_null(df.toDF(*names))
    data = [n for n in names if n != id_name]

    filled_any = F.coalesce(*[col(n).cast("string") for n in data]).isNotNull()
    first = named.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~filled_any).alias("empty"),
        *[F.count(col(n)).alias(f"k{i}") for i, n in enumerate(data)],
    ).first()
    plan.rows_input = first["rows"]
    plan.empty_rows = first["empty"] if profile.drop_empty_rows else 0
    if profile.drop_empty_cols:
        gone = {n for i, n in enumerate(data) if first[f"k{i}"] == 0}
        plan.kept = [n for n in names if n not in gone]

    staged = _staged(df, plan)
    if profile.drop_duplicates:
        staged = drop_duplicate_rows(staged, id_name)
    staged = staged.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        _fit_values(staged, plan, everywhere)
    except Exception:
        staged.unpersist()
        raise
    return plan, staged


def fit(df: DataFrame, profile: CleaningProfile = CleaningProfile(), row_id: str | None = None) -> CleaningPlan:
    """Learn names, types, fill values and fences."""
    plan, staged = fit_staged(df, profile, row_id)
    staged.unpersist()
    return plan


def bottom_sample(df: DataFrame, row_id: str, rows: int, seed: int = 42) -> DataFrame:
    """The ``rows`` rows with the least numbers drawn from their ids.

    The same rows in every run; a task passes on no more than that many.
    """
    return df.orderBy(draw(col(row_id), seed), col(row_id)).limit(rows)


def fit_on_sample(df: DataFrame, row_id: str, profile: CleaningProfile = CleaningProfile(),
                  rows: int = SAMPLE_ROWS, seed: int = 42) -> CleaningPlan:
    """A plan learned from a bounded sample in one pass over the table, for ``transform`` of all of it.

    The plan's counts are the sample's.  Every column gets a fill value, as gaps may lie
    outside the sample; for the same reason no column is dropped as empty, and a text
    column without any value in the sample is filled with the fallback.
    """
    sample = written(bottom_sample(df, row_id, rows, seed), "sample")
    plan, staged = fit_staged(sample, replace(profile, drop_empty_cols=False), row_id, everywhere=True)
    staged.unpersist()
    return plan


def _fit_values(staged: DataFrame, plan: CleaningPlan, everywhere: bool) -> None:
    profile = plan.profile
    data = [n for n in plan.kept if n != plan.row_id]
    texts = [n for n, t in staged.dtypes if t == "string" and n in data]
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count(col(n)).alias(f"k{i}") for i, n in enumerate(data)]
    aggs += [F.count(to_number(col(n))).alias(f"p{i}") for i, n in enumerate(texts)]
    seen = staged.agg(*aggs).first()
    rows = plan.rows_distinct = seen["rows"]
    known = {n: seen[f"k{i}"] for i, n in enumerate(data)}
    if profile.auto_detect_dtypes and rows:
        for i, n in enumerate(texts):
            parsed = seen[f"p{i}"]
            if parsed / rows > COERCE_SHARE or (hinted(n, profile.hint_match) and parsed):
                plan.numbers.append(n)
                known[n] = parsed
    missing = {n: rows - known[n] for n in data}
    plan.missing_before = sum(missing.values())

    typed = convert_to_numbers(staged, plan.numbers)
    numeric = [n for n in numeric_columns(typed) if n in data]
    gaps = [n for n in numeric if missing[n] or everywhere]
    strategy = profile.fill_missing_strategy
    if strategy in ("mean", "median", "smart"):
        plan.fills.update(_numeric_fills(typed, gaps, strategy, rows))
    if strategy == "smart":
        others = [n for n in data if n not in numeric and (missing[n] or everywhere)]
        if others:
            modes = {r["column"]: r["mode"] for r in column_modes(typed, others).collect()}
            for n in others:
                found = modes.get(n) is not None
                plan.fills[n] = (Fill("mode", modes[n], 0) if found
                                 else Fill("unknown_fallback", UNKNOWN, 0))
    for n, fill in plan.fills.items():
        fill.filled = missing[n]
    if profile.handle_outliers and profile.outlier_method != "iqr_sequential":
        ready = fill_with(typed, {n: f.value for n, f in plan.fills.items()})
        if profile.outlier_method == "iqr":
            plan.fences = fences_from(quantiles(ready, numeric, [0.25, 0.75]))
        else:
            plan.fences = zscore_limits(ready, numeric)


def transform(df: DataFrame, plan: CleaningPlan, *, drop_copies: bool | None = None,
              handle_outliers: bool | None = None) -> DataFrame:
    """Apply a plan.  With ``drop_copies=False`` it is a projection and fits a stream."""
    out = _staged(df, plan)
    if plan.profile.drop_duplicates if drop_copies is None else drop_copies:
        out = drop_duplicate_rows(out, plan.row_id)
    return finish(out, plan, handle_outliers)


def finish(staged: DataFrame, plan: CleaningPlan, handle_outliers: bool | None = None) -> DataFrame:
    """The steps after de-duplication: types, filling, outlier filter."""
    profile = plan.profile
    out = convert_to_numbers(staged, plan.numbers) if plan.numbers else staged
    data = [n for n in plan.kept if n != plan.row_id]
    if profile.fill_missing_strategy == "drop":
        out = out.dropna(how="any", subset=data)
    elif profile.fill_missing_strategy == "ffill":
        if plan.row_id is None:
            raise ValueError("forward fill needs a row_id: rows have no order of their own")
        out = forward_fill(out, data, plan.row_id)
    elif plan.fills:
        out = fill_with(out, {n: f.value for n, f in plan.fills.items()})
    if profile.handle_outliers if handle_outliers is None else handle_outliers:
        if profile.outlier_method == "iqr_sequential":
            out = filter_outliers_in_turn(out, [n for n in numeric_columns(out) if n in data])
        else:
            out = keep_inside(out, plan.fences)
    return out


def imputation_log(df: DataFrame, plan: CleaningPlan) -> DataFrame:
    """One row per filled column: strategy, fill value (4 decimals) and cells filled."""
    rows = []
    for n, f in plan.fills.items():
        number = f.strategy in ("mean", "median") and f.value is not None
        rows.append((n, f.strategy, round(float(f.value), 4) if number else None,
                     None if number else f.value, f.filled))
    return df.sparkSession.createDataFrame(
        rows, "column STRING, strategy STRING, fill_number DOUBLE, fill_text STRING, filled LONG"
    )


def clean_metrics(cleaned: DataFrame, plan: CleaningPlan) -> DataFrame:
    """One row of counts: what came in, what was removed, filled and left."""
    data = [n for n in plan.kept if n != plan.row_id]
    before_filter = plan.rows_distinct
    left = cleaned.agg(
        F.count(F.lit(1)).alias("rows_output"),
        *[F.count(col(n)).alias(f"k{i}") for i, n in enumerate(data)],
    )
    copies = (plan.rows_input - plan.empty_rows - plan.rows_distinct
              if plan.profile.drop_duplicates else 0)
    strategy = plan.profile.fill_missing_strategy
    if strategy == "ffill":
        still = sum([F.col("rows_output") - F.col(f"k{i}") for i in range(len(data))], F.lit(0))
        filled = F.lit(plan.missing_before) - still
    elif strategy == "drop":
        filled = F.lit(0)
    else:
        filled = F.lit(sum(f.filled for f in plan.fills.values() if f.value is not None))
    removed = (F.lit(before_filter) - F.col("rows_output")
               if plan.profile.handle_outliers else F.lit(0))
    return left.select(
        F.lit(plan.rows_input).cast("bigint").alias("rows_input"),
        F.lit(len(plan.names)).cast("bigint").alias("columns_input"),
        F.lit(copies).cast("bigint").alias("duplicates_removed"),
        F.lit(plan.empty_rows).cast("bigint").alias("empty_rows_removed"),
        F.lit(len(plan.names) - len(plan.kept)).cast("bigint").alias("empty_columns_removed"),
        F.lit(plan.columns_standardized).cast("bigint").alias("columns_standardized"),
        filled.cast("bigint").alias("missing_values_filled"),
        removed.cast("bigint").alias("outliers_removed"),
        "rows_output", F.lit(len(plan.kept)).cast("bigint").alias("columns_output"),
    )


def clean(df: DataFrame, profile: CleaningProfile = CleaningProfile(), row_id: str | None = None,
          sample_rows: int | None = None) -> tuple[DataFrame, CleaningPlan]:
    """Fit and transform; the frame is lazy, the plan is ready.

    The de-duplicated table that the plan was fitted on stays cached behind the frame, so its
    shuffle runs once.  With ``sample_rows`` the plan comes from a sample, as of ``fit_on_sample``.
    """
    if sample_rows is not None:
        if row_id is None:
            raise ValueError("a sample needs a row_id: it is drawn by it")
        plan = fit_on_sample(df, row_id, profile, sample_rows)
        return transform(df, plan), plan
    plan, staged = fit_staged(df, profile, row_id)
    return finish(staged, plan), plan


# -- comparison --------------------------------------------------------------

def _health(df: DataFrame, row_id: str | None) -> dict[str, Any]:
    data = [c for c in df.columns if c != row_id]
    row = df.agg(F.count(F.lit(1)).alias("rows"),
                 *[F.count(col(c)).alias(f"k{i}") for i, c in enumerate(data)]).first()
    copies = duplicate_summary(df, row_id).first()["duplicates"]
    missing = sum(row["rows"] - row[f"k{i}"] for i in range(len(data)))
    return {"rows": row["rows"], "cols": len(data), "missing": missing, "copies": copies}


def before_after(raw: DataFrame, cleaned: DataFrame, row_id: str | None = None,
                 cleaned_id: str | None = None) -> DataFrame:
    """Four rows: rows, columns, missing cells and duplicates, before and after."""
    a, b = _health(raw, row_id), _health(cleaned, cleaned_id or row_id)

    def share(part: int, whole: int) -> float:
        return part * 100.0 / whole if whole else 0.0

    rows = [
        ("rows", a["rows"], b["rows"], None, None),
        ("columns", a["cols"], b["cols"], None, None),
        ("missing_values", a["missing"], b["missing"],
         share(a["missing"], a["rows"] * a["cols"]), share(b["missing"], b["rows"] * b["cols"])),
        ("duplicate_rows", a["copies"], b["copies"],
         share(a["copies"], a["rows"]), share(b["copies"], b["rows"])),
    ]
    return raw.sparkSession.createDataFrame(
        [(m, x, y, x - y, p, q) for m, x, y, p, q in rows],
        "metric STRING, before LONG, after LONG, change LONG, before_pct DOUBLE, after_pct DOUBLE",
    )
