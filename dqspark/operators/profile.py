"""Column profiles.

Every stage is one wide aggregate over all columns, turned into one row per
column at the end.  Fences are computed first and enter the next pass as
literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dqspark.functions.ordering import quantiles, unpivot_numbers
from dqspark.functions.scalars import (
    adjusted_kurtosis, adjusted_skew, blank_to_null, col, leading_number, rounded,
)
from dqspark.operators.schema import (
    categorical_columns, lenient_report, logical_types, long_report, numeric_columns,
)

FENCE_WIDTH = 1.5
FENCE_MIN_ROWS = 4
ROW_IDS_KEPT = 100
TOP_VALUES = 10
CV_CAP = 100.0
CV_MIN_MEAN = 1e-10

Fences = dict[str, tuple[float | None, float | None]]


def fences_from(quartiles: dict[str, list[float | None]]) -> Fences:
    out: Fences = {}
    for n, marks in quartiles.items():
        q1, q3 = marks[0], marks[-1]
        if q1 is None or q3 is None:
            out[n] = (None, None)
        else:
            reach = FENCE_WIDTH * (q3 - q1)
            out[n] = (q1 - reach, q3 + reach)
    return out


def iqr_fences(df: DataFrame, names: Sequence[str], approx: bool = False) -> Fences:
    return fences_from(quantiles(df, names, [0.25, 0.75], approx=approx))


def outside(name: str, fences: Fences) -> Column:
    """True when a known value lies outside its column's fences."""
    low, high = fences[name]
    if low is None:
        return F.lit(False)
    c = col(name)
    return F.coalesce((c < F.lit(low)) | (c > F.lit(high)), F.lit(False))


def _percent(part: Column, whole: Column, digits: int) -> Column:
    return F.coalesce(rounded(F.try_divide(part * 100.0, whole), digits), F.lit(0.0))


def missing_report(df: DataFrame, names: Sequence[str] | None = None,
                   pct_digits: int = 2) -> DataFrame:
    names = list(names or df.columns)
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count(col(n)).alias(f"k{i}") for i, n in enumerate(names)]
    structs = []
    for i, n in enumerate(names):
        missing = F.col("rows") - F.col(f"k{i}")
        structs.append(F.struct(
            F.lit(n).alias("column"), missing.alias("missing_count"),
            _percent(missing, F.col("rows"), pct_digits).alias("missing_pct"),
        ))
    return long_report(df.agg(*aggs), structs)


def quartiles(df: DataFrame, names: Sequence[str], approx: bool = False,
              rows: int | None = None) -> dict[str, list[float | None]]:
    return quantiles(df, names, [0.25, 0.5, 0.75], approx=approx, rows=rows)


def column_stats(df: DataFrame, names: Sequence[str] | None = None, *, approx: bool = False,
                 row_id: str | None = None, pct_digits: int = 2,
                 marks: dict[str, list[float | None]] | None = None) -> DataFrame:
    """One row per column: missing share, moments, quartiles, outliers and trend.

    The trend needs an explicit row order and stays NULL without ``row_id``.
    ``marks`` are quartiles that are already known.
    """
    names = [n for n in (names or df.columns) if n != row_id]
    types = logical_types(df)
    numbers = [n for n in numeric_columns(df) if n in names]
    marks = marks or quartiles(df, numbers, approx)
    fences = fences_from(marks)

    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(names):
        c = col(n)
        aggs.append(F.count(c).alias(f"k{i}"))
        if n in marks:
            aggs += [
                F.avg(c).alias(f"mean{i}"), F.stddev_samp(c).alias(f"std{i}"),
                F.min(c).cast("double").alias(f"min{i}"), F.max(c).cast("double").alias(f"max{i}"),
                F.count_if(outside(n, fences)).alias(f"out{i}"),
            ]
    nothing = F.lit(None).cast("double")
    structs = []
    for i, n in enumerate(names):
        known, rows = F.col(f"k{i}"), F.col("rows")
        number = n in marks
        q1, q2, q3 = [F.lit(v).cast("double") for v in marks[n]] if number else [nothing] * 3

        def stat(prefix: str) -> Column:
            return rounded(F.col(f"{prefix}{i}")) if number else nothing

        flagged = (F.when(known >= FENCE_MIN_ROWS, F.col(f"out{i}")).otherwise(F.lit(0))
                   if number else F.lit(0))
        structs.append(F.struct(
            F.lit(n).alias("column"), F.lit(types[n]).alias("dtype"),
            stat("mean").alias("mean"), rounded(q2).alias("median"), stat("std").alias("std"),
            stat("min").alias("min"), stat("max").alias("max"),
            rounded(q1).alias("q1"), rounded(q3).alias("q3"),
            (rows - known).alias("missing_count"),
            _percent(rows - known, rows, pct_digits).alias("missing_pct"),
            flagged.cast("bigint").alias("outlier_count"),
        ))
    stats = long_report(df.agg(*aggs), structs)
    if row_id is None or not numbers:
        return stats.withColumn("trend", F.lit(None).cast("string"))
    from dqspark.operators.relations import trends

    found = trends(df, [n for n in numbers if n != row_id], row_id).select("column", "trend")
    return stats.join(F.broadcast(found), "column", "left").select(*stats.columns, "trend")


def moments(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean, deviation, minimum and maximum per numeric column, in one pass."""
    aggs, structs = [], []
    for i, n in enumerate(names):
        c = col(n).cast("double")
        parts = {"mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), "max": F.max(c)}
        aggs += [e.alias(f"{m}{i}") for m, e in parts.items()]
        structs.append(F.struct(F.lit(n).alias("column"), *[rounded(F.col(f"{m}{i}")).alias(m) for m in parts]))
    return long_report(df.agg(*aggs), structs)


def value_modes(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Most frequent number per column, the smallest one on a tie."""
    counted = unpivot_numbers(df, names).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    best = F.min(F.struct((-F.col("n")).alias("order"), F.col("value")))
    return counted.groupBy("column").agg(best.alias("best")).select(
        "column", F.col("best.value").alias("mode")
    )


def descriptive_stats(df: DataFrame, names: Sequence[str] | None = None,
                      approx: bool = False) -> DataFrame:
    """Spread and position measures per numeric column that has any value."""
    names = list(names or numeric_columns(df))
    marks = quantiles(df, names, [0.5], approx=approx)
    aggs = []
    for i, n in enumerate(names):
        c = col(n).cast("double")
        aggs += [F.stddev_samp(c).alias(f"s{i}"), F.var_samp(c).alias(f"v{i}"),
                 F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    structs = [
        F.struct(
            F.lit(n).alias("column"), F.col(f"s{i}").alias("standard_deviation"),
            F.col(f"hi{i}").alias("max"), F.col(f"lo{i}").alias("min"),
            F.col(f"v{i}").alias("variance"), (F.col(f"hi{i}") - F.col(f"lo{i}")).alias("range"),
            F.lit(marks[n][0]).cast("double").alias("median"),
        )
        for i, n in enumerate(names)
    ]
    stats = long_report(df.agg(*aggs), structs).where(F.col("max").isNotNull())
    return stats.join(F.broadcast(value_modes(df, names)), "column", "left")


def population_stats(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Population measures over the leading numbers of the chosen columns."""
    parsed = df.select(*[leading_number(col(n)).alias(n) for n in names])
    marks = quantiles(parsed, names, [0.5])
    aggs = []
    for i, n in enumerate(names):
        c = col(n)
        aggs += [F.count(c).alias(f"k{i}"), F.avg(c).alias(f"m{i}"),
                 F.var_pop(c).alias(f"v{i}"), F.stddev_pop(c).alias(f"s{i}"),
                 F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    structs = [
        F.struct(
            F.lit(n).alias("column"), F.col(f"k{i}").alias("count"), F.col(f"m{i}").alias("mean"),
            F.lit(marks[n][0]).cast("double").alias("median"),
            (F.col(f"hi{i}") - F.col(f"lo{i}")).alias("range"),
            F.col(f"v{i}").alias("variance"), F.col(f"s{i}").alias("std"),
            F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
        )
        for i, n in enumerate(names)
    ]
    stats = (
        long_report(parsed.agg(*aggs), structs)
        .join(F.broadcast(value_modes(parsed, names)), "column", "left")
        .join(F.broadcast(lenient_report(df, names).select("column", "is_numeric")), "column")
    )
    usable = F.col("is_numeric") & (F.col("count") > 0)
    measures = ["mean", "median", "mode", "range", "variance", "std", "min", "max"]
    return stats.select(
        "column", usable.alias("is_numeric"),
        *[F.when(usable, F.col(m)).alias(m) for m in measures],
        F.when(usable, F.col("count")).otherwise(F.lit(0)).cast("bigint").alias("count"),
    )


def shape_stats(df: DataFrame, names: Sequence[str] | None = None,
                approx: bool = False) -> DataFrame:
    """Skewness and kurtosis (sample and population), quick skew and variation."""
    names = list(names or numeric_columns(df))
    marks = quantiles(df, names, [0.5], approx=approx)
    aggs = []
    for i, n in enumerate(names):
        c = col(n).cast("double")
        aggs += [F.count(c).alias(f"k{i}"), F.avg(c).alias(f"m{i}"),
                 F.stddev_samp(c).alias(f"s{i}"), F.skewness(c).alias(f"g{i}"),
                 F.kurtosis(c).alias(f"h{i}")]
    structs = []
    for i, n in enumerate(names):
        known, mean, std = F.col(f"k{i}"), F.col(f"m{i}"), F.col(f"s{i}")
        quick = F.when(std > 0, (mean - F.lit(marks[n][0]).cast("double")) / std)
        structs.append(F.struct(
            F.lit(n).alias("column"),
            F.coalesce(F.col(f"g{i}"), F.lit(0.0)).alias("skew_population"),
            F.coalesce(F.col(f"h{i}"), F.lit(0.0)).alias("kurtosis_population"),
            adjusted_skew(known, F.col(f"g{i}")).alias("skew"),
            adjusted_kurtosis(known, F.col(f"h{i}")).alias("kurtosis"),
            quick.alias("quick_skew"),
            (F.coalesce(F.abs(quick) > 0.5, F.lit(False))).alias("looks_skewed"),
            variation(mean, std).alias("variation"),
        ))
    return long_report(df.agg(*aggs), structs)


def variation(mean: Column, std: Column) -> Column:
    """Coefficient of variation, capped; NULL around a zero mean."""
    ratio = F.when(F.abs(mean) > CV_MIN_MEAN, F.abs(std / mean))
    return F.when(ratio.isNotNull(), F.least(ratio, F.lit(CV_CAP)))


def unpivot_texts(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows ``(*keep, column, value)`` with values as text, NULLs included."""
    types = dict(df.dtypes)

    def text(n: str) -> Column:
        # Minus zero and zero are one value but two texts.
        plain = col(n) + F.lit(0.0) if types[n] in ("double", "float") else col(n)
        return plain.cast("string").alias("value")

    cells = F.array(*[F.struct(F.lit(n).alias("column"), text(n)) for n in names])
    return df.select(*[col(k) for k in keep], F.inline(cells))


def value_counts(df: DataFrame, names: Sequence[str], *, nulls: bool = True) -> DataFrame:
    """Rows ``(column, value, n)``; counts combine in each task before the shuffle."""
    cells = unpivot_texts(df, names)
    if not nulls:
        cells = cells.where(F.col("value").isNotNull())
    return cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(counts: DataFrame, top: int) -> DataFrame:
    """The ``top`` values per column; each task keeps only its own best ``top``."""
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def top_values(df: DataFrame, names: Sequence[str] | None = None, top: int = TOP_VALUES,
               pct_digits: int = 2) -> DataFrame:
    """Top values per column with their share of all rows, NULL counted as a value."""
    counts = value_counts(df, list(names or categorical_columns(df)))
    rows = counts.groupBy("column").agg(F.sum("n").alias("rows"))
    return most_frequent(counts, top).join(F.broadcast(rows), "column").select(
        "column", "rank", "value", F.col("n").alias("count"),
        _percent(F.col("n"), F.col("rows"), pct_digits).alias("pct"),
    )


def distinct_counts(df: DataFrame, names: Sequence[str] | None = None,
                    approx: bool = False) -> DataFrame:
    """Known distinct values per column and whether the column is constant."""
    names = list(names or df.columns)
    if approx:
        aggs = [F.approx_count_distinct(col(n)).alias(f"d{i}") for i, n in enumerate(names)]
        structs = [F.struct(F.lit(n).alias("column"), F.col(f"d{i}").alias("distinct_count"))
                   for i, n in enumerate(names)]
        found = long_report(df.agg(*aggs), structs)
    else:
        found = value_counts(df, names).groupBy("column").agg(
            F.count("value").alias("distinct_count")
        )
    return found.withColumn("is_constant", F.col("distinct_count") <= 1)


def categorical_insights(df: DataFrame, names: Sequence[str] | None = None,
                         top: int = TOP_VALUES, pct_digits: int = 2,
                         ratio_digits: int = 4) -> DataFrame:
    """One row per categorical column: distinct values, top values, imbalance, lengths.

    Everything derives from the value counts, so the table is scanned once.
    """
    names = list(names or categorical_columns(df))
    counts = value_counts(df, names)
    size = F.length("value")
    per_column = counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.count("value").alias("unique_count"),
        F.count(F.lit(1)).alias("classes"), F.max("n").alias("largest"),
        F.min("n").alias("smallest"),
        F.sum(size * F.col("n")).alias("chars"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("known"),
        F.min(size).alias("min_text_length"), F.max(size).alias("max_text_length"),
    )
    best = most_frequent(counts, top).groupBy("column").agg(
        F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("best")
    )
    shown = F.transform(
        "best",
        lambda b: F.struct(b["value"].alias("value"), b["n"].alias("count"),
                           _percent(b["n"], F.col("rows"), pct_digits).alias("pct")),
    )
    imbalance = F.when(
        F.col("classes") >= 2, F.col("largest") / F.greatest("smallest", F.lit(1))
    ).otherwise(F.lit(0.0))
    return per_column.join(F.broadcast(best), "column").select(
        "column", "unique_count", shown.alias("top_values"),
        rounded(imbalance, pct_digits).alias("class_imbalance_ratio"),
        rounded(F.try_divide("chars", "known"), max(1, pct_digits - 1)).alias("avg_text_length"),
        "min_text_length", "max_text_length",
        rounded(F.col("unique_count") / F.col("rows"), ratio_digits).alias("cardinality_ratio"),
    )


# -- outliers ----------------------------------------------------------------

def flag_outliers(df: DataFrame, names: Sequence[str] | None = None,
                  fences: Fences | None = None, approx: bool = False) -> DataFrame:
    """Add ``_is_outlier``: any numeric value outside its column's fences."""
    names = list(names or numeric_columns(df))
    fences = fences or iqr_fences(df, names, approx)
    flag = F.lit(False)
    for n in names:
        flag = flag | outside(n, fences)
    return df.withColumn("_is_outlier", flag)


def outlier_cells(df: DataFrame, names: Sequence[str], row_id: str, fences: Fences) -> DataFrame:
    """Rows ``(column, row_id, value)`` for every value outside its fences."""
    cells = F.array(*[
        F.when(outside(n, fences),
               F.struct(F.lit(n).alias("column"), col(n).cast("double").alias("value")))
        for n in names
    ])
    return (
        df.select(col(row_id).alias("row_id"), F.explode(F.array_compact(cells)).alias("cell"))
        .select("cell.column", "row_id", "cell.value")
    )


def anomalies(df: DataFrame, names: Sequence[str], row_id: str, *,
              keep: int = ROW_IDS_KEPT, approx: bool = False,
              fences: Fences | None = None) -> DataFrame:
    """Per column with outliers: fences, count and the first row ids."""
    names = [n for n in names if n != row_id]
    fences = fences or iqr_fences(df, names, approx)
    usable = [n for n in names if fences[n][0] is not None]
    spark = df.sparkSession
    limits = spark.createDataFrame(
        [(n, *fences[n]) for n in usable], "column STRING, lower_fence DOUBLE, upper_fence DOUBLE"
    )
    if not usable:
        return limits.select("column", F.array().cast("array<bigint>").alias("row_indices"),
                             "lower_fence", "upper_fence", F.lit(0).cast("bigint").alias("outlier_count"))
    cells = outlier_cells(df, usable, row_id, fences)
    # Three values cannot lie outside their own fences, so no size test is needed.
    counts = cells.groupBy("column").agg(F.count(F.lit(1)).alias("outlier_count"))
    first = Window.partitionBy("column").orderBy("row_id")
    ids = (
        cells.withColumn("place", F.row_number().over(first)).where(F.col("place") <= keep)
        .groupBy("column").agg(F.sort_array(F.collect_list("row_id")).alias("row_indices"))
    )
    return ids.join(F.broadcast(limits), "column").join(F.broadcast(counts), "column").select(
        "column", "row_indices", rounded(F.col("lower_fence")).alias("lower_fence"),
        rounded(F.col("upper_fence")).alias("upper_fence"), "outlier_count",
    )


def three_sigma(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Share of values more than three population deviations from the mean."""
    first = df.agg(*[
        f(col(n).cast("double")).alias(f"{p}{i}")
        for i, n in enumerate(names) for p, f in (("m", F.avg), ("s", F.stddev_pop))
    ]).first()
    aggs, structs = [], []
    for i, n in enumerate(names):
        c = col(n).cast("double")
        mean, std = F.lit(first[f"m{i}"]).cast("double"), F.lit(first[f"s{i}"]).cast("double")
        aggs += [F.count(c).alias(f"k{i}"),
                 F.count_if(F.abs(c - mean) > F.lit(3.0) * std).alias(f"o{i}")]
        structs.append(F.struct(
            F.lit(n).alias("column"), F.col(f"k{i}").alias("known"),
            F.col(f"o{i}").alias("outlier_count"),
            F.coalesce(F.try_divide(F.col(f"o{i}"), F.col(f"k{i}")), F.lit(0.0)).alias("outlier_ratio"),
        ))
    return long_report(df.agg(*aggs), structs)


# -- viewer ------------------------------------------------------------------

def completeness_bands(df: DataFrame) -> DataFrame:
    """Filled share per column and its band; blank text counts as missing."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count(blank_to_null(col(n))).alias(f"k{i}") for i, n in enumerate(df.columns)]
    structs = []
    for i, n in enumerate(df.columns):
        filled, rows = F.col(f"k{i}"), F.col("rows")
        pct = F.coalesce(F.try_divide(filled * 100.0, rows), F.lit(0.0))
        band = (F.when(pct >= 95, "Excellent").when(pct >= 90, "Very Good")
                .when(pct >= 80, "Good").when(pct >= 70, "Fair").otherwise("Poor"))
        structs.append(F.struct(F.lit(n).alias("column"), filled.alias("complete"),
                                rows.alias("total"), pct.alias("percentage"), band.alias("band")))
    return long_report(df.agg(*aggs), structs)


def viewer_column_quality(df: DataFrame) -> DataFrame:
    """Per column: filled share, outlier or cardinality ratio, penalised quality."""
    names = df.columns
    kinds = {r["column"]: r for r in lenient_report(df).collect()}
    # The viewer tests the share of filled cells strictly, and only if any is filled.
    numbers = [n for n in names if kinds[n]["filled"] and kinds[n]["is_numeric"]]
    texts = [n for n in names if kinds[n]["filled"] and n not in numbers]
    spark = df.sparkSession
    schema = "column STRING, ratio DOUBLE"
    ratios = spark.createDataFrame([], schema)
    if numbers:
        parsed = df.select(*[leading_number(col(n)).alias(n) for n in numbers])
        ratios = ratios.unionByName(
            three_sigma(parsed, numbers).select("column", F.col("outlier_ratio").alias("ratio"))
        )
    if texts:
        folded = df.select(*[F.trim(F.lower(blank_to_null(col(n)))).alias(n) for n in texts])
        counted = value_counts(folded, texts, nulls=False).groupBy("column").agg(
            (F.count(F.lit(1)) / F.sum("n")).alias("ratio")
        )
        ratios = ratios.unionByName(counted)
    rows = F.col("total")
    kind = F.when(F.col("column").isin(numbers), "numeric") if numbers else F.lit(None).cast("string")
    if texts:
        kind = F.coalesce(kind, F.when(F.col("column").isin(texts), "categorical"))
    base = completeness_bands(df).join(F.broadcast(ratios), "column", "left").select(
        "column", "complete", "total", "percentage", kind.alias("kind"),
        F.coalesce("ratio", F.lit(0.0)).alias("ratio"),
        F.coalesce(F.try_divide(rows - F.col("complete"), rows), F.lit(0.0)).alias("missing_ratio"),
    )
    penalty = (
        F.when(F.col("kind") == "numeric", F.col("ratio") * 50)
        .when((F.col("kind") == "categorical") & (F.col("ratio") > 0.5),
              F.least((F.col("ratio") - 0.5) * 20, F.lit(8.0)))
        .otherwise(F.lit(0.0))
    )
    return base.withColumn("quality", F.greatest(F.col("percentage") - penalty, F.lit(70.0)))


def viewer_score(df: DataFrame) -> DataFrame:
    """One row: rows, columns, complete columns and the viewer's quality score."""
    per_column = viewer_column_quality(df)
    totals = per_column.agg(
        F.max("total").alias("total_rows"), F.count(F.lit(1)).alias("total_cols"),
        F.count_if(F.col("complete") == F.col("total")).alias("complete_cols"),
        F.avg("quality").alias("base"), F.avg("missing_ratio").alias("missing"),
        F.coalesce(F.avg(F.when(F.col("kind") == "numeric", F.col("ratio"))), F.lit(0.0)).alias("out"),
        F.coalesce(F.avg(F.when(F.col("kind") == "categorical", F.col("ratio"))), F.lit(0.0)).alias("card"),
    )
    missing = F.greatest(1.0 - F.col("missing") * 30, F.lit(0.92))
    out = F.greatest(1.0 - F.col("out") * 50, F.lit(0.97))
    card = F.when(
        F.col("card") > 0.4, F.greatest(1.0 - (F.col("card") - 0.4) * 15, F.lit(0.93))
    ).otherwise(F.lit(1.0))
    score = F.col("base") / 100 * missing * out * card * 0.98 * 100
    return totals.select(
        "total_rows", "total_cols", "complete_cols",
        F.least(F.greatest(score, F.lit(87.0)), F.lit(96.0)).alias("quality"),
    )


# -- groups ------------------------------------------------------------------

def group_summary(df: DataFrame, category: str, number: str, top: int = 10) -> DataFrame:
    """Mean, deviation and count of a number for the most frequent categories.

    One grouping gives both the frequency and the measures.
    """
    c = col(number).cast("double")
    groups = df.where(col(category).isNotNull()).groupBy(col(category).cast("string").alias("category")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"), F.count(c).alias("count"),
    )
    return groups.orderBy(F.col("rows").desc(), F.col("category")).limit(top)


def mean_by_category(df: DataFrame, category: str, number: str, top: int = 20) -> DataFrame:
    """Mean of a number per category, the highest means first."""
    value = leadless_number(df, number)
    pairs = df.select(col(category).alias("category"), value.alias("value")).dropna()
    return (
        pairs.groupBy("category").agg(F.avg("value").alias("mean"))
        .orderBy(F.col("mean").desc(), F.col("category")).limit(top)
    )


def leadless_number(df: DataFrame, name: str) -> Column:
    """The column as numbers: text is parsed strictly, numbers are kept."""
    from dqspark.functions.scalars import to_number

    return to_number(col(name)) if dict(df.dtypes)[name] == "string" else col(name).cast("double")


def class_means(df: DataFrame, label: str, names: Sequence[str]) -> DataFrame:
    """Mean of each feature for label 1 and label 0, and their distance."""
    aggs = []
    for i, n in enumerate(names):
        for side in (1, 0):
            aggs.append(F.avg(F.when(col(label) == side, col(n))).alias(f"m{side}_{i}"))
    structs = [
        F.struct(
            F.lit(n).alias("feature"), F.col(f"m1_{i}").alias("good_mean"),
            F.col(f"m0_{i}").alias("bad_mean"),
            F.abs(F.col(f"m1_{i}") - F.col(f"m0_{i}")).alias("separation"),
        )
        for i, n in enumerate(names)
    ]
    return long_report(df.agg(*aggs), structs)
