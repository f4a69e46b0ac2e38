"""Correlation, trend and straight-line fits."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window, functions as F

from dqspark.functions.ordering import known_positions, named
from dqspark.functions.scalars import col, rounded
from dqspark.operators.schema import numeric_columns

STRONG, MODERATE = 0.7, 0.4
TREND_MIN_ROWS = 5
TREND_LEVEL = 0.3
FLAT_BAND = 0.05
PAIRS_KEPT = 50
# A spread below this share of the sum of squares is a constant's rounding.
CONSTANT = 1e-13

# Two-sided 5 % critical points of Student's t for 3..41 degrees
# of freedom.  From 42 degrees on, |r| > 0.3 is always significant.
T_CRITICAL = (
    3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139, 2.200985,
    2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963,
    2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230,
    2.042272, 2.039513, 2.036933, 2.034515, 2.032245, 2.030108, 2.028094, 2.026192, 2.024394,
    2.022691, 2.021075, 2.019541,
)
T_FIRST_DF = 3


def strength(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size >= STRONG, "strong").when(size >= MODERATE, "moderate").otherwise("weak")


def direction(r: Column) -> Column:
    return F.when(r >= 0, "positive").otherwise("negative")


def pearson(a: Column, b: Column) -> Column:
    """Aggregate: correlation over rows where both are known; NULL if one is constant."""
    x = F.when(b.isNotNull(), a.cast("double"))
    y = F.when(a.isNotNull(), b.cast("double"))
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.try_divide(F.covar_pop(x, y), spread)


def pearson_matrix(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Every pair ``(i, j, col_a, col_b, r)`` of numeric columns, unrounded.

    One scan for the means and one for a Gram matrix over each row's centred values, their squares
    and known marks (missing ones count 0): it holds the sums of every pair over the rows where
    both are known.  Its size depends on the number of columns alone.
    """
    names = list(names or numeric_columns(df))
    spark, k = df.sparkSession, len(names)
    schema = "i INT, j INT, col_a STRING, col_b STRING, r DOUBLE"
    if k < 2:
        return spark.createDataFrame([], schema)
    numbers = [col(n).cast("double") for n in names]
    means = [m or 0.0 for m in df.agg(*[F.avg(c) for c in numbers]).first()]
    centred = [F.coalesce(c - F.lit(m), F.lit(0.0)) for c, m in zip(numbers, means)]
    known = [c.isNotNull().cast("double") for c in numbers]
    rows = df.select(array_to_vector(F.array(*centred, *[c * c for c in centred], *known)).alias("v"))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(rows), 0, 3 * k).computeGramianMatrix().toArray()
    both, x, xx = gram[2 * k:, 2 * k:], gram[:k, 2 * k:], gram[k:2 * k, 2 * k:]
    square = both * xx
    spread = square - x * x
    # What is left of rounding when all values are one is not a spread.
    spread = np.where(spread > CONSTANT * square, spread, 0.0)
    below = np.sqrt(spread * spread.T)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(below > 0, (both * gram[:k, :k] - x * x.T) / below, np.nan)
    found = [(i, j, names[i], names[j], None if np.isnan(r[i, j]) else float(r[i, j]))
             for i, j in combinations(range(k), 2)]
    return spark.createDataFrame(found, schema)


def pearson_pairs(df: DataFrame, names: Sequence[str] | None = None,
                  top: int | None = PAIRS_KEPT) -> DataFrame:
    """Pairs ranked by strength with their label and sign."""
    r = F.col("r")
    pairs = pearson_matrix(df, names).where(r.isNotNull()).select(
        "col_a", "col_b", rounded(r).alias("pearson_r"),
        strength(r).alias("strength"), direction(r).alias("direction"),
    )
    if top is None:
        return pairs
    return pairs.orderBy(F.abs("pearson_r").desc(), "col_a", "col_b").limit(top)


def heatmap(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Lower triangle of the correlation matrix."""
    return pearson_matrix(df, names).select(
        F.col("col_b").alias("row"), F.col("col_a").alias("column"), "r"
    )


def _critical_r(n: Column) -> Column:
    limits = [(t * t / (t * t + T_FIRST_DF + i)) ** 0.5 for i, t in enumerate(T_CRITICAL)]
    small = F.get(F.array(*[F.lit(v) for v in limits]), n.cast("int") - 2 - T_FIRST_DF)
    return F.coalesce(small, F.lit(0.0))


def trends(df: DataFrame, names: Sequence[str], row_id: str,
           buckets: int | None = None) -> DataFrame:
    """Monotonic trend per column: Spearman of value against row order.

    Rows with the same value share a rank, so their positions are summed per
    value first; ranks are then worked out on distinct values alone.
    """
    names = list(dict.fromkeys(names))
    cells = known_positions(df, names, row_id, buckets)
    counted = cells.groupBy("column", "bucket", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("position").cast("double")).alias("places"))
    # Mean rank of a value within its bucket; its rank is that and the rows of the buckets before.
    inside = Window.partitionBy("column", "bucket").orderBy("value").rowsBetween(
        Window.unboundedPreceding, -1)
    x = F.coalesce(F.sum("n").over(inside), F.lit(0)) + (F.col("n") + 1) / 2.0
    held = counted.withColumn("x", x).groupBy("column", "bucket").agg(
        F.sum("n").alias("rows"), F.sum("places").alias("places"),
        F.sum(F.col("x") * F.col("places")).alias("x_places"),
        F.sum(F.col("n") * F.col("x")).alias("xs"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("xxs"))
    # One row per column and bucket from here on; ranks are centred by what ``shift`` adds.
    of_column = Window.partitionBy("column")
    earlier = of_column.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("rows").over(of_column)
    shift = F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - (total + 1) / 2.0
    moved = held.withColumns({"total": total, "shift": shift})
    c = F.col("shift")
    sums = moved.groupBy("column").agg(
        F.max("total").alias("n"), F.sum(F.col("x_places") + c * F.col("places")).alias("together"),
        F.sum(F.col("xxs") + 2 * c * F.col("xs") + c * c * F.col("rows")).alias("spread"))
    rows = F.col("n").cast("double")
    order_spread = rows * (rows * rows - 1) / 12.0
    rho = F.try_divide("together", F.sqrt(F.col("spread")) * F.sqrt(order_spread))
    n = F.col("n")
    label = (
        F.when(n < TREND_MIN_ROWS, F.lit(None).cast("string"))
        .when(F.col("rho").isNull() | (F.abs("rho") <= TREND_LEVEL)
              | (F.abs("rho") < _critical_r(n)), "flat")
        .when(F.col("rho") > 0, "increasing").otherwise("decreasing")
    )
    return sums.withColumn("rho", rho).select(
        named(F.col("column"), names).alias("column"), "n", "rho", label.alias("trend"))


def half_trends(df: DataFrame, names: Sequence[str], row_id: str,
                buckets: int | None = None) -> DataFrame:
    """Simpler trend: mean of the first half of the rows against the second."""
    names = list(dict.fromkeys(names))
    cells = known_positions(df, names, row_id, buckets)
    early = F.col("position") < F.floor(F.col("known") / 2)
    found = cells.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(early, F.col("value"))).alias("first_mean"),
        F.avg(F.when(~early, F.col("value"))).alias("second_mean"),
    )
    gap = F.col("second_mean") - F.col("first_mean")
    label = (
        F.when(F.col("n") < TREND_MIN_ROWS, F.lit(None).cast("string"))
        .when(F.abs(gap) < FLAT_BAND * (F.abs("first_mean") + 1e-9), "flat")
        .when(gap > 0, "increasing").otherwise("decreasing")
    )
    return found.select(
        named(F.col("column"), names).alias("column"), "n", "first_mean", "second_mean", label.alias("trend"))


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line through all rows where both values are known."""
    both = df.select(col(x).cast("double").alias("x"), col(y).cast("double").alias("y")).dropna()
    sums = both.agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.covar_pop("x", "y").alias("cxy"), F.var_pop("x").alias("vx"),
        F.min("x").alias("x_min"), F.max("x").alias("x_max"),
    )
    slope = F.when(F.col("n") >= 2, F.try_divide("cxy", "vx"))
    return sums.select(
        "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"),
        "x_min", "x_max",
    )


def sign_agreement(reported: DataFrame, fresh: DataFrame, first: int = 10) -> DataFrame:
    """Do the strongest reported pairs still have the sign that was reported?"""
    top = reported.orderBy(F.abs("pearson_r").desc(), "col_a", "col_b").limit(first).select(
        "col_a", "col_b", F.col("pearson_r").alias("reported_r")
    )
    now = fresh.select("col_a", "col_b", F.col("pearson_r").alias("actual_r"))
    return now.join(F.broadcast(top), ["col_a", "col_b"]).select(
        "col_a", "col_b", "reported_r", "actual_r",
        ((F.col("reported_r") >= 0) == (F.col("actual_r") >= 0)).alias("agrees"),
    )
