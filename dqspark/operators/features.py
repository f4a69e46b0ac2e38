"""Dataset-level features for the quality classifier.

``measures`` profiles one table, or many at once with a dataset column, in one
grouped pass plus two groupings for distinct values and copies.  The feature
sets are plain column expressions on it.  ``cell_measures`` does the same for
tables of different shape, stored as cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dqspark.functions.ordering import row_positions
from dqspark.functions.scalars import adjusted_kurtosis, adjusted_skew, blank_to_null, col, finite, to_number
from dqspark.operators.corrupt import normal
from dqspark.operators.profile import unpivot_texts, variation
from dqspark.operators.schema import long_report, numeric_columns

FEATURES8 = (
    "missing_ratio", "duplicate_ratio", "numeric_ratio", "constant_cols",
    "norm_variance", "skewness", "cardinality_ratio", "mean_kurtosis",
)
FEATURES6 = ("missing_ratio", "duplicate_ratio", "numeric_ratio", "constant_cols",
             "avg_variance", "avg_skewness")
VARIANCE_CAP = 1e6
# Distance of the drawn numbers of one copy of a row from those of the next.
COPY_SALT = 101

# The assessment's rule for each feature.  ``cap`` passes up to the limit, ``near``
# within the slack around it, ``none`` only at zero, ``under`` below limit times slack.
RULES = {
    "missing_ratio": ("cap", 0.1, 1.0),
    "duplicate_ratio": ("cap", 0.05, 1.0),
    "numeric_ratio": ("near", 0.5, 0.2),
    "constant_cols": ("none", 0.0, 1.0),
    "norm_variance": ("under", 2.0, 1.5),
    "skewness": ("under", 1.0, 1.5),
    "cardinality_ratio": ("under", 0.3, 1.5),
    "mean_kurtosis": ("under", 3.0, 1.5),
}
LEAST_SCALE = 0.01


def _mean_of(values: str) -> Column:
    """Mean of the known entries of an array, 0 when there is none."""
    known = F.array_compact(F.col(values))
    total = F.aggregate(known, F.lit(0.0), lambda a, b: a + b)
    return F.coalesce(F.try_divide(total, F.size(known)), F.lit(0.0))


def _population_variance(values: str) -> Column:
    known = F.array_compact(F.col(values))
    squares = F.aggregate(
        F.transform(known, lambda v: F.pow(v - F.col("__mean"), F.lit(2.0))),
        F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(known) > 1, squares / F.size(known)).otherwise(F.lit(0.0))


def _distinct_cells(df: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Distinct ``(*keep, column, number, text)``: numbers group as they are, faster than as text."""
    types = dict(df.dtypes)
    cells = []
    for i, n in enumerate(names):
        is_number = types[n] in ("double", "float")
        cells.append(F.struct(
            F.lit(i).alias("column"), (col(n) if is_number else F.lit(None)).cast("double").alias("number"),
            (F.lit(None) if is_number else col(n)).cast("string").alias("text")))
    return df.select(*[col(k) for k in keep], F.inline(F.array(*cells))).distinct()


def measures(df: DataFrame, dataset: str | None = None, row_id: str | None = None,
             extra: Sequence[str] = (), within: Sequence[str] = ()) -> DataFrame:
    """One row per dataset with counts and one array of measures per moment.

    ``extra`` are columns constant within a dataset (label, severity).  A dataset is a name
    within each value of ``within``; rows already partitioned by those stay where they are.
    """
    if dataset is None:
        dataset = "dataset_id"
        df = df.withColumn(dataset, F.lit("all"))
    own = [*within, dataset]
    keys = [*own, *extra]
    data = [c for c in df.columns if c not in keys and c != row_id]
    numbers = [n for n in numeric_columns(df) if n in data]
    aggs = [F.count(F.lit(1)).alias("num_rows")]
    aggs += [F.count(col(c)).alias(f"k{i}") for i, c in enumerate(data)]
    for i, n in enumerate(numbers):
        c = col(n).cast("double")
        aggs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"),
                 F.var_samp(c).alias(f"v{i}"), F.skewness(c).alias(f"g{i}"),
                 F.kurtosis(c).alias(f"h{i}")]
    moments = df.groupBy(*[col(k) for k in keys]).agg(*aggs)

    def each(make) -> Column:
        return F.array(*[make(i) for i in range(len(numbers))]).cast("array<double>")

    known: Column = F.lit(0).cast("bigint")
    for i in range(len(data)):
        known = known + F.col(f"k{i}")
    cells = F.col("num_rows") * len(data)
    base = moments.select(
        *[col(k) for k in keys], "num_rows", F.lit(len(data)).alias("num_columns"),
        F.lit(len(numbers)).alias("num_numeric"),
        F.try_divide(cells - known, cells).alias("missing_ratio"),
        each(lambda i: variation(F.col(f"m{i}"), F.col(f"s{i}"))).alias("variations"),
        each(lambda i: F.abs(adjusted_skew(F.col(f"n{i}"), F.col(f"g{i}")))).alias("skews"),
        each(lambda i: F.when(F.col(f"n{i}") > 0, F.abs(F.coalesce(finite(F.col(f"g{i}")), F.lit(0.0))))).alias("raw_skews"),
        each(lambda i: F.abs(adjusted_kurtosis(F.col(f"n{i}"), F.col(f"h{i}")))).alias("kurtoses"),
        each(lambda i: F.col(f"v{i}")).alias("variances"),
    )
    known_cell = F.col("number").isNotNull() | F.col("text").isNotNull()
    groups = [col(k) for k in own]
    distinct = (
        _distinct_cells(df, data, own)
        .groupBy(*groups, "column").agg(F.count_if(known_cell).alias("d"))
        .groupBy(*groups).agg(F.sum("d").alias("distinct_sum"),
                              F.count_if(F.col("d") <= 1).alias("constant_cols"))
    )
    copies = (
        df.groupBy(*groups, *[col(c) for c in data]).agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*groups).agg(F.sum(F.col("n") - 1).alias("duplicates"))
    )
    return base.join(distinct, own).join(copies, own)


def cell_measures(cells: DataFrame) -> DataFrame:
    """The same measures for cells ``(dataset_id, row_id, col_name, value STRING)``.

    A column is numeric when all its filled cells parse, as a file reader
    would decide.  A row's content is the sorted list of its own cells.
    """
    filled = cells.select("dataset_id", "row_id", "col_name", blank_to_null(F.col("value")).alias("value"))
    v = to_number(F.col("value"))
    per_column = filled.groupBy("dataset_id", "col_name").agg(
        F.count(F.lit(1)).alias("cells"), F.count("value").alias("known"), F.count(v).alias("n"),
        F.avg(v).alias("m"), F.stddev_samp(v).alias("s"), F.var_samp(v).alias("var"),
        F.skewness(v).alias("g"), F.kurtosis(v).alias("h"),
    )
    distinct = (
        filled.groupBy("dataset_id", "col_name", "value").agg(F.lit(1).alias("one"))
        .groupBy("dataset_id", "col_name").agg(F.count("value").alias("d"))
    )
    number = (F.col("n") == F.col("known")) & (F.col("known") > 0)

    def gather(c: Column) -> Column:
        return F.collect_list(F.when(number, c))

    columns = per_column.join(distinct, ["dataset_id", "col_name"]).groupBy("dataset_id").agg(
        F.max("cells").alias("num_rows"), F.count(F.lit(1)).cast("int").alias("num_columns"),
        F.count_if(number).cast("int").alias("num_numeric"),
        (1.0 - F.try_divide(F.sum("known"), F.sum("cells"))).alias("missing_ratio"),
        gather(variation(F.col("m"), F.col("s"))).alias("variations"),
        gather(F.abs(adjusted_skew(F.col("n"), F.col("g")))).alias("skews"),
        gather(F.abs(F.coalesce(finite(F.col("g")), F.lit(0.0)))).alias("raw_skews"),
        gather(F.abs(adjusted_kurtosis(F.col("n"), F.col("h")))).alias("kurtoses"),
        gather(F.col("var")).alias("variances"),
        F.sum("d").alias("distinct_sum"), F.count_if(F.col("d") <= 1).alias("constant_cols"),
    )
    # One list per row, as long as the row is wide; copies meet on its text.
    rows = filled.groupBy("dataset_id", "row_id").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("col_name", "value")))).alias("content")
    )
    copies = (
        rows.groupBy("dataset_id", "content").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("dataset_id").agg(F.sum(F.col("n") - 1).alias("duplicates"))
    )
    return columns.join(copies, "dataset_id")


def to_cells(df: DataFrame, dataset: Column, row_id: str, skip: Sequence[str] = ()) -> DataFrame:
    """Bring a table into cell form."""
    data = [c for c in df.columns if c != row_id and c not in skip]
    return unpivot_texts(df.withColumn("dataset_id", dataset), data, ["dataset_id", row_id]).select(
        "dataset_id", col(row_id).alias("row_id"), F.col("column").alias("col_name"), "value")


def _shared(df: DataFrame) -> list[Column]:
    taken = {"num_numeric", "missing_ratio", "variations", "skews", "raw_skews", "kurtoses",
             "variances", "distinct_sum", "constant_cols", "duplicates"}
    keys = [col(c) for c in df.columns if c not in taken]
    return [
        *keys, "missing_ratio",
        (F.col("duplicates") / F.col("num_rows")).alias("duplicate_ratio"),
        (F.col("num_numeric") / F.col("num_columns")).alias("numeric_ratio"),
        F.col("constant_cols").cast("double").alias("constant_cols"),
    ]


def _cardinality() -> Column:
    return F.col("distinct_sum") / F.col("num_columns") / F.col("num_rows")


def features8(m: DataFrame) -> DataFrame:
    return m.select(
        *_shared(m), _mean_of("variations").alias("norm_variance"),
        _mean_of("skews").alias("skewness"),
        F.least(_cardinality(), F.lit(1.0)).alias("cardinality_ratio"),
        F.least(_mean_of("kurtoses") / 10, F.lit(1.0)).alias("mean_kurtosis"),
    )


def features6(m: DataFrame, cap: float | None = None) -> DataFrame:
    """Older set: plain mean variance and mean population skewness."""
    variance, skew = _mean_of("variances"), _mean_of("raw_skews")
    if cap is not None:
        variance, skew = F.least(variance, F.lit(cap)), F.least(skew, F.lit(cap))
    return m.select(*_shared(m), variance.alias("avg_variance"), skew.alias("avg_skewness"))


def features6_normalised(m: DataFrame) -> DataFrame:
    return features8(m).drop("cardinality_ratio", "mean_kurtosis")


def features10(m: DataFrame) -> DataFrame:
    held = m.withColumn("__mean", _mean_of("skews"))
    shared = [c for c in _shared(m)]
    return held.select(
        *shared, _mean_of("variations").alias("norm_variance"), F.col("__mean").alias("skewness"),
        (F.col("num_numeric") / F.col("num_columns")).alias("type_consistency"),
        F.least(_cardinality() * 100, F.lit(100.0)).alias("cardinality_pct"),
        _population_variance("skews").alias("skewness_variance"),
        _mean_of("kurtoses").alias("mean_kurtosis"),
    )


def features13(six: DataFrame) -> DataFrame:
    """Six features and seven products, logs and ratios of them."""
    m, d, n = F.col("missing_ratio"), F.col("duplicate_ratio"), F.col("numeric_ratio")
    v, s = F.col("avg_variance"), F.col("avg_skewness")
    size = F.abs(s)
    return six.select(
        "*", (m * d).alias("missing_x_duplicate"), (m * n).alias("missing_x_numeric"),
        (v * s).alias("variance_x_skew"), F.log1p(v).alias("log_variance"),
        F.log1p(size).alias("log_skew"), (v / (size + 1e-10)).alias("variance_per_skew"),
        (size / (v + 1e-10)).alias("skew_per_variance"),
    )


def feature_vector(eight: DataFrame) -> DataFrame:
    return eight.withColumn("features", F.array(*[F.col(f).cast("double") for f in FEATURES8]))


# -- assessment --------------------------------------------------------------

def within_rule(name: str, v: Column) -> Column:
    kind, limit, slack = RULES[name]
    tests = {"cap": v <= limit, "near": F.abs(v - limit) < slack, "none": v == 0, "under": v < limit * slack}
    return tests[kind]


def goodness(name: str, v: Column) -> Column:
    """1 where the feature is best by its rule, falling to 0 at the rule's scale."""
    kind, limit, slack = RULES[name]
    away = F.abs(v - limit) if kind == "near" else v
    scale = limit * slack if kind == "under" else limit
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - away / max(scale, LEAST_SCALE)))


def feature_flags(eight: DataFrame, keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Long table: each feature beside its rule's limit, with PASS or FLAG and its goodness."""
    facts = [
        F.struct(
            F.lit(no).alias("feature_no"), F.lit(name).alias("feature"), F.col(name).alias("value"),
            F.lit(limit).alias("threshold"),
            F.when(within_rule(name, F.col(name)), "PASS").otherwise("FLAG").alias("status"),
            goodness(name, F.col(name)).alias("radar"))
        for no, (name, (_, limit, _)) in enumerate(RULES.items())]
    return eight.select(*[col(k) for k in keys], F.inline(F.array(*facts)))


# -- training sets -----------------------------------------------------------

def class_balance(labelled: DataFrame, keys: Sequence[str] = ("label", "severity")) -> DataFrame:
    return labelled.groupBy(*keys).agg(F.count(F.lit(1)).alias("datasets"))


def mean_imputed(df: DataFrame, names: Sequence[str] = FEATURES8) -> DataFrame:
    """Missing features replaced by the feature's mean."""
    from pyspark.ml.feature import Imputer

    return Imputer(inputCols=list(names), outputCols=list(names), strategy="mean").fit(df).transform(df)


def standardised(df: DataFrame, names: Sequence[str] = FEATURES8) -> DataFrame:
    """Vector ``scaled`` with zero mean and unit deviation per feature."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    packed = VectorAssembler(inputCols=list(names), outputCol="raw", handleInvalid="keep").transform(df)
    return StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(packed).transform(packed).drop("raw")


def augmented(df: DataFrame, names: Sequence[str] = FEATURES8, copies: int = 1, seed: int = 42,
              spread: float = 0.05, key: str = "dataset_id") -> DataFrame:
    """Original feature rows plus noisy copies, clipped to 0..100.

    The noise of a value is drawn from its row's key, its copy and its feature, so it is
    the same whenever and wherever a task runs.
    """
    many = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    row = F.conv(F.substring(F.md5(col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    out = []
    for c in many.columns:
        if c in names:
            salt = F.col("copy") * COPY_SALT + seed + list(names).index(c)
            value = col(c).cast("double")
            moved = F.least(F.lit(100.0), F.greatest(F.lit(0.0), value + normal(row, salt) * spread))
            # ``least`` and ``greatest`` pass over a missing value, which stays missing here.
            out.append(F.when((F.col("copy") == 0) | value.isNull(), value).otherwise(moved).alias(c))
        else:
            out.append(col(c))
    return many.select(*out)


def downsampled(df: DataFrame, key: str, label: str = "label", ratio: float = 1.5,
                seed: int = 42) -> DataFrame:
    """All good rows and at most ``ratio`` times as many bad ones, drawn by hash order."""
    sizes = df.agg(F.count_if(col(label) == 1).alias("good"), F.count_if(col(label) == 0).alias("bad")).first()
    keep = min(sizes["bad"], int(sizes["good"] * ratio))
    bad = df.where(col(label) == 0).withColumn("__order", F.xxhash64(col(key), F.lit(seed)))
    placed = row_positions(bad, "__order", "__at").where(F.col("__at") < keep)
    return df.where(col(label) == 1).unionByName(placed.select(*[col(c) for c in df.columns]))


def thresholds(spark) -> DataFrame:
    return spark.createDataFrame(
        [(no, name, limit) for no, (name, (_, limit, _)) in enumerate(RULES.items())], "feature_no INT, feature STRING, threshold DOUBLE")
