"""Column types: naming, inference from text, guarded casts, column names."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from dqspark.functions.scalars import (
    TIMESTAMP_FORMATS, blank_to_null, col, finite, leading_number, mask, mask_code,
    moment_and_fits, to_boolean, to_number, to_time,
)

INTERNAL_COLUMNS = ("_is_outlier",)

# Name parts that mark a column as numeric while cleaning.
NUMERIC_HINTS = (
    "age", "salary", "price", "cost", "amount", "revenue", "score", "rating", "years",
    "experience", "count", "total", "quantity", "id", "year", "month", "day",
)
COERCE_SHARE = 0.2      # cleaning: more than this share must parse
INFER_SHARE = 0.70      # intake: more than this share of all rows must parse
DECLARED_SHARE = 0.1    # declared type: keep the text at or below this share
LENIENT_SHARE = 0.8     # viewer: numeric above this share of filled cells


def logical_type(data_type: T.DataType) -> str:
    """integer, float, datetime, boolean or categorical."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "categorical"


def logical_types(df: DataFrame) -> dict[str, str]:
    return {f.name: logical_type(f.dataType) for f in df.schema.fields}


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [n for n, t in logical_types(df).items()
            if t in ("integer", "float") and n not in skip]


def categorical_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    """Every column that is not a number, dates and flags included."""
    return [n for n, t in logical_types(df).items()
            if t not in ("integer", "float") and n not in skip]


def type_table(df: DataFrame) -> DataFrame:
    """One row per column: its position, logical type and numeric/categorical side."""
    rows = [(i, n, t, "numeric" if t in ("integer", "float") else "categorical")
            for i, (n, t) in enumerate(logical_types(df).items())]
    return df.sparkSession.createDataFrame(
        rows, "position INT, column STRING, logical_type STRING, side STRING"
    )


def type_counts(df: DataFrame) -> DataFrame:
    """``type_table`` with the number of filled cells of each column, counted in one scan."""
    counts = df.agg(*[F.count(col(n)).alias(f"k{i}") for i, n in enumerate(df.columns)])
    return long_report(counts, [
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.lit(t).alias("logical_type"),
                 F.lit("numeric" if t in ("integer", "float") else "categorical").alias("side"),
                 F.col(f"k{i}").alias("known"))
        for i, (n, t) in enumerate(logical_types(df).items())])


def drop_internal(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in INTERNAL_COLUMNS if c in df.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Give missing numbers one form: NULL."""
    return df.select(*[
        finite(col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else col(f.name)
        for f in df.schema.fields
    ])


def long_report(one_row: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn a one-row aggregate into one row per struct."""
    return one_row.select(F.inline(F.array(*structs)))


# -- inference ---------------------------------------------------------------

def infer_report(df: DataFrame, formats: Sequence[str] = TIMESTAMP_FORMATS) -> DataFrame:
    """One row per text column with the evidence and the inferred type.

    All columns and formats are tested in a single pass, in which the shape of a cell
    says which formats are in question, and one parse whether they fit.
    """
    texts = [n for n, t in df.dtypes if t == "string"]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(texts):
        c = col(n)
        aggs += [F.count(c).alias(f"known{i}"), F.count(to_number(c)).alias(f"num{i}")]
        fits = moment_and_fits(c, F.col(f"__mask{i}"), F.col(f"__code{i}"), formats)[1]
        aggs.append(F.bit_and(F.when(c.isNotNull(), fits)).alias(f"fits{i}"))
    structs = []
    for i, n in enumerate(texts):
        known, rows = F.col(f"known{i}"), F.col("rows")
        fmt = F.coalesce(*[
            F.when(F.col(f"fits{i}").bitwiseAND(F.lit(1 << j)) != 0, F.lit(f)) for j, f in enumerate(formats)
        ])
        share = F.try_divide(F.col(f"num{i}"), rows)
        kind = (F.when(fmt.isNotNull(), "datetime")
                .when(share > INFER_SHARE, "numeric").otherwise("categorical"))
        structs.append(F.struct(
            F.lit(n).alias("column"), known.alias("known"), F.col(f"num{i}").alias("numeric"),
            share.alias("numeric_share"), fmt.alias("format"), kind.alias("inferred"),
        ))
    if not structs:
        return df.sparkSession.createDataFrame(
            [], "column STRING, known LONG, numeric LONG, numeric_share DOUBLE, "
                "format STRING, inferred STRING")
    masked = df.select(*[col(n) for n in texts], *[mask(col(n)).alias(f"__mask{i}") for i, n in enumerate(texts)])
    coded = masked.select("*", *[mask_code(F.col(f"__mask{i}"), formats).alias(f"__code{i}") for i in range(len(texts))])
    return long_report(coded.agg(*aggs), structs)


def infer_types(df: DataFrame, formats: Sequence[str] = TIMESTAMP_FORMATS) -> DataFrame:
    """Give text columns the type their values show: time first, then number."""
    found = {r["column"]: r for r in infer_report(df, formats).collect()}
    out = []
    for n in df.columns:
        report = found.get(n)
        if report is None or report["inferred"] == "categorical":
            out.append(col(n))
        elif report["inferred"] == "datetime":
            out.append(to_time(col(n), report["format"]).alias(n))
        else:
            out.append(to_number(col(n)).alias(n))
    return df.select(*out)


def declared_report(df: DataFrame, declared: Mapping[str, str]) -> DataFrame:
    """Per declared numeric column: how much parses and whether the cast is applied."""
    names = [n for n, t in declared.items()
             if n in df.columns and t in ("integer", "float", "numeric")]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(names):
        aggs += [F.count(col(n)).alias(f"known{i}"), F.count(to_number(col(n))).alias(f"num{i}")]
    structs = []
    for i, n in enumerate(names):
        share = F.coalesce(F.try_divide(F.col(f"num{i}"), F.col("rows")), F.lit(0.0))
        structs.append(F.struct(
            F.lit(n).alias("column"), F.col(f"known{i}").alias("known"),
            F.col(f"num{i}").alias("numeric"), share.alias("numeric_share"),
            ((share > DECLARED_SHARE) | (F.col(f"known{i}") == 0)).alias("applied"),
        ))
    return long_report(df.agg(*aggs), structs)


def apply_declared(df: DataFrame, declared: Mapping[str, str],
                   formats: Sequence[str] = TIMESTAMP_FORMATS) -> DataFrame:
    """Cast to declared types; a numeric cast that would wipe a column is skipped."""
    wanted = {n: t for n, t in declared.items() if n in df.columns}
    applied = set()
    if any(t in ("integer", "float", "numeric") for t in wanted.values()):
        applied = {r["column"] for r in declared_report(df, wanted).collect() if r["applied"]}
    out = []
    for n in df.columns:
        kind = wanted.get(n)
        if n in applied:
            out.append(to_number(col(n)).alias(n))
        elif kind == "datetime":
            tries = [F.try_to_timestamp(col(n).cast("string"), F.lit(f)) for f in formats]
            out.append(F.coalesce(*tries).alias(n))
        elif kind == "boolean":
            out.append(to_boolean(col(n)).alias(n))
        else:
            out.append(col(n))
    return df.select(*out)


def hinted(name: str, match: str = "substring") -> bool:
    """Does the name look numeric?  ``token`` demands a whole word of the name."""
    lowered = name.lower()
    if match == "token":
        return bool(set(re.split(r"[^a-z0-9]+", lowered)) & set(NUMERIC_HINTS))
    return any(h in lowered for h in NUMERIC_HINTS)


def coercion_report(df: DataFrame, hint_match: str = "substring") -> DataFrame:
    """Per text column: parseable share and whether cleaning turns it into numbers."""
    texts = [n for n, t in df.dtypes if t == "string"]
    if not texts:
        return df.sparkSession.createDataFrame(
            [], "column STRING, numeric LONG, numeric_share DOUBLE, hinted BOOLEAN, "
                "converted BOOLEAN")
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count(to_number(col(n))).alias(f"num{i}") for i, n in enumerate(texts)]
    structs = []
    for i, n in enumerate(texts):
        parsed = F.col(f"num{i}")
        share = F.coalesce(F.try_divide(parsed, F.col("rows")), F.lit(0.0))
        by_name = F.lit(hinted(n, hint_match))
        structs.append(F.struct(
            F.lit(n).alias("column"), parsed.alias("numeric"), share.alias("numeric_share"),
            by_name.alias("hinted"),
            ((share > COERCE_SHARE) | (by_name & (parsed > 0))).alias("converted"),
        ))
    return long_report(df.agg(*aggs), structs)


def coerce_numeric_like(df: DataFrame, hint_match: str = "substring") -> tuple[DataFrame, list[str]]:
    """Convert text columns that hold numbers; returns the frame and their names."""
    names = [r["column"] for r in coercion_report(df, hint_match).collect() if r["converted"]]
    return convert_to_numbers(df, names), names


def convert_to_numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    chosen = set(names)
    return df.select(*[to_number(col(n)).alias(n) if n in chosen else col(n)
                       for n in df.columns])


# -- names -------------------------------------------------------------------

def standard_names(names: Sequence[str]) -> list[str]:
    """snake_case names; empty ones become ``col_i`` and clashes get a number."""
    taken: set[str] = set()
    out = []
    for i, name in enumerate(names):
        base = re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_") or f"col_{i}"
        unique, k = base, 2
        while unique in taken:
            unique, k = f"{base}_{k}", k + 1
        taken.add(unique)
        out.append(unique)
    return out


def standardise_columns(df: DataFrame) -> tuple[DataFrame, int]:
    """Rename to standard names; also returns how many names changed."""
    names = standard_names(df.columns)
    return df.toDF(*names), sum(a != b for a, b in zip(df.columns, names))


# -- viewer rules ------------------------------------------------------------

def lenient_report(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Per column: filled cells, cells with a leading number, numeric or not."""
    names = list(names or df.columns)
    aggs = []
    for i, n in enumerate(names):
        aggs += [F.count(blank_to_null(col(n))).alias(f"f{i}"),
                 F.count(leading_number(col(n))).alias(f"n{i}")]
    structs = [
        F.struct(
            F.lit(n).alias("column"), F.col(f"f{i}").alias("filled"),
            F.col(f"n{i}").alias("numeric"),
            (F.col(f"n{i}") > F.col(f"f{i}") * LENIENT_SHARE).alias("is_numeric"),
        )
        for i, n in enumerate(names)
    ]
    return long_report(df.agg(*aggs), structs)
