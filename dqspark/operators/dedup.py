"""Duplicate rows and table fingerprints.

Copies are found by grouping on the data columns.  Grouping combines inside
each task before the shuffle, so a group that holds a third of all rows
arrives as a handful of partial rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dqspark.functions.scalars import col

NULL_MARK = "\u0001"
FIELD_MARK = "\u0002"


def _data_columns(df: DataFrame, row_id: str | None) -> list[str]:
    return [c for c in df.columns if c != row_id]


def drop_duplicate_rows(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """One row per distinct content (NULLs are equal); keeps the smallest row id."""
    if row_id is None:
        return df.dropDuplicates()
    data = _data_columns(df, row_id)
    firsts = df.groupBy(*[col(c) for c in data]).agg(F.min(col(row_id)).alias(row_id))
    return firsts.select(*[col(c) for c in df.columns])


def duplicate_summary(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """One row: rows, distinct rows, duplicates and their share."""
    data = _data_columns(df, row_id)
    groups = df.groupBy(*[col(c) for c in data]).agg(F.count(F.lit(1)).alias("n"))
    totals = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows")
    )
    spare = F.col("rows") - F.col("distinct_rows")
    return totals.select(
        "rows", "distinct_rows", spare.alias("duplicates"),
        F.coalesce(F.try_divide(spare, F.col("rows")), F.lit(0.0)).alias("duplicate_ratio"),
    )


def mark_duplicates(df: DataFrame, row_id: str) -> DataFrame:
    """Add ``is_duplicate``: true for every copy after the first by row id.

    The first ids are joined back on the unique row id, so no join key is
    ever shared by many rows.
    """
    firsts = drop_duplicate_rows(df, row_id).select(
        col(row_id), F.lit(False).alias("is_duplicate")
    )
    return df.join(firsts, row_id, "left").select(
        *[col(c) for c in df.columns],
        F.coalesce(F.col("is_duplicate"), F.lit(True)).alias("is_duplicate"),
    )


def split_by_ids(df: DataFrame, ids: DataFrame, row_id: str) -> tuple[DataFrame, DataFrame]:
    """Rows with and without a listed row id."""
    return df.join(ids, row_id, "left_semi"), df.join(ids, row_id, "left_anti")


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row ``(rows, digest)``: the same for the same rows in any order.

    Each row's MD5 gives a 60-bit number; their sum does not depend on order
    and partial sums combine before the shuffle.  Every value goes with its length,
    so no value can pass for two.
    """
    names = list(columns or df.columns)
    texts = [F.coalesce(F.concat(F.char_length(col(n).cast("string")).cast("string"), F.lit(":"),
                                 col(n).cast("string")), F.lit(NULL_MARK)) for n in names]
    digest = F.md5(F.concat_ws(FIELD_MARK, *texts))
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(28,0)")
    total = F.coalesce(F.sum(number), F.lit(0).cast("decimal(38,0)"))
    header = F.lit(FIELD_MARK.join(names))
    return df.agg(F.count(F.lit(1)).alias("rows"), total.alias("__total")).select(
        "rows",
        F.md5(F.concat_ws("|", header, F.col("rows").cast("string"),
                          F.col("__total").cast("string"))).alias("digest"),
    )


def unchanged(df: DataFrame, profile_digest: str, markers: DataFrame) -> DataFrame:
    """Was this exact table cleaned with this profile before?  One row, ``skip``.

    ``markers`` holds ``(digest, profile_digest)`` of earlier runs.
    """
    now = fingerprint(df).withColumn("profile_digest", F.lit(profile_digest))
    seen = markers.select("digest", "profile_digest").distinct().withColumn("__seen", F.lit(True))
    return now.join(seen, ["digest", "profile_digest"], "left").select(
        "digest", "profile_digest", F.coalesce(F.col("__seen"), F.lit(False)).alias("skip")
    )
