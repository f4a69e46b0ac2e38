"""Inputs of the queries.  The given tables are clean, so damage is added here,
with the same expressions in Spark and in the checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dqspark.functions.ordering import bucket_count

# Orders with gaps, blank text, wild numbers and a constant column.
GAPPY_COLUMNS = {
    "o_orderkey": "o_orderkey",
    "o_custkey": "CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE o_custkey END",
    "o_totalprice": "CASE WHEN o_orderkey % 5 = 2 THEN NULL WHEN o_orderkey % 97 = 1 "
                    "THEN o_totalprice * 20 ELSE o_totalprice END",
    "o_rank": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey * 2 + o_custkey % 50 END",
    "o_orderstatus": "o_orderstatus",
    "o_orderpriority": "CASE WHEN o_orderkey % 11 = 4 THEN NULL ELSE o_orderpriority END",
    "o_flag": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'yes' END",
}
GAPPY_SQL = ("SELECT " + ", ".join(f"{e} AS {n}" for n, e in GAPPY_COLUMNS.items())
             + " FROM orders")

# The same table with every tenth row copied and two columns and rows left empty.
_DATA = [n for n in GAPPY_COLUMNS if n != "o_orderkey"]
MESSY_SQL = f"""
SELECT o_orderkey, {", ".join(_DATA)}, CAST(NULL AS VARCHAR) AS o_empty FROM ({GAPPY_SQL}) g
UNION ALL
SELECT -1 - o_orderkey AS o_orderkey, {", ".join(_DATA)}, CAST(NULL AS VARCHAR) AS o_empty
FROM ({GAPPY_SQL}) g WHERE o_orderkey % 10 = 0
UNION ALL
SELECT -1000000000 - o_orderkey AS o_orderkey, {", ".join(f"NULL AS {n}" for n in _DATA)},
       CAST(NULL AS VARCHAR) AS o_empty FROM orders WHERE o_orderkey % 50 = 0
"""

# Customers as a file reader would give them: text only, with junk.
TEXT_COLUMNS = {
    "c_custkey": "CAST(c_custkey AS VARCHAR(20))",
    "c_name": "CASE WHEN c_custkey % 9 = 2 THEN '   ' WHEN c_custkey % 9 = 5 THEN NULL ELSE c_name END",
    "c_balance": "CASE WHEN c_custkey % 6 = 1 THEN 'unknown' WHEN c_custkey % 6 = 2 THEN NULL "
                 "ELSE CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR(20)) END",
    "c_units": "CASE WHEN c_custkey % 8 = 1 THEN CONCAT(CAST(c_nationkey AS VARCHAR(20)), ' units') "
               "ELSE CAST(c_nationkey AS VARCHAR(20)) END",
    "c_age": "CASE WHEN c_custkey % 20 = 0 THEN CAST(c_nationkey AS VARCHAR(20)) ELSE 'n.a.' END",
    "c_joined": "CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE CONCAT('2023-0', "
                "CAST(c_custkey % 9 + 1 AS VARCHAR(20)), '-1', CAST(c_custkey % 10 AS VARCHAR(20))) END",
    "c_mixed": "CASE WHEN c_custkey % 2 = 0 THEN '2023-05-06' ELSE 'Jan 5 2023' END",
    "c_active": "CASE WHEN c_custkey % 5 = 0 THEN 'TRUE' WHEN c_custkey % 5 = 1 THEN 'False' "
                "WHEN c_custkey % 5 = 2 THEN 'yes' ELSE NULL END",
    "c_mktsegment": "c_mktsegment",
}
TEXT_SQL = ("SELECT " + ", ".join(f"{e} AS {n}" for n, e in TEXT_COLUMNS.items())
            + " FROM customer")

# Feedback rows made from the event stream.
FEEDBACK_SQL = """
SELECT event_id AS id, md5(CAST(user_id % 40 AS VARCHAR(20))) AS dataset_hash,
       CASE WHEN event_id % 53 = 0 THEN -5.0 WHEN event_id % 59 = 0 THEN 150.0
            ELSE CAST((event_id * 37) % 101 AS DOUBLE) END AS predicted_score,
       CASE WHEN event_id % 61 = 0 THEN 4 ELSE CAST(event_id % 4 AS INTEGER) END AS actual_label,
       CASE WHEN event_id % 13 = 0 THEN 2 WHEN event_id % 17 = 0 THEN 0 ELSE 8 END AS feature_count,
       ts FROM events
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _spark_text(sql: str) -> str:
    return sql.replace("VARCHAR(20)", "STRING").replace("VARCHAR", "STRING")


def from_sql(spark: SparkSession, folder: str, sql: str, *names: str, cells: int = 0) -> DataFrame:
    """Run a damage statement on the tables it names.

    With ``cells``, the costly ones made of a row, the rows are first dealt to as many tasks as
    these need: a small file is one task, however much is made of its rows.
    """
    tables = {n: table(spark, folder, n) for n in names}
    if cells:
        tables = {n: df.repartition(bucket_count(df.count() * cells)) for n, df in tables.items()}
    return spark.sql(_swap(_spark_text(sql), names), **tables)


def _swap(sql: str, names: tuple[str, ...]) -> str:
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
    return sql


def gappy(spark: SparkSession, folder: str) -> DataFrame:
    return from_sql(spark, folder, GAPPY_SQL, "orders")


def messy(spark: SparkSession, folder: str) -> DataFrame:
    return from_sql(spark, folder, MESSY_SQL, "orders")


def as_text(spark: SparkSession, folder: str) -> DataFrame:
    return from_sql(spark, folder, TEXT_SQL, "customer")


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    rows = from_sql(spark, folder, FEEDBACK_SQL, "events")
    return rows.withColumn(
        "features", F.transform(F.sequence(F.lit(0), F.col("feature_count") + 1),
                                lambda i: i.cast("double"))
    ).withColumn("features", F.slice("features", F.lit(1), F.col("feature_count")))


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double so that the last bits of a sum do not matter."""
    return df.select(*[
        (F.round(F.col(f"`{n}`"), special.get(n, digits)) + F.lit(0.0)).alias(n)
        if t == "double" else F.col(f"`{n}`")
        for n, t in df.dtypes
    ])


def as_doubles(df: DataFrame, *names: str) -> DataFrame:
    """Whole numbers with gaps as doubles, the same type on both sides."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})


# -- SQL pieces --------------------------------------------------------------

def r(expression: str, digits: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def cells(source: str, names: list[str], keep: str = "", kind: str = "DOUBLE") -> str:
    """Rows (keep, column, value) without NULLs."""
    lead = f"{keep}, " if keep else ""
    return union([
        f"SELECT {lead}'{n}' AS \"column\", CAST({n} AS {kind}) AS value FROM {source} WHERE {n} IS NOT NULL"
        for n in names])


def fences(source: str, names: list[str]) -> str:
    """One row per column: quartiles and fences."""
    return f"""
SELECT "column", q1, q3, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high, n FROM (
  SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n
  FROM ({cells(source, names)}) c GROUP BY "column") q"""
