"""Types, missing values, the cleaning steps and their composite."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.corruption import draw
from catalog.profiling import LINE_NUMBERS, ORDER_NUMBERS, ORDER_TEXTS, leading_sql, mode_sql, stats_sql
from catalog.tables import (
    GAPPY_SQL, MESSY_SQL, TEXT_COLUMNS, TEXT_SQL, as_doubles, as_text, cells, fences, from_sql,
    gappy, messy, r, rounded, table, union,
)
from dqspark.functions import scalars as S
from dqspark.operators import clean as K, explore, schema

# -- types -------------------------------------------------------------------


_LINE_TYPES = {
    "l_orderkey": ("integer", "numeric"), "l_partkey": ("integer", "numeric"), "l_suppkey": ("integer", "numeric"),
    "l_linenumber": ("integer", "numeric"), "l_quantity": ("float", "numeric"), "l_extendedprice": ("float", "numeric"),
    "l_discount": ("float", "numeric"), "l_tax": ("float", "numeric"), "l_returnflag": ("categorical", "categorical"),
    "l_linestatus": ("categorical", "categorical"), "l_shipdate": ("datetime", "categorical"),
}
# Cells that are taken out, by column.
_LINE_GAPS = {"l_quantity": "l_orderkey % 7 = 3", "l_returnflag": "l_partkey % 5 = 1", "l_shipdate": "l_linenumber = 2"}


@query(union([
    f"""SELECT {i} AS position, '{n}' AS "column", '{kind}' AS logical_type, '{side}' AS side,
  count({f"CASE WHEN NOT ({_LINE_GAPS[n]}) THEN 1 END" if n in _LINE_GAPS else n}) AS known FROM lineitem"""
    for i, (n, (kind, side)) in enumerate(_LINE_TYPES.items())]))
def type_table(spark, folder):
    lines = table(spark, folder, "lineitem").select(*_LINE_TYPES)
    gappy_lines = lines.select(*[
        F.when(~F.expr(_LINE_GAPS[n]), F.col(n)).alias(n) if n in _LINE_GAPS else F.col(n) for n in _LINE_TYPES])
    return schema.type_counts(schema.drop_internal(gappy_lines.withColumn("_is_outlier", F.lit(False))))


# The time formats of the library in the form DuckDB reads.
SQL_FORMATS = {
    "yyyy-MM-dd": "%Y-%m-%d", "yyyy-MM-dd HH:mm:ss": "%Y-%m-%d %H:%M:%S", "yyyy/MM/dd": "%Y/%m/%d",
    "MM/dd/yyyy": "%m/%d/%Y", "dd-MM-yyyy": "%d-%m-%Y", "MMM d yyyy": "%b %d %Y",
}


def number_sql(n: str) -> str:
    """A finite number or NULL."""
    return f"CASE WHEN isfinite(TRY_CAST({n} AS DOUBLE)) THEN TRY_CAST({n} AS DOUBLE) END"


def _inferred(n: str) -> str:
    tests = " ".join(
        f"WHEN count({n}) > 0 AND count(try_strptime({n}, '{f}')) = count({n}) THEN '{s}'"
        for s, f in SQL_FORMATS.items())
    fmt = f"CASE {tests} END"
    num = f"count({number_sql(n)})"
    return f"""SELECT '{n}' AS "column", count({n}) AS known, {num} AS "numeric",
  {r(f"{num} * 1.0 / count(*)")} AS numeric_share, {fmt} AS format,
  CASE WHEN {fmt} IS NOT NULL THEN 'datetime' WHEN {num} * 1.0 / count(*) > 0.70 THEN 'numeric'
    ELSE 'categorical' END AS inferred FROM ({TEXT_SQL}) x"""


@query(union([_inferred(n) for n in TEXT_COLUMNS]))
def infer_report(spark, folder):
    return rounded(schema.infer_report(as_text(spark, folder)))


# Every time format of the library as DuckDB reads it, with the shape that it must have.
SQL_SHAPES = {
    "yyyy-MM-dd": (r"\d{4}-\d\d-\d\d", ["%Y-%m-%d"]),
    "yyyy-MM-dd HH:mm:ss": (r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", ["%Y-%m-%d %H:%M:%S"]),
    "yyyy/MM/dd": (r"\d{4}/\d\d/\d\d", ["%Y/%m/%d"]),
    "MM/dd/yyyy": (r"\d\d/\d\d/\d{4}", ["%m/%d/%Y"]),
    "dd-MM-yyyy": (r"\d\d-\d\d-\d{4}", ["%d-%m-%Y"]),
    "MMM d yyyy": (r"[A-Za-z]+ \d\d? \d{4}", ["%b %d %Y"]),
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]": (r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?", [
        "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f%z"]),
    "yyyy-MM-dd HH:mm:ss.SSSSSS[XXX]": (r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d+(Z|[+-]\d\d:\d\d)?", [
        "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S.%f%z"]),
    "yyyy-MM-dd HH:mm": (r"\d{4}-\d\d-\d\d \d\d:\d\d", ["%Y-%m-%d %H:%M"]),
    "yyyy/MM/dd HH:mm:ss": (r"\d{4}/\d\d/\d\d \d\d:\d\d:\d\d", ["%Y/%m/%d %H:%M:%S"]),
    "M/d/yyyy": (r"\d\d?/\d\d?/\d{4}", ["%m/%d/%Y"]),
    "M/d/yyyy H:mm[:ss]": (r"\d\d?/\d\d?/\d{4} \d\d?:\d\d(:\d\d)?", ["%m/%d/%Y %H:%M", "%m/%d/%Y %H:%M:%S"]),
    "d-M-yyyy": (r"\d\d?-\d\d?-\d{4}", ["%d-%m-%Y"]),
    "yyyy-M-d": (r"\d{4}-\d\d?-\d\d?", ["%Y-%m-%d"]),
    "MMM d, yyyy": (r"[A-Za-z]+ \d\d?, \d{4}", ["%b %d, %Y"]),
    "d MMM yyyy": (r"\d\d? [A-Za-z]+ \d{4}", ["%d %b %Y"]),
}
_MONTH, _DAY, _HOUR = "(o_orderkey % 12 + 1)", "(o_custkey % 28 + 1)", "(o_orderkey % 24)"


def _digits(e: str) -> str:
    return f"lpad(CAST({e} AS VARCHAR(20)), 2, '0')"


def _number(e: str) -> str:
    return f"CAST({e} AS VARCHAR(20))"


_Y, _MM, _DD, _HH = "'2023'", _digits(_MONTH), _digits(_DAY), _digits(_HOUR)
_MMM = f"substring('JanFebMarAprMayJunJulAugSepOctNovDec', CAST({_MONTH} * 3 - 2 AS INTEGER), 3)"
_ZONE = "CASE WHEN o_orderkey % 4 = 0 THEN 'Z' WHEN o_orderkey % 4 = 1 THEN '+05:30' WHEN o_orderkey % 4 = 2 THEN '-03:00' ELSE '' END"
_PART = "CASE WHEN o_orderkey % 3 = 0 THEN '.250000' ELSE '' END"
# One column for each format, one with days that no month has, and one of two formats.
TIME_COLUMNS = {
    "d0": [_Y, "'-'", _MM, "'-'", _DD], "d1": [_Y, "'-'", _MM, "'-'", _DD, "' '", _HH, "':05:09'"],
    "d2": [_Y, "'/'", _MM, "'/'", _DD], "d3": [_MM, "'/'", _DD, "'/'", _Y], "d4": [_DD, "'-'", _MM, "'-'", _Y],
    "d5": [_MMM, "' '", _number(_DAY), "' '", _Y], "d6": [_Y, "'-'", _MM, "'-'", _DD, "'T'", _HH, "':05:09'", _PART, _ZONE],
    "d7": [_Y, "'-'", _MM, "'-'", _DD, "' '", _HH, "':05:09.125000'", _ZONE], "d8": [_Y, "'-'", _MM, "'-'", _DD, "' '", _HH, "':59'"],
    "d9": [_Y, "'/'", _MM, "'/'", _DD, "' '", _HH, "':05:09'"], "d10": [_number(_MONTH), "'/'", _number(_DAY), "'/'", _Y],
    "d11": [_number(_MONTH), "'/'", _number(_DAY), "'/'", _Y, "' '", _number(_HOUR), "CASE WHEN o_custkey % 2 = 0 THEN ':07' ELSE ':07:08' END"],
    "d12": [_number(_DAY), "'-'", _number(_MONTH), "'-'", _Y], "d13": [_Y, "'-'", _number(_MONTH), "'-'", _number(_DAY)],
    "d14": [_MMM, "' '", _number(_DAY), "', '", _Y], "d15": [_number(_DAY), "' '", _MMM, "' '", _Y],
    "odd": [_Y, "'-'", _MM, "'-'", _digits("(o_custkey % 31 + 1)")], "two": [_Y, "CASE WHEN o_custkey % 2 = 0 THEN '/' ELSE '-' END", _MM, "'-'", _DD],
}
TIMES_SQL = "SELECT " + ", ".join(
    f"CASE WHEN o_orderkey % {7 + i} = 3 THEN NULL ELSE CONCAT({', '.join(parts)}) END AS {n}"
    for i, (n, parts) in enumerate(TIME_COLUMNS.items())) + " FROM orders"


def _timed(n: str) -> str:
    def fits(shape: str, forms: list[str]) -> str:
        read = ", ".join(f"try_strptime(regexp_replace({n}, 'Z$', '+00:00'), '{f}')::TIMESTAMP" for f in forms)
        return f"count(CASE WHEN regexp_full_match({n}, '{shape}') AND coalesce({read}) IS NOT NULL THEN 1 END) = count({n})"
    quoted = {s.replace("'", "''"): v for s, v in SQL_SHAPES.items()}
    fmt = "CASE " + " ".join(f"WHEN count({n}) > 0 AND {fits(*v)} THEN '{s}'" for s, v in quoted.items()) + " END"
    return f"""SELECT '{n}' AS "column", count({n}) AS known, count({number_sql(n)}) AS "numeric", {r("0")} AS numeric_share,
  {fmt} AS format, CASE WHEN {fmt} IS NOT NULL THEN 'datetime' ELSE 'categorical' END AS inferred FROM ({TIMES_SQL}) x"""


@query(union([_timed(n) for n in TIME_COLUMNS]))
def infer_time_formats(spark, folder):
    """A column for every time format, each found by its shape and one parse a cell."""
    return rounded(schema.infer_report(from_sql(spark, folder, TIMES_SQL, "orders", cells=len(TIME_COLUMNS))))


@query(f"""
SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_balance, CAST(c_units AS DOUBLE) AS c_units,
  strftime(strptime(c_joined, '%Y-%m-%d'), '%Y-%m-%d') AS c_joined, c_mixed, c_mktsegment
FROM (SELECT c_custkey, c_balance, {number_sql("c_units")} AS c_units, c_joined, c_mixed, c_mktsegment FROM ({TEXT_SQL}) x) y
""")
def infer_types(spark, folder):
    typed = schema.infer_types(as_text(spark, folder))
    return typed.select("c_custkey", "c_balance", "c_units",
                        F.date_format("c_joined", "yyyy-MM-dd").alias("c_joined"), "c_mixed", "c_mktsegment")


_DECLARED = {"c_custkey": "integer", "c_balance": "float", "c_age": "integer", "c_mixed": "datetime",
             "c_active": "boolean"}


@query(f"""
SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, {number_sql("c_balance")} AS c_balance, c_age,
  strftime(coalesce({", ".join(f"try_strptime(c_mixed, '{f}')" for f in SQL_FORMATS.values())}), '%Y-%m-%d') AS c_mixed,
  CASE lower(c_active) WHEN 'true' THEN 1 WHEN 'false' THEN 0 ELSE -1 END AS c_active
FROM ({TEXT_SQL}) x
""")
def apply_declared_types(spark, folder):
    typed = schema.apply_declared(as_text(spark, folder), _DECLARED)
    return typed.select(
        "c_custkey", "c_balance", "c_age", F.date_format("c_mixed", "yyyy-MM-dd").alias("c_mixed"),
        F.coalesce(F.col("c_active").cast("int"), F.lit(-1)).alias("c_active"))


_HINTED = {"c_age"}


@query(union([f"""SELECT '{n}' AS "column", count({number_sql(n)}) AS "numeric",
{r(f"count({number_sql(n)}) * 1.0 / count(*)")} AS numeric_share, {str(n in _HINTED).lower()} AS hinted,
count({number_sql(n)}) * 1.0 / count(*) > 0.2 OR ({str(n in _HINTED).lower()} AND count({number_sql(n)}) > 0) AS converted
FROM ({TEXT_SQL}) x""" for n in TEXT_COLUMNS]))
def coercion_report(spark, folder):
    return rounded(schema.coercion_report(as_text(spark, folder)))


@query(f"""
SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, {number_sql("c_balance")} AS c_balance,
  {number_sql("c_units")} AS c_units, {number_sql("c_age")} AS c_age, c_name FROM ({TEXT_SQL}) x
""")
def coerce_numeric_like(spark, folder):
    return schema.coerce_numeric_like(as_text(spark, folder))[0].select(
        "c_custkey", "c_balance", "c_units", "c_age", "c_name")


@query("""SELECT c_custkey AS customer_key, c_name AS full_name, c_name AS full_name_2, c_acctbal AS col_3,
  c_mktsegment AS market_segment, c_nationkey AS with_dashes FROM customer""")
def standard_names(spark, folder):
    raw = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("Customer Key"), F.col("c_name").alias("  Full Name "),
        F.col("c_name").alias("FULL-NAME"), F.col("c_acctbal").alias("%%%"),
        F.col("c_mktsegment").alias("market/segment"), F.col("c_nationkey").alias("With-Dashes"))
    return schema.standardise_columns(raw)[0]


@query(union([f"""SELECT '{n}' AS "column", count(*) FILTER (WHERE trim({n}) <> '') AS filled,
count({leading_sql(n)}) AS "numeric", count({leading_sql(n)}) > count(*) FILTER (WHERE trim({n}) <> '') * 0.8 AS is_numeric
FROM ({TEXT_SQL}) x""" for n in TEXT_COLUMNS]))
def lenient_numeric(spark, folder):
    return schema.lenient_report(as_text(spark, folder))


@query(f"""
SELECT c_custkey, nullif(trim(c_name), '') AS c_name, {number_sql("c_balance")} AS c_balance,
  {leading_sql("c_units")} AS c_units,
  CASE lower(c_active) WHEN 'true' THEN 1 WHEN 'false' THEN 0 ELSE -1 END AS c_active,
  strftime(coalesce({", ".join(f"try_strptime(c_mixed, '{f}')" for f in SQL_FORMATS.values())}), '%Y-%m-%d') AS c_mixed,
  regexp_replace(lower(c_mktsegment || ' #1-A'), '[^a-z0-9]+', '', 'g') AS segment_token
FROM ({TEXT_SQL}) x
""")
def cell_functions(spark, folder):
    return as_text(spark, folder).select(
        "c_custkey", S.blank_to_null(F.col("c_name")).alias("c_name"),
        S.to_number(F.col("c_balance")).alias("c_balance"),
        S.leading_number(F.col("c_units")).alias("c_units"),
        F.coalesce(S.to_boolean(F.col("c_active")).cast("int"), F.lit(-1)).alias("c_active"),
        F.date_format(S.parse_timestamp(F.col("c_mixed")), "yyyy-MM-dd").alias("c_mixed"),
        S.token(F.concat("c_mktsegment", F.lit(" #1-A"))).alias("segment_token"))


_ZERO_WIDTH = "‮‭​‌‍"
_DAMAGED_TEXT = "text || chr(13) || chr(10) || chr(7) || 'x' || chr(8203) || chr(9) || 'y'"


@query(f"""
SELECT doc_id, md5(regexp_replace(regexp_replace(replace(t, chr(13) || chr(10), chr(10)),
  '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '[{_ZERO_WIDTH}]', '', 'g')) AS digest
FROM (SELECT doc_id, {_DAMAGED_TEXT} AS t FROM documents) d
""")
def strip_controls(spark, folder):
    dirty = F.concat("text", F.lit("\r\n\x07x​\ty"))
    return table(spark, folder, "documents").select("doc_id", F.md5(S.strip_controls(dirty)).alias("digest"))


@query("""
SELECT page_id, CASE WHEN s = '' THEN 'run' ELSE s END AS slug FROM (
  SELECT page_id, substr(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60) AS s
  FROM pages) x
""")
def slugs(spark, folder):
    return table(spark, folder, "pages").select("page_id", S.slug(F.col("url"), 60).alias("slug"))


@query("""
SELECT doc_id, md5(CASE WHEN substr(t, 1, 1) IN ('#', '-', '*', '>') THEN ' ' || t ELSE t END) AS cell,
  md5(trim(replace(replace(replace(replace(replace(u, '\\', '/'), '|', '•'), '[', '('), ']', ')'), '''', ''))) AS detail
FROM (SELECT doc_id, replace(CASE WHEN doc_id % 3 = 0 THEN '#' ELSE '' END || text || '|', '|', '•') AS t,
             text || 'a\\b|[c]''d' AS u FROM documents) d
""")
def markdown_text(spark, folder):
    cell = F.concat(F.when(F.col("doc_id") % 3 == 0, "#").otherwise(""), "text", F.lit("|"))
    return table(spark, folder, "documents").select(
        "doc_id", F.md5(S.table_cell(cell)).alias("cell"),
        F.md5(S.detail_text(F.concat("text", F.lit("a\\b|[c]'d")))).alias("detail"))


@query("""
SELECT o_orderkey, printf('%+.2f', o_totalprice - 250000) AS signed_price,
  format('{:,.2f}', o_totalprice) AS grouped_price,
  round(date_diff('second', o_orderdate, TIMESTAMP '2002-01-01 00:00:00') / 3600.0, 6) AS hours_old
FROM orders
""")
def number_text(spark, folder):
    df = table(spark, folder, "orders")
    return df.select(
        "o_orderkey", S.signed_text(F.col("o_totalprice") - 250000, 2).alias("signed_price"),
        S.grouped_text(F.col("o_totalprice")).alias("grouped_price"),
        F.round(S.hours_between(F.col("o_orderdate"), F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")), 6)
        .alias("hours_old"))


# -- filters -----------------------------------------------------------------

_MESSY_OUT = """o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice, CAST(o_rank AS DOUBLE) AS o_rank,
o_orderstatus, o_orderpriority, o_flag"""


@query(f"""SELECT {_MESSY_OUT} FROM ({MESSY_SQL}) m WHERE o_custkey IS NOT NULL OR o_totalprice IS NOT NULL
OR o_rank IS NOT NULL OR o_orderstatus IS NOT NULL OR o_orderpriority IS NOT NULL OR o_flag IS NOT NULL""")
def drop_empty_rows_and_columns(spark, folder):
    rows = K.drop_empty_rows(messy(spark, folder), "o_orderkey")
    return as_doubles(K.drop_empty_columns(rows), "o_custkey", "o_rank")


def _inside(names: list[str], bounds: str = "f") -> str:
    return " AND ".join(
        f"({n} IS NULL OR ({n} >= (SELECT low FROM {bounds} WHERE \"column\" = '{n}') "
        f"AND {n} <= (SELECT high FROM {bounds} WHERE \"column\" = '{n}')))" for n in names)


@query(f"""
WITH g AS ({GAPPY_SQL}), f AS ({fences("g", ["o_totalprice", "o_rank"])})
SELECT o_orderkey, o_totalprice, CAST(o_rank AS DOUBLE) AS o_rank FROM g WHERE {_inside(["o_totalprice", "o_rank"])}
""")
def iqr_filter(spark, folder):
    kept = K.filter_outliers(gappy(spark, folder), ["o_totalprice", "o_rank"])
    return as_doubles(kept.select("o_orderkey", "o_totalprice", "o_rank"), "o_rank")


@query(f"""
WITH g AS ({GAPPY_SQL}), f AS ({fences("g", ["o_totalprice"])}),
a AS (SELECT g.* FROM g, f WHERE o_totalprice BETWEEN low AND high),
h AS ({fences("a", ["o_rank"])})
SELECT o_orderkey, o_totalprice, o_rank FROM a, h WHERE o_rank BETWEEN low AND high
""")
def iqr_filter_in_turn(spark, folder):
    kept = K.filter_outliers_in_turn(gappy(spark, folder), ["o_totalprice", "o_rank"])
    return kept.select("o_orderkey", "o_totalprice", "o_rank")


@query(f"""
WITH g AS ({GAPPY_SQL}), s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM g)
SELECT o_orderkey, o_totalprice FROM g, s WHERE o_totalprice IS NULL OR abs(o_totalprice - m) <= 3 * d
""")
def zscore_filter(spark, folder):
    df = gappy(spark, folder)
    return K.keep_inside(df, K.zscore_limits(df, ["o_totalprice"])).select("o_orderkey", "o_totalprice")


@query(f"""SELECT c_balance AS x, c_units AS y FROM (SELECT {number_sql("c_balance")} AS c_balance,
{number_sql("c_units")} AS c_units FROM ({TEXT_SQL}) t) q WHERE c_balance IS NOT NULL AND c_units IS NOT NULL""")
def number_pairs(spark, folder):
    return explore.number_pairs(as_text(spark, folder), "c_balance", "c_units").toDF("x", "y")


# -- filling -----------------------------------------------------------------

def _filled(n: str, value: str) -> str:
    return f"{r(f'coalesce({n}, {value})')} AS {n}"


@query(f"""WITH g AS ({GAPPY_SQL}) SELECT o_orderkey,
{", ".join(_filled(n, f"(SELECT avg({n}) FROM g)") for n in ORDER_NUMBERS)} FROM g""")
def impute_mean(spark, folder):
    return _imputed(spark, folder, "mean")


@query(f"""WITH g AS ({GAPPY_SQL}) SELECT o_orderkey,
{", ".join(_filled(n, f"(SELECT quantile_cont(CAST({n} AS DOUBLE), 0.5) FROM g)") for n in ORDER_NUMBERS)} FROM g""")
def impute_median(spark, folder):
    return _imputed(spark, folder, "median")


def _imputed(spark, folder, strategy: str):
    df = gappy(spark, folder).select("o_orderkey", *ORDER_NUMBERS)
    rules = K.CleaningProfile(fill_missing_strategy=strategy, drop_duplicates=False, drop_empty_rows=False)
    cleaned, _ = K.clean(df, rules, "o_orderkey")
    return rounded(cleaned)


@query(f"""
SELECT o_orderkey, {", ".join(f"CAST(last_value({n} IGNORE NULLS) OVER w AS {t}) AS {n}" for n, t in
  [("o_custkey", "DOUBLE"), ("o_totalprice", "DOUBLE"), ("o_rank", "DOUBLE"), ("o_orderpriority", "VARCHAR"), ("o_flag", "VARCHAR")])}
FROM ({GAPPY_SQL}) g WINDOW w AS (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def impute_forward(spark, folder):
    df = gappy(spark, folder).drop("o_orderstatus")
    rules = K.CleaningProfile(fill_missing_strategy="ffill", drop_duplicates=False, drop_empty_rows=False)
    cleaned, _ = K.clean(df, rules, "o_orderkey")
    return as_doubles(cleaned, "o_custkey", "o_rank")


def _strategy(n: str) -> str:
    return f"CASE WHEN count({n}) >= 8 AND abs(skewness({n})) < 0.5 THEN 'mean' ELSE 'median' END"


def _smart_row(n: str, source: str) -> str:
    return f"""SELECT '{n}' AS "column", {_strategy(n)} AS strategy,
  round(CASE WHEN {_strategy(n)} = 'mean' THEN avg({n}) ELSE quantile_cont(CAST({n} AS DOUBLE), 0.5) END, 4) AS fill_number,
  CAST(NULL AS VARCHAR) AS fill_text, count(*) - count({n}) AS filled FROM {source}"""


_STAGED = f"""SELECT min(o_orderkey) AS o_orderkey, o_custkey, o_totalprice, o_rank, o_orderstatus, o_orderpriority, o_flag
FROM ({MESSY_SQL}) m WHERE o_orderstatus IS NOT NULL GROUP BY o_custkey, o_totalprice, o_rank, o_orderstatus, o_orderpriority, o_flag"""
_TEXT_GAPS = ["o_orderpriority", "o_flag"]


@query(f"""
WITH s AS ({_STAGED}), m AS ({mode_sql("s", _TEXT_GAPS, "VARCHAR")})
{union([_smart_row(n, "s") for n in ORDER_NUMBERS])}
UNION ALL {union([f"SELECT '{n}', 'mode', CAST(NULL AS DOUBLE), (SELECT mode FROM m WHERE \"column\" = '{n}'), count(*) - count({n}) FROM s" for n in _TEXT_GAPS])}
""")
def impute_smart_log(spark, folder):
    df = messy(spark, folder)
    return K.imputation_log(df, K.fit(df, row_id="o_orderkey"))


def _smart_value(n: str) -> str:
    return f"(SELECT CASE WHEN {_strategy(n)} = 'mean' THEN avg({n}) ELSE quantile_cont(CAST({n} AS DOUBLE), 0.5) END FROM s)"


_CLEAN_SQL = f"""
SELECT o_orderkey, {", ".join(f"coalesce({n}, {_smart_value(n)}) AS {n}" for n in ORDER_NUMBERS)}, o_orderstatus,
  {", ".join(f"coalesce({n}, (SELECT mode FROM m WHERE \"column\" = '{n}')) AS {n}" for n in _TEXT_GAPS)} FROM s"""


@query(f"""
WITH s AS ({_STAGED}), m AS ({mode_sql("s", _TEXT_GAPS, "VARCHAR")})
SELECT o_orderkey, {", ".join(f"{r(n)} AS {n}" for n in ORDER_NUMBERS)}, o_orderstatus, o_orderpriority, o_flag FROM ({_CLEAN_SQL}) c
""")
def clean_smart(spark, folder):
    cleaned, _ = K.clean(messy(spark, folder), row_id="o_orderkey")
    return rounded(as_doubles(cleaned, *ORDER_NUMBERS))


@query(f"""
WITH s AS ({_STAGED}), m AS ({mode_sql("s", _TEXT_GAPS, "VARCHAR")}), c AS ({_CLEAN_SQL}), f AS ({fences("c", ORDER_NUMBERS)})
SELECT (SELECT count(*) FROM ({MESSY_SQL}) x) AS rows_input, CAST(8 AS BIGINT) AS columns_input,
  (SELECT count(*) FROM ({MESSY_SQL}) x WHERE o_orderstatus IS NOT NULL) - (SELECT count(*) FROM s) AS duplicates_removed,
  (SELECT count(*) FROM ({MESSY_SQL}) x WHERE o_orderstatus IS NULL) AS empty_rows_removed,
  CAST(1 AS BIGINT) AS empty_columns_removed, CAST(0 AS BIGINT) AS columns_standardized,
  (SELECT {" + ".join(f"count(*) - count({n})" for n in ORDER_NUMBERS + _TEXT_GAPS)} FROM s) AS missing_values_filled,
  (SELECT count(*) FROM s) - count(*) AS outliers_removed, count(*) AS rows_output, CAST(7 AS BIGINT) AS columns_output
FROM c WHERE {_inside(ORDER_NUMBERS)}
""")
def clean_metrics(spark, folder):
    cleaned, plan = K.clean(messy(spark, folder), K.CleaningProfile(handle_outliers=True), "o_orderkey")
    return K.clean_metrics(cleaned, plan)


_ALL_DATA = ["o_custkey", "o_totalprice", "o_rank", "o_orderstatus", "o_orderpriority", "o_flag"]


def _health(source: str, names: list[str]) -> str:
    listed = ", ".join(names)
    return f"""SELECT count(*) AS rows, CAST({len(names)} AS BIGINT) AS cols,
  {" + ".join(f"count(*) - count({n})" for n in names)} AS missing,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT {listed} FROM {source}) d) AS copies FROM {source}"""


@query(f"""
WITH x AS ({MESSY_SQL}), s AS ({_STAGED}), m AS ({mode_sql("s", _TEXT_GAPS, "VARCHAR")}), c AS ({_CLEAN_SQL}),
a AS ({_health("x", _ALL_DATA + ["o_empty"])}), b AS ({_health("c", _ALL_DATA)})
SELECT 'rows' AS metric, a.rows AS before, b.rows AS after, a.rows - b.rows AS change,
  CAST(NULL AS DOUBLE) AS before_pct, CAST(NULL AS DOUBLE) AS after_pct FROM a, b
UNION ALL SELECT 'columns', a.cols, b.cols, a.cols - b.cols, NULL, NULL FROM a, b
UNION ALL SELECT 'missing_values', a.missing, b.missing, a.missing - b.missing,
  {r("a.missing * 100.0 / (a.rows * a.cols)")}, {r("b.missing * 100.0 / (b.rows * b.cols)")} FROM a, b
UNION ALL SELECT 'duplicate_rows', a.copies, b.copies, a.copies - b.copies,
  {r("a.copies * 100.0 / a.rows")}, {r("b.copies * 100.0 / b.rows")} FROM a, b
""")
def before_after(spark, folder):
    raw = messy(spark, folder)
    cleaned, _ = K.clean(raw, row_id="o_orderkey")
    return rounded(K.before_after(raw, cleaned, "o_orderkey"))


@query(f"""SELECT min(o_orderkey) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice, CAST(o_rank AS DOUBLE) AS o_rank,
o_orderstatus, o_orderpriority, o_flag, o_empty FROM ({MESSY_SQL}) m WHERE o_orderstatus IS NOT NULL
GROUP BY o_custkey, o_totalprice, o_rank, o_orderstatus, o_orderpriority, o_flag, o_empty""")
def clean_minimal(spark, folder):
    cleaned, _ = K.clean(messy(spark, folder), K.MINIMAL, "o_orderkey")
    return as_doubles(cleaned, "o_custkey", "o_rank")


@query(f"""SELECT {_MESSY_OUT} FROM ({GAPPY_SQL}) g WHERE {" AND ".join(f"{n} IS NOT NULL" for n in _ALL_DATA)}""")
def clean_dropping_gaps(spark, folder):
    cleaned, _ = K.clean(gappy(spark, folder), K.CleaningProfile(fill_missing_strategy="drop"), "o_orderkey")
    return as_doubles(cleaned, "o_custkey", "o_rank")


@query(f"""
SELECT c_custkey, c_name, CAST(CASE WHEN c_balance IS NULL THEN (SELECT CASE WHEN count(v) >= 8 AND abs(skewness(v)) < 0.5 THEN round(avg(v), 6) ELSE quantile_cont(v, 0.5) END
    FROM (SELECT {number_sql("c_balance")} AS v FROM ({TEXT_SQL}) y) z) ELSE c_balance END AS DOUBLE) + 0.0 AS c_balance, c_mktsegment
FROM (SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, coalesce(c_name, (SELECT c_name FROM ({TEXT_SQL}) u WHERE c_name IS NOT NULL GROUP BY c_name ORDER BY count(*) DESC, c_name LIMIT 1)) AS c_name,
  {number_sql("c_balance")} AS c_balance, c_mktsegment FROM ({TEXT_SQL}) x) q
""")
def clean_text_table(spark, folder):
    df = as_text(spark, folder).select("c_custkey", "c_name", "c_balance", "c_mktsegment")
    cleaned, _ = K.clean(df)
    return rounded(cleaned)


SAMPLE_ROWS = 1_500
_DRAWN = f"SELECT * FROM ({MESSY_SQL}) d ORDER BY {draw(42, 'd.o_orderkey % 1000003 + 1000003')}, d.o_orderkey LIMIT {SAMPLE_ROWS}"


def _from_sample(n: str) -> str:
    value = _smart_value(n) if n in ORDER_NUMBERS else f"(SELECT mode FROM m WHERE \"column\" = '{n}')"
    return f"{r(f'coalesce({n}, {value})')} AS {n}" if n in ORDER_NUMBERS else f"coalesce({n}, {value}) AS {n}"


@query(f"""
WITH s AS ({_STAGED.replace(f"({MESSY_SQL})", f"({_DRAWN})")}), m AS ({mode_sql("s", _TEXT_GAPS, "VARCHAR")}), t AS ({_STAGED})
SELECT o_orderkey, {", ".join(_from_sample(n) for n in ORDER_NUMBERS)}, o_orderstatus,
  {", ".join(_from_sample(n) for n in _TEXT_GAPS)}, 'Unknown' AS o_empty FROM t
""")
def clean_fitted_on_sample(spark, folder):
    """Fill values from a drawn sample, applied to every row."""
    cleaned, _ = K.clean(messy(spark, folder), row_id="o_orderkey", sample_rows=SAMPLE_ROWS)
    return rounded(as_doubles(cleaned, *ORDER_NUMBERS))


@query("SELECT o_orderkey, o_orderstatus, 'Unknown' AS o_note FROM orders")
def fill_unknown(spark, folder):
    """A text column without any value is kept and filled with the fallback."""
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", F.lit(None).cast("string").alias("o_note"))
    cleaned, _ = K.clean(df, K.CleaningProfile(drop_empty_cols=False, drop_duplicates=False), "o_orderkey")
    return cleaned
