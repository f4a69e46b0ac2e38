"""Column profiles, outliers, relations, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.tables import (
    GAPPY_SQL, MESSY_SQL, TEXT_SQL, as_doubles, as_text, cells, fences, from_sql, gappy, messy, r, rounded,
    table, union,
)
from dqspark.operators import dedup, profile, relations, schema

LINE_NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_TEXTS = ["l_returnflag", "l_linestatus", "l_shipdate"]
ORDER_NUMBERS = ["o_custkey", "o_totalprice", "o_rank"]
ORDER_TEXTS = ["o_orderstatus", "o_orderpriority", "o_flag"]


def stats_sql(source: str, types: dict[str, str], numbers: list[str]) -> str:
    parts = []
    for n, t in types.items():
        rows = f"count(*) AS rows, count({n}) AS known"
        if n in numbers:
            parts.append(f"""
SELECT '{n}' AS "column", '{t}' AS dtype, {r(f"avg({n})")} AS mean, {r(f"quantile_cont(CAST({n} AS DOUBLE), 0.5)")} AS median,
  {r(f"stddev_samp({n})")} AS std, {r(f"min({n})")} AS min, {r(f"max({n})")} AS max,
  {r(f"quantile_cont(CAST({n} AS DOUBLE), 0.25)")} AS q1, {r(f"quantile_cont(CAST({n} AS DOUBLE), 0.75)")} AS q3,
  count(*) - count({n}) AS missing_count, {r(f"(count(*) - count({n})) * 100.0 / count(*)")} AS missing_pct,
  count(*) FILTER (WHERE {n} < low OR {n} > high) AS outlier_count
FROM {source}, (SELECT low, high FROM ({fences(source, [n])}) f) f""")
        else:
            parts.append(f"""
SELECT '{n}' AS "column", '{t}' AS dtype, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS median,
  CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max,
  CAST(NULL AS DOUBLE) AS q1, CAST(NULL AS DOUBLE) AS q3,
  count(*) - count({n}) AS missing_count, {r(f"(count(*) - count({n})) * 100.0 / count(*)")} AS missing_pct,
  CAST(0 AS BIGINT) AS outlier_count FROM {source}""")
    return union(parts)


_LINE_TYPES = {"l_linenumber": "integer", "l_quantity": "float", "l_extendedprice": "float",
               "l_discount": "float", "l_tax": "float", "l_returnflag": "categorical",
               "l_linestatus": "categorical", "l_shipdate": "datetime"}
_ORDER_TYPES = {"o_custkey": "integer", "o_totalprice": "float", "o_rank": "integer",
                "o_orderstatus": "categorical", "o_orderpriority": "categorical",
                "o_flag": "categorical"}


@query(stats_sql("lineitem", _LINE_TYPES, LINE_NUMBERS))
def column_stats(spark, folder):
    df = table(spark, folder, "lineitem").select(*_LINE_TYPES)
    return profile.column_stats(df, pct_digits=6).drop("trend")


def ranks_sql(source: str, names: list[str], key: str) -> str:
    return f"""
SELECT "column", {key}, value,
  rank() OVER (PARTITION BY "column" ORDER BY value)
    + (count(*) OVER (PARTITION BY "column", value) - 1) / 2.0 AS rk,
  row_number() OVER (PARTITION BY "column" ORDER BY {key}) - 1 AS pos,
  count(*) OVER (PARTITION BY "column") AS n
FROM ({cells(source, names, key)}) c"""


def trend_sql(source: str, names: list[str], key: str) -> str:
    return f"""
SELECT "column", n, {r("rho")} AS rho,
  CASE WHEN rho > 0.3 THEN 'increasing' WHEN rho < -0.3 THEN 'decreasing' ELSE 'flat' END AS trend
FROM (SELECT "column", count(*) AS n, corr(pos, rk) AS rho
      FROM ({ranks_sql(source, names, key)}) k GROUP BY "column") t"""


@query(f"""
WITH g AS ({GAPPY_SQL}), s AS ({stats_sql("g", _ORDER_TYPES, ORDER_NUMBERS)}),
t AS ({trend_sql("g", ORDER_NUMBERS, "o_orderkey")})
SELECT s.*, t.trend FROM s LEFT JOIN t ON s."column" = t."column"
""")
def column_stats_with_trend(spark, folder):
    return profile.column_stats(gappy(spark, folder), row_id="o_orderkey", pct_digits=6)


@query(union([f"""SELECT '{n}' AS "column", count(*) - count({n}) AS missing_count,
{r(f"(count(*) - count({n})) * 100.0 / count(*)")} AS missing_pct FROM ({GAPPY_SQL}) g""" for n in _ORDER_TYPES]))
def missing_report(spark, folder):
    return profile.missing_report(gappy(spark, folder), list(_ORDER_TYPES), pct_digits=6)


def mode_sql(source: str, names: list[str], kind: str = "DOUBLE") -> str:
    return f"""
SELECT "column", value AS mode FROM (
  SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value) AS k
  FROM ({cells(source, names, kind=kind)}) c GROUP BY "column", value) m WHERE k = 1"""


@query(f"""
WITH g AS ({GAPPY_SQL}), c AS ({cells("g", ORDER_NUMBERS)}), m AS ({mode_sql("g", ORDER_NUMBERS)})
SELECT c."column", {r("stddev_samp(value)", 4)} AS standard_deviation, {r("max(value)")} AS max, {r("min(value)")} AS min,
  {r("var_samp(value)", 0)} AS variance, {r("max(value) - min(value)")} AS range,
  {r("quantile_cont(value, 0.5)")} AS median, {r("any_value(m.mode)")} AS mode
FROM c JOIN m ON c."column" = m."column" GROUP BY c."column"
""")
def descriptive_stats(spark, folder):
    df = gappy(spark, folder).select(*ORDER_NUMBERS)
    return rounded(profile.descriptive_stats(df), standard_deviation=4, variance=0)


# Fixed value: a number at the start of a text.
LEADING = r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
_VIEW_NAMES = ["c_balance", "c_units", "c_age", "c_mktsegment"]


def leading_sql(n: str) -> str:
    return f"TRY_CAST(regexp_extract({n}, '{LEADING}', 1) AS DOUBLE)"


def _population(n: str) -> str:
    v = f"(SELECT {leading_sql(n)} AS v, {n} AS t FROM ({TEXT_SQL}) x)"
    ok = "count(v) > count(*) FILTER (WHERE trim(t) <> '') * 0.8"
    mode = (f"(SELECT v FROM {v} y WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)")

    def when(e: str, d: int = 6) -> str:
        return f"CASE WHEN {ok} THEN {r(e, d)} END"

    return f"""SELECT '{n}' AS "column", {ok} AS is_numeric, {when("avg(v)")} AS mean,
  {when("quantile_cont(v, 0.5)")} AS median, {when(mode)} AS mode, {when("max(v) - min(v)")} AS range,
  {when("var_pop(v)", 0)} AS variance, {when("stddev_pop(v)", 4)} AS std, {when("min(v)")} AS min,
  {when("max(v)")} AS max, CASE WHEN {ok} THEN count(v) ELSE 0 END AS count FROM {v} z"""


@query(union([_population(n) for n in _VIEW_NAMES]))
def population_stats(spark, folder):
    return rounded(profile.population_stats(as_text(spark, folder), _VIEW_NAMES), variance=0, std=4)


@query(f"""
SELECT "column", {r("g1")} AS skew_population, {r("h1")} AS kurtosis_population,
  {r("coalesce(g, 0)")} AS skew, {r("coalesce(h, 0)")} AS kurtosis,
  {r("(mean - median) / sd")} AS quick_skew, abs((mean - median) / sd) > 0.5 AS looks_skewed,
  {r("least(abs(sd / mean), 100)")} AS variation
FROM (SELECT "column", skewness(value) AS g, kurtosis(value) AS h, avg(value) AS mean,
    quantile_cont(value, 0.5) AS median, stddev_samp(value) AS sd,
    skewness(value) * (count(*) - 2) / sqrt(CAST(count(*) AS DOUBLE) * (count(*) - 1)) AS g1,
    (kurtosis(value) * (CAST(count(*) AS DOUBLE) - 2) * (count(*) - 3) / (count(*) - 1) - 6) / (count(*) + 1) AS h1
  FROM ({cells("lineitem", LINE_NUMBERS)}) c GROUP BY "column") s
""")
def skew_kurtosis(spark, folder):
    return rounded(profile.shape_stats(table(spark, folder, "lineitem"), LINE_NUMBERS))


@query(union([f"""SELECT '{n}' AS "column", count(DISTINCT {n}) AS distinct_count,
count(DISTINCT {n}) <= 1 AS is_constant FROM ({GAPPY_SQL}) g""" for n in _ORDER_TYPES]))
def distinct_constants(spark, folder):
    return profile.distinct_counts(gappy(spark, folder), list(_ORDER_TYPES))


def counts_sql(source: str, names: list[str]) -> str:
    return union([f"SELECT '{n}' AS \"column\", CAST({n} AS VARCHAR) AS value, count(*) AS n FROM {source} GROUP BY {n}"
                  for n in names])


@query(f"""
WITH g AS ({GAPPY_SQL}), c AS ({counts_sql("g", ORDER_TEXTS + ["o_custkey"])})
SELECT "column", CAST(rank AS INTEGER) AS rank, value, n AS count, {r("n * 100.0 / total")} AS pct FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC NULLS LAST) AS rank,
    sum(n) OVER (PARTITION BY "column") AS total FROM c) x WHERE rank <= 10
""")
def top_values(spark, folder):
    return profile.top_values(gappy(spark, folder), ORDER_TEXTS + ["o_custkey"], pct_digits=6)


@query(f"""
WITH g AS ({GAPPY_SQL}), d AS (SELECT lang, source, text FROM documents),
c AS ({counts_sql("g", ORDER_TEXTS)} UNION ALL {counts_sql("d", ["lang", "source", "text"])})
SELECT "column", count(value) AS unique_count,
  {r("CASE WHEN count(*) >= 2 THEN max(n) * 1.0 / greatest(min(n), 1) ELSE 0 END")} AS class_imbalance_ratio,
  {r("sum(length(value) * n) * 1.0 / sum(CASE WHEN value IS NOT NULL THEN n END)", 5)} AS avg_text_length,
  CAST(min(length(value)) AS INTEGER) AS min_text_length, CAST(max(length(value)) AS INTEGER) AS max_text_length,
  {r("count(value) * 1.0 / sum(n)")} AS cardinality_ratio
FROM c GROUP BY "column"
""")
def categorical_insights(spark, folder):
    orders = profile.categorical_insights(gappy(spark, folder), ORDER_TEXTS, pct_digits=6, ratio_digits=6)
    texts = profile.categorical_insights(
        table(spark, folder, "documents"), ["lang", "source", "text"], pct_digits=6, ratio_digits=6)
    return orders.unionByName(texts).drop("top_values")


@query(f"""
WITH g AS ({GAPPY_SQL}), f AS ({fences("g", ["o_custkey", "o_totalprice", "o_rank"])}),
c AS ({cells("g", ORDER_NUMBERS, "o_orderkey")}),
o AS (SELECT c.*, row_number() OVER (PARTITION BY c."column" ORDER BY o_orderkey) AS k, low, high
      FROM c JOIN f ON c."column" = f."column" WHERE value < low OR value > high)
SELECT "column", {r("any_value(low)")} AS lower_fence, {r("any_value(high)")} AS upper_fence,
  count(*) AS outlier_count,
  string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (WHERE k <= 100) AS row_ids
FROM o GROUP BY "column"
""")
def iqr_anomalies(spark, folder):
    found = profile.anomalies(gappy(spark, folder), ORDER_NUMBERS, "o_orderkey")
    return found.select(
        "column", "lower_fence", "upper_fence", "outlier_count",
        F.array_join(F.transform("row_indices", lambda v: v.cast("string")), ",").alias("row_ids"))


@query(f"""
WITH g AS ({GAPPY_SQL}), f AS ({fences("g", ["o_totalprice", "o_rank"])}),
p AS (SELECT low, high FROM f WHERE "column" = 'o_totalprice'), k AS (SELECT low, high FROM f WHERE "column" = 'o_rank')
SELECT o_orderkey, coalesce(o_totalprice < p.low OR o_totalprice > p.high, false)
  OR coalesce(o_rank < k.low OR o_rank > k.high, false) AS is_outlier FROM g, p, k
""")
def outlier_rows(spark, folder):
    flagged = profile.flag_outliers(gappy(spark, folder), ["o_totalprice", "o_rank"])
    return flagged.select("o_orderkey", F.col("_is_outlier").alias("is_outlier"))


@query(f"""
WITH c AS ({cells("lineitem", LINE_NUMBERS)}), m AS (SELECT "column", avg(value) AS a, stddev_pop(value) AS s FROM c GROUP BY "column")
SELECT c."column", count(*) AS known, count(*) FILTER (WHERE abs(value - a) > 3 * s) AS outlier_count,
  {r("count(*) FILTER (WHERE abs(value - a) > 3 * s) * 1.0 / count(*)")} AS outlier_ratio
FROM c JOIN m ON c."column" = m."column" GROUP BY c."column"
""")
def three_sigma(spark, folder):
    return rounded(profile.three_sigma(table(spark, folder, "lineitem"), LINE_NUMBERS))


@query(f"""
SELECT p_brand AS category, count(*) AS rows, {r("avg(p_retailprice)")} AS mean,
  {r("stddev_samp(p_retailprice)")} AS std, count(p_retailprice) AS count
FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 10
""")
def group_summary(spark, folder):
    return rounded(profile.group_summary(table(spark, folder, "part"), "p_brand", "p_retailprice"))


@query(f"""
SELECT o_custkey AS category, {r("avg(o_totalprice)")} AS mean FROM ({GAPPY_SQL}) g
WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY o_custkey
ORDER BY avg(o_totalprice) DESC, o_custkey LIMIT 20
""")
def mean_by_category(spark, folder):
    return rounded(profile.mean_by_category(gappy(spark, folder), "o_custkey", "o_totalprice"))


@query(f"""
SELECT feature, {r("avg(CASE WHEN quality = 1 THEN v END)")} AS good_mean,
  {r("avg(CASE WHEN quality = 0 THEN v END)")} AS bad_mean,
  {r("abs(avg(CASE WHEN quality = 1 THEN v END) - avg(CASE WHEN quality = 0 THEN v END))")} AS separation
FROM (SELECT 'n_chars' AS feature, quality, CAST(n_chars AS DOUBLE) AS v FROM labels JOIN documents ON labels.doc_id = documents.doc_id
  UNION ALL SELECT 'toxic', quality, CAST(toxic AS DOUBLE) FROM labels JOIN documents ON labels.doc_id = documents.doc_id) x
GROUP BY feature
""")
def class_means(spark, folder):
    both = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    return rounded(profile.class_means(both, "quality", ["n_chars", "toxic"]))


# -- relations ---------------------------------------------------------------

def pairs_sql(source: str, names: list[str]) -> str:
    return union([
        f"SELECT {i} AS i, {j} AS j, '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM {source}"
        for i, a in enumerate(names) for j, b in enumerate(names) if i < j])


@query(f"""
SELECT col_a, col_b, {r("r")} AS pearson_r,
  CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
  CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction
FROM ({pairs_sql("lineitem", LINE_NUMBERS)}) p WHERE r IS NOT NULL ORDER BY abs(r) DESC LIMIT 50
""")
def pearson_pairs(spark, folder):
    return relations.pearson_pairs(table(spark, folder, "lineitem"), LINE_NUMBERS)


@query(f"""
SELECT col_a, col_b, {r("r")} AS pearson_r,
  CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
  CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction
FROM ({pairs_sql(f"({GAPPY_SQL}) g", ["o_orderkey"] + ORDER_NUMBERS)}) p WHERE r IS NOT NULL
""")
def pearson_pairs_with_gaps(spark, folder):
    return relations.pearson_pairs(gappy(spark, folder), ["o_orderkey"] + ORDER_NUMBERS)


@query(f"SELECT col_b AS \"row\", col_a AS \"column\", {r('r')} AS r FROM ({pairs_sql('lineitem', LINE_NUMBERS)}) p")
def heatmap(spark, folder):
    return rounded(relations.heatmap(table(spark, folder, "lineitem"), LINE_NUMBERS))


_EVENTS_TREND = """SELECT event_id, value, CAST(event_id % 9 AS DOUBLE) AS wave,
  CASE WHEN event_id % 2 = 0 THEN 1000.0 ELSE CAST(event_id / 10 AS DOUBLE) END AS climb,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(-event_id AS DOUBLE) END AS fall FROM events"""
_TREND_NAMES = ["value", "wave", "climb", "fall"]


@query(trend_sql(f"({_EVENTS_TREND.replace('event_id / 10', 'event_id / 10.0')}) e", _TREND_NAMES, "event_id"))
def spearman_trend(spark, folder):
    df = from_sql(spark, folder, _EVENTS_TREND.replace("event_id / 10", "event_id / 10.0"), "events")
    return rounded(relations.trends(df, _TREND_NAMES, "event_id"))


@query(f"""
SELECT "column", count(*) AS n, {r("avg(value) FILTER (WHERE pos < n // 2)")} AS first_mean,
  {r("avg(value) FILTER (WHERE pos >= n // 2)")} AS second_mean,
  CASE WHEN abs(avg(value) FILTER (WHERE pos >= n // 2) - avg(value) FILTER (WHERE pos < n // 2))
      < 0.05 * (abs(avg(value) FILTER (WHERE pos < n // 2)) + 1e-9) THEN 'flat'
    WHEN avg(value) FILTER (WHERE pos >= n // 2) > avg(value) FILTER (WHERE pos < n // 2) THEN 'increasing'
    ELSE 'decreasing' END AS trend
FROM ({ranks_sql(f"({_EVENTS_TREND.replace('event_id / 10', 'event_id / 10.0')}) e", _TREND_NAMES, "event_id")}) k GROUP BY "column"
""")
def half_trend(spark, folder):
    df = from_sql(spark, folder, _EVENTS_TREND.replace("event_id / 10", "event_id / 10.0"), "events")
    return rounded(relations.half_trends(df, _TREND_NAMES, "event_id"))


@query(f"""
SELECT count(*) AS n, {r("regr_slope(l_extendedprice, l_quantity)")} AS slope,
  {r("regr_intercept(l_extendedprice, l_quantity)")} AS intercept,
  {r("min(l_quantity)")} AS x_min, {r("max(l_quantity)")} AS x_max FROM lineitem
""")
def line_fit(spark, folder):
    return rounded(relations.line_fit(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice"))


@query(f"""
WITH now AS ({pairs_sql("lineitem", LINE_NUMBERS)}), old AS ({pairs_sql("(SELECT * REPLACE (-l_tax AS l_tax) FROM lineitem) l", LINE_NUMBERS)})
SELECT now.col_a, now.col_b, {r("old.r")} AS reported_r, {r("now.r")} AS actual_r,
  (round(old.r, 6) >= 0) = (round(now.r, 6) >= 0) AS agrees
FROM now JOIN (SELECT * FROM old ORDER BY abs(r) DESC LIMIT 10) old ON now.i = old.i AND now.j = old.j
""")
def sign_agreement(spark, folder):
    df = table(spark, folder, "lineitem")
    old = relations.pearson_pairs(df.withColumn("l_tax", -F.col("l_tax")), LINE_NUMBERS)
    return rounded(relations.sign_agreement(old, relations.pearson_pairs(df, LINE_NUMBERS, None)))


# -- duplicates --------------------------------------------------------------

_MESSY_DATA = ["o_custkey", "o_totalprice", "o_rank", "o_orderstatus", "o_orderpriority", "o_flag", "o_empty"]
_MESSY_LIST = ", ".join(_MESSY_DATA)


@query(f"""
SELECT min(o_orderkey) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice,
  CAST(o_rank AS DOUBLE) AS o_rank, o_orderstatus, o_orderpriority, o_flag, o_empty
FROM ({MESSY_SQL}) m GROUP BY {_MESSY_LIST}
""")
def drop_duplicate_rows(spark, folder):
    return as_doubles(dedup.drop_duplicate_rows(messy(spark, folder), "o_orderkey"), "o_custkey", "o_rank")


@query(f"""
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicates,
  {r("(sum(n) - count(*)) * 1.0 / sum(n)")} AS duplicate_ratio
FROM (SELECT count(*) AS n FROM ({MESSY_SQL}) m GROUP BY {_MESSY_LIST}) x
""")
def duplicate_summary(spark, folder):
    return rounded(dedup.duplicate_summary(messy(spark, folder), "o_orderkey"))


@query(f"""
SELECT o_orderkey, row_number() OVER (PARTITION BY {_MESSY_LIST} ORDER BY o_orderkey) > 1 AS is_duplicate
FROM ({MESSY_SQL}) m
""")
def mark_duplicates(spark, folder):
    return dedup.mark_duplicates(messy(spark, folder), "o_orderkey").select("o_orderkey", "is_duplicate")


_PRINT_NAMES = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query(f"""
SELECT count(*) AS rows, md5(concat_ws('|', '{chr(2).join(_PRINT_NAMES)}', CAST(count(*) AS VARCHAR),
  CAST(CAST(sum(CAST(concat('0x', substr(md5(concat_ws('{chr(2)}',
    {", ".join(f"coalesce(length(CAST({n} AS VARCHAR)) || ':' || CAST({n} AS VARCHAR), '{chr(1)}')" for n in _PRINT_NAMES)})), 1, 15)) AS HUGEINT)) AS HUGEINT) AS VARCHAR))) AS digest
FROM ({GAPPY_SQL}) g
""")
def fingerprint(spark, folder):
    return dedup.fingerprint(gappy(spark, folder), _PRINT_NAMES)


@query(f"""
WITH f AS ({fences("customer", ["c_acctbal"])})
SELECT c_nationkey, count(*) AS normal_rows FROM customer, f WHERE NOT (c_acctbal < q1 OR c_acctbal > q3) GROUP BY c_nationkey
""")
def rows_without_listed_ids(spark, folder):
    df = table(spark, folder, "customer")
    marks = profile.quantiles(df, ["c_acctbal"], [0.25, 0.75])["c_acctbal"]
    ids = df.where((F.col("c_acctbal") < marks[0]) | (F.col("c_acctbal") > marks[1])).select("c_custkey")
    _, rest = dedup.split_by_ids(df, ids, "c_custkey")
    return rest.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("normal_rows"))


@query(f"""
SELECT true AS same_table, false AS other_profile FROM (SELECT count(*) FROM customer) c
""")
def unchanged_input(spark, folder):
    df = table(spark, folder, "customer")
    marker = dedup.fingerprint(df).select("digest", F.lit("profile-1").alias("profile_digest"))
    same = dedup.unchanged(df, "profile-1", marker).select(F.col("skip").alias("same_table"), "digest")
    other = dedup.unchanged(df, "profile-2", marker).select(F.col("skip").alias("other_profile"), "digest")
    return same.join(other, "digest").drop("digest")
