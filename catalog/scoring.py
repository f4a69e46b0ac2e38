"""Quality scores, insights, checks and the verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.cleaning import SQL_FORMATS, number_sql
from catalog.profiling import LINE_NUMBERS, ORDER_NUMBERS, ORDER_TEXTS, counts_sql, pairs_sql
from catalog.tables import (
    GAPPY_SQL, MESSY_SQL, TEXT_SQL, as_text, cells, fences, gappy, messy, r, rounded, table, union,
)
from dqspark.functions.settle import settle
from dqspark.operators import checks as C, insights as N, profile, quality as Q, relations
from dqspark.operators.charts import chart_plan
from dqspark.plans.certify import certify as run_certify, scout as run_scout

_MESSY_DATA = ["o_custkey", "o_totalprice", "o_rank", "o_orderstatus", "o_orderpriority", "o_flag", "o_empty"]

# -- intake scores -----------------------------------------------------------


@query("""
SELECT count(*) AS num_rows, CAST(5 AS BIGINT) AS num_columns, count(*) >= 3 AS is_dataset,
  CASE WHEN count(*) < 3 THEN 'small' END AS rejection_reason FROM customer
""")
def size_guard(spark, folder):
    return Q.size_guard(table(spark, folder, "customer"))


def _outliers_cte(names: list[str]) -> str:
    return f"""f AS ({fences("g", names)}), c AS ({cells("g", names)}),
o AS (SELECT count(*) AS points, count(*) FILTER (WHERE q3 > q1 AND (value < low OR value > high)) AS outs
      FROM c JOIN f ON c."column" = f."column")"""


def _scores_sql(source: str, data: list[str], numbers: list[str], consistency: str, accuracy: str) -> str:
    known = " + ".join(f"count({n})" for n in data)
    return f"""
WITH g AS ({source}), {_outliers_cte(numbers) if numbers else "o AS (SELECT 0 AS points, 0 AS outs)"},
d AS (SELECT count(*) AS groups FROM (SELECT DISTINCT {", ".join(data)} FROM g) x),
s AS (SELECT count(*) AS num_rows, least(({known}) * 1.0 / (count(*) * {len(data)}), 0.99) AS completeness,
  {consistency} AS consistency, {accuracy} AS accuracy,
  least(1.0 - (count(*) - (SELECT groups FROM d)) * 1.0 / count(*), 0.99) AS uniqueness,
  (SELECT CASE WHEN points = 0 THEN 0.95 ELSE least(1.0 - outs * 1.0 / points, 0.99) END FROM o) AS outliers FROM g)
SELECT num_rows, {r("completeness")} AS completeness, {r("consistency")} AS consistency, {r("accuracy")} AS accuracy,
  {r("uniqueness")} AS uniqueness, {r("outliers")} AS outliers,
  {r("least(0.25 * completeness + 0.25 * consistency + 0.20 * accuracy + 0.15 * uniqueness + 0.15 * outliers, 0.99)")} AS confidence
FROM s"""


@query(_scores_sql(MESSY_SQL, _MESSY_DATA, ORDER_NUMBERS, "0.99", "0.99"))
def quality_scores(spark, folder):
    return rounded(Q.quality_scores(messy(spark, folder), row_id="o_orderkey"))


_TEXT_CLAIMS = {"c_balance": "float", "c_units": "integer", "c_mixed": "datetime"}
_time = "coalesce(" + ", ".join(f"try_strptime(c_mixed, '{f}')" for f in SQL_FORMATS.values()) + ")"
_pass = {"c_balance": f"count(*) FILTER (WHERE c_balance IS NULL OR {number_sql('c_balance')} IS NOT NULL)",
         "c_units": f"count(*) FILTER (WHERE c_units IS NULL OR {number_sql('c_units')} IS NOT NULL)",
         "c_mixed": f"count(*) FILTER (WHERE c_mixed IS NULL OR {_time} IS NOT NULL)"}
_TEXT_DATA = ["c_name", "c_balance", "c_units", "c_mixed", "c_mktsegment"]


@query(_scores_sql(
    TEXT_SQL, _TEXT_DATA, [],
    f"least(({' + '.join(_pass.values())}) * 1.0 / (count(*) * 3), 0.99)",
    f"least((2 + {' + '.join(f'CASE WHEN {p} = count(*) THEN 1 ELSE 0 END' for p in _pass.values())}) / 5.0, 0.99)"))
def quality_scores_of_text(spark, folder):
    df = as_text(spark, folder).select("c_custkey", *_TEXT_DATA)
    return rounded(Q.quality_scores(df, _TEXT_CLAIMS, row_id="c_custkey"))


@query()
def scout_report(spark, folder):
    return run_scout(messy(spark, folder), "o_orderkey")


@query(f"""
SELECT "column", score, CASE WHEN score >= 0.90 THEN 'Good' WHEN score >= 0.75 THEN 'Acceptable' ELSE 'Needs Review' END AS label,
  CASE WHEN score * 100 >= 85 THEN 'EXCELLENT' WHEN score * 100 >= 60 THEN 'GOOD' WHEN score * 100 >= 30 THEN 'FAIR' ELSE 'POOR' END AS rating
FROM ({union([f"SELECT '{n}' AS \"column\", {r(f'count({n}) * 1.0 / count(*)')} AS score FROM ({MESSY_SQL}) m" for n in _MESSY_DATA])}) s
""")
def score_words(spark, folder):
    missing = profile.missing_report(messy(spark, folder), _MESSY_DATA, pct_digits=12)
    score = F.round(1 - F.col("missing_pct") / 100, 6) + F.lit(0.0)
    return missing.select("column", score.alias("score"), Q.score_label(score).alias("label"),
                          Q.rating(score * 100).alias("rating"))


@query("""
SELECT event_id, round(hours, 6) AS hours, round(CASE WHEN hours / 24 <= 0 THEN 1.0 WHEN hours / 24 >= 90 THEN 0.70
    ELSE greatest(0.70, 1.0 - hours / 24 / 90.0 * 0.30) END, 6) AS decay,
  CASE WHEN hours / 24 < 7 THEN 'fresh' WHEN hours / 24 < 30 THEN 'good' WHEN hours / 24 < 90 THEN 'aging' ELSE 'stale' END AS status,
  round(greatest(0, 720.0 - hours), 6) AS hours_left
FROM (SELECT event_id, (event_id % 2600) * 1.0 - 10 AS hours FROM events) e
""")
def age_rules(spark, folder):
    hours = (F.col("event_id") % 2600).cast("double") - 10
    return rounded(table(spark, folder, "events").select(
        "event_id", hours.alias("hours"), Q.decay(hours).alias("decay"),
        Q.age_status(hours).alias("status"), Q.hours_to_retrain(hours).alias("hours_left")))


# -- insights ----------------------------------------------------------------

_INSIGHT = ["missing", "pair", "outlier", "skew", "class"]


def _missing_pct(n: str) -> str:
    return f"(count(*) - count({n})) * 100.0 / count(*)"


@query(f"""
SELECT CAST(count(*) AS DOUBLE) AS measure, string_agg("column", ', ' ORDER BY k) AS subject,
  count(*) || ' column(s) lack more than 20 % of their values: ' || string_agg('`' || "column" || '` ' || printf('%.1f', pct) || ' %', ', ' ORDER BY k) AS text
FROM ({union([f"SELECT {i} AS k, '{n}' AS \"column\", {_missing_pct(n)} AS pct FROM ({GAPPY_SQL}) g" for i, n in enumerate(ORDER_NUMBERS + ORDER_TEXTS)])}) s WHERE pct > 20
""")
def insight_missing(spark, folder):
    names = ORDER_NUMBERS + ORDER_TEXTS
    stats = profile.missing_report(gappy(spark, folder), names, pct_digits=6)
    order = spark.createDataFrame(list(zip(names, range(len(names)))), "column STRING, column_no INT")
    return N.missing_insight(stats.join(order, "column")).select("subject", "measure", "text")


@query(f"""
WITH p AS (SELECT * FROM ({pairs_sql(f"({GAPPY_SQL}) g", ["o_orderkey"] + ORDER_NUMBERS)}) x WHERE abs(r) >= 0.7),
t AS (SELECT * FROM p ORDER BY abs(r) DESC, col_a, col_b LIMIT 1)
SELECT 'strongest_pair' AS kind, col_a || ' / ' || col_b AS subject, {r("r")} AS measure,
  '`' || col_a || '` and `' || col_b || '` move together most: r = ' || printf('%+.3f', r) AS text FROM t
UNION ALL SELECT 'multicollinearity', 'pairs', CAST(count(*) AS DOUBLE), count(*) || ' pairs of columns carry nearly the same information; a linear model cannot tell them apart' FROM p HAVING count(*) > 1
""")
def insight_pairs(spark, folder):
    pairs = relations.pearson_pairs(gappy(spark, folder), ["o_orderkey"] + ORDER_NUMBERS)
    both = N.strongest_pair(pairs).unionByName(N.collinearity(pairs))
    return both.select("kind", "subject", "measure", "text")


@query(f"""
WITH g AS ({GAPPY_SQL}), f AS ({fences("g", ORDER_NUMBERS)}), c AS ({cells("g", ORDER_NUMBERS)})
SELECT c."column" AS subject, CAST(count(*) AS DOUBLE) AS measure FROM c JOIN f ON c."column" = f."column"
WHERE value < low OR value > high GROUP BY c."column" ORDER BY count(*) DESC, c."column" LIMIT 1
""")
def insight_outliers(spark, folder):
    found = profile.anomalies(gappy(spark, folder), ORDER_NUMBERS, "o_orderkey")
    return N.heaviest_outliers(found).select("subject", "measure")


@query(f"""
WITH g AS ({GAPPY_SQL})
SELECT "column" AS subject, {r("skew", 5)} AS measure, CASE WHEN skew > 0 THEN 'right' ELSE 'left' END AS side FROM (
  SELECT "column", (avg(value) - quantile_cont(value, 0.5)) / stddev_samp(value) AS skew FROM (
    {cells("(SELECT o_totalprice, o_rank, exp(o_rank % 20) AS o_steep FROM g) s", ["o_totalprice", "o_rank", "o_steep"])}) c GROUP BY "column") k
WHERE abs(skew) > 0.2
""")
def insight_skew(spark, folder):
    df = gappy(spark, folder).select("o_totalprice", "o_rank", F.exp(F.col("o_rank") % 20).alias("o_steep"))
    stats = profile.column_stats(df)
    shaped = profile.shape_stats(df).where(F.abs("quick_skew") > 0.2)
    return shaped.join(stats.select("column"), "column").select(
        F.col("column").alias("subject"), (F.round("quick_skew", 5) + F.lit(0.0)).alias("measure"),
        F.when(F.col("quick_skew") > 0, "right").otherwise("left").alias("side"))


@query(f"""
WITH g AS (SELECT *, CASE WHEN o_orderkey % 40 = 0 THEN 'rare' WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'usual' END AS o_kind FROM ({GAPPY_SQL}) x),
c AS ({counts_sql("g", ["o_kind"] + ORDER_TEXTS)}),
t AS (SELECT "column", sum(n) AS rows, max(n) FILTER (WHERE value IS NOT NULL) AS hi, min(n) FILTER (WHERE value IS NOT NULL) AS lo,
  count(value) AS classes FROM c GROUP BY "column")
SELECT 'dominant_class' AS kind, "column" AS subject, {r("hi * 100.0 / rows")} AS measure FROM t WHERE classes >= 2 AND hi * 100.0 / rows > 50
UNION ALL SELECT 'severe_imbalance', "column", {r("hi * 1.0 / lo")} FROM t WHERE classes >= 2 AND hi * 1.0 / lo > 10
""")
def insight_classes(spark, folder):
    kind = (F.when(F.col("o_orderkey") % 40 == 0, "rare").when(F.col("o_orderkey") % 3 == 0, F.lit(None))
            .otherwise("usual"))
    df = gappy(spark, folder).withColumn("o_kind", kind)
    return rounded(N.class_insights(df, ["o_kind"] + ORDER_TEXTS).select("kind", "subject", "measure"))


def _profiled(spark, folder):
    df = gappy(spark, folder)
    data = df.select(*ORDER_NUMBERS, *ORDER_TEXTS)
    stats = settle(profile.column_stats(df, row_id="o_orderkey"))
    return df, data, stats, settle(relations.pearson_pairs(data))


@query()
def key_insights(spark, folder):
    df, data, stats, pairs = _profiled(spark, folder)
    found = settle(profile.anomalies(df, ORDER_NUMBERS, "o_orderkey"))
    return N.key_insights(data, stats, pairs, found)


@query()
def chart_explanations(spark, folder):
    _, data, stats, pairs = _profiled(spark, folder)
    categories = settle(profile.categorical_insights(data))
    specs = chart_plan(data, stats, pairs, categories)
    return N.chart_explanations(specs, stats, pairs, categories)


# -- checks ------------------------------------------------------------------

_CHECK_INPUT = f"""SELECT o_orderkey, o_custkey, o_totalprice, o_rank AS rank_count, CASE WHEN o_orderkey % 30 = 7 THEN -1.0 - o_orderkey % 5
  ELSE o_orderkey % 160 * 1.0 END AS paid_pct, o_orderstatus, o_empty FROM ({MESSY_SQL}) m"""
_CHECK_DATA = ["o_custkey", "o_totalprice", "rank_count", "paid_pct", "o_orderstatus", "o_empty"]


def _check_frame(spark, folder):
    pct = F.when(F.col("o_orderkey") % 30 == 7, -1.0 - F.col("o_orderkey") % 5).otherwise(
        (F.col("o_orderkey") % 160).cast("double"))
    return messy(spark, folder).select(
        "o_orderkey", "o_custkey", "o_totalprice", F.col("o_rank").alias("rank_count"),
        pct.alias("paid_pct"), "o_orderstatus", "o_empty")


def _check_row(check_id: str, category: str, passed: str, severity: str) -> str:
    return f"SELECT '{check_id}' AS check_id, '{category}' AS category, {passed} AS passed, '{severity}' AS severity FROM x"


_SANITY = union([
    _check_row("row_count_match", "accuracy", "count(*) = 100", "error"),
    _check_row("col_count_match", "accuracy", "count(*) >= 0", "warning"),
    _check_row("no_all_na_rows", "completeness",
               f"count(*) FILTER (WHERE {' AND '.join(f'{n} IS NULL' for n in _CHECK_DATA)}) = 0", "error"),
    _check_row("no_all_na_cols", "completeness", "count(o_empty) > 0", "error"),
    _check_row("no_duplicates", "duplicates",
               f"count(*) = (SELECT count(*) FROM (SELECT DISTINCT {', '.join(_CHECK_DATA)} FROM x) d)", "warning"),
    _check_row("non_negative_o_totalprice", "accuracy", "count(*) FILTER (WHERE o_totalprice < 0) = 0", "error"),
    _check_row("non_negative_rank_count", "accuracy", "count(*) FILTER (WHERE rank_count < 0) = 0", "error"),
    _check_row("pct_range_paid_pct", "accuracy", "count(*) FILTER (WHERE paid_pct < 0 OR paid_pct > 100) = 0", "warning"),
    _check_row("min_row_count", "accuracy", "count(*) >= 3", "error"),
    _check_row("min_col_count", "accuracy", "count(*) >= 0", "error"),
])
_OUTLIER_CHECK = f"""SELECT 'outliers_evaluation' AS check_id, 'outliers' AS category, outs * 100.0 / points < 5 AS passed,
  CASE WHEN outs * 100.0 / points < 3 THEN 'info' WHEN outs * 100.0 / points < 7 THEN 'warning' ELSE 'error' END AS severity FROM o"""
_CHECK_NUMBERS = ["o_custkey", "o_totalprice", "rank_count", "paid_pct"]
_CHECK_CTES = f"WITH x AS ({_CHECK_INPUT}), g AS (SELECT * FROM x), {_outliers_cte(_CHECK_NUMBERS)}"


@query(f"WITH x AS ({_CHECK_INPUT}) {_SANITY}")
def sanity_checks(spark, folder):
    return C.sanity_checks(_check_frame(spark, folder), 100, 6, "o_orderkey").select(
        "check_id", "category", "passed", "severity")


@query(f"{_CHECK_CTES} {_OUTLIER_CHECK}")
def outlier_check(spark, folder):
    return C.outlier_check(_check_frame(spark, folder), "o_orderkey").select(
        "check_id", "category", "passed", "severity")


@query(f"""{_CHECK_CTES} SELECT outs AS outlier_count, points, {r("outs * 100.0 / points")} AS outlier_pct FROM o""")
def outlier_level(spark, folder):
    return rounded(C.outlier_summary(_check_frame(spark, folder), "o_orderkey"))


def _near(measure: str, factor: str) -> str:
    return f"abs({measure} - {measure} * {factor}) <= 1e-3 * (abs({measure} * {factor}) + 1e-9)"


@query(union([
    f"SELECT '{m}_match_{n}' AS check_id, {_near(f'{f}({n})', s)} AS passed, '{'warning' if m == 'mean' else 'info'}' AS severity FROM lineitem"
    for n in LINE_NUMBERS for m, f, s in (("mean", "avg", "1.002"), ("std", "stddev_samp", "1.0005"), ("min", "min", "1"), ("max", "max", "1.1"))
]) + " UNION ALL SELECT 'col_exists_gone', false, 'error' FROM (SELECT count(*) FROM lineitem) x")
def consistency_checks(spark, folder):
    fresh = profile.column_stats(table(spark, folder, "lineitem").select(*LINE_NUMBERS))
    reported = fresh.withColumn("mean", F.col("mean") * 1.002).withColumn(
        "std", F.col("std") * 1.0005).withColumn("max", F.col("max") * 1.1)
    gone = fresh.where(F.col("column") == "l_tax").withColumn("column", F.lit("gone"))
    return C.consistency_checks(reported.unionByName(gone), fresh).select("check_id", "passed", "severity")


@query(f"""
WITH now AS ({pairs_sql("lineitem", LINE_NUMBERS)}), old AS ({pairs_sql("(SELECT * REPLACE (-l_tax AS l_tax) FROM lineitem) l", LINE_NUMBERS)})
SELECT 'corr_direction_' || now.col_a || '_' || now.col_b AS check_id, (round(old.r, 6) >= 0) = (round(now.r, 6) >= 0) AS passed, 'warning' AS severity
FROM now JOIN (SELECT * FROM old ORDER BY abs(r) DESC LIMIT 10) old ON now.i = old.i AND now.j = old.j
""")
def correlation_checks(spark, folder):
    df = table(spark, folder, "lineitem")
    old = relations.pearson_pairs(df.withColumn("l_tax", -F.col("l_tax")), LINE_NUMBERS)
    return C.correlation_checks(old, relations.pearson_pairs(df, LINE_NUMBERS, None)).select(
        "check_id", "passed", "severity")


def _all_checks(spark, folder):
    df = _check_frame(spark, folder)
    return C.sanity_checks(df, 100, 6, "o_orderkey").unionByName(C.outlier_check(df, "o_orderkey"))


_WEIGHT = "CASE severity WHEN 'error' THEN 1.0 WHEN 'warning' THEN 0.7 ELSE 0.15 END"
_DIMENSIONS = f"""dims AS (SELECT * FROM (VALUES ('completeness', 0.20), ('consistency', 0.20), ('accuracy', 0.15),
  ('duplicates', 0.12), ('outliers', 0.12), ('ml_assessment', 0.21)) v(dimension, weight)),
checks AS ({_SANITY} UNION ALL {_OUTLIER_CHECK}),
scored AS (SELECT dims.dimension, dims.weight, CASE WHEN count(check_id) = 0 THEN 0.75 ELSE
    round(CAST(greatest(0, least(1 - sum(CASE WHEN passed THEN 0 ELSE {_WEIGHT} END) / sum({_WEIGHT}), 0.85)) AS DOUBLE), 4) END AS score,
  count(check_id) FILTER (WHERE passed) AS checks_passed, count(check_id) AS checks_total
  FROM dims LEFT JOIN checks ON checks.category = dims.dimension GROUP BY dims.dimension, dims.weight)"""


@query(f"""{_CHECK_CTES}, {_DIMENSIONS}
SELECT dimension, CAST(score AS DOUBLE) AS score, CAST(weight AS DOUBLE) AS weight, checks_passed, checks_total FROM scored""")
def dimension_scores(spark, folder):
    return C.dimension_scores(_all_checks(spark, folder))


@query(f"""{_CHECK_CTES}, {_DIMENSIONS},
conf AS (SELECT round(CAST(least(sum(score * weight) / sum(weight), 0.80) AS DOUBLE), 4) AS v FROM scored)
SELECT any_value(v) AS overall_confidence, CASE WHEN count(*) FILTER (WHERE NOT passed AND severity = 'error') > 0 OR any_value(v) < 0.5 THEN 'REJECTED'
  WHEN any_value(v) < 0.7 THEN 'APPROVED_WITH_WARNINGS' ELSE 'APPROVED' END AS status,
  count(*) FILTER (WHERE passed) AS checks_passed, count(*) AS checks_total FROM checks, conf""")
def verdict(spark, folder):
    return C.verdict(_all_checks(spark, folder))


@query(f"""{_CHECK_CTES}, {_DIMENSIONS}
SELECT category, severity, count(*) AS issues, string_agg(check_id, ',' ORDER BY check_id) AS check_ids
FROM checks WHERE NOT passed GROUP BY category, severity""")
def issues(spark, folder):
    return C.issues(_all_checks(spark, folder)).withColumn("check_ids", F.array_join("check_ids", ","))


@query("""SELECT 'output_exists_orders' AS check_id, count(*) > 0 AS passed, 'error' AS severity FROM orders
UNION ALL SELECT 'output_exists_big_orders', count(*) > 0, 'warning' FROM orders WHERE o_totalprice < 0
UNION ALL SELECT 'output_exists_never_made', count(*) < 0, 'error' FROM orders
UNION ALL SELECT 'chart_count_nonzero', count(*) > 0, 'error' FROM orders""")
def required_outputs(spark, folder):
    orders = table(spark, folder, "orders")
    found = C.required_outputs({
        "orders": (orders, "error"), "big_orders": (orders.where("o_totalprice < 0"), "warning"),
        "never_made": (None, "error")}, orders)
    data = orders.select("o_totalprice", "o_orderstatus")
    specs = chart_plan(data, profile.column_stats(data), relations.pearson_pairs(data),
                       profile.categorical_insights(data))
    return found.unionByName(C.chart_check(specs)).select("check_id", "passed", "severity")


@query()
def certify(spark, folder):
    return run_certify(messy(spark, folder), "o_orderkey").verdict


@query("""
WITH s AS (SELECT CASE WHEN quality = 1 THEN 'GOOD' ELSE 'BAD' END AS quality, least(100, n_chars / 20.0) AS score
           FROM labels JOIN documents USING (doc_id))
SELECT quality = 'GOOD' AND score > 70 AS passed,
       CASE WHEN quality = 'GOOD' AND score > 75 THEN 'info' ELSE 'warning' END AS severity, count(*) AS n
FROM s GROUP BY ALL
""")
def model_verdicts(spark, folder):
    scored = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id").select(
        F.when(F.col("quality") == 1, "GOOD").otherwise("BAD").alias("quality"),
        F.least(F.lit(100.0), F.col("n_chars") / 20.0).alias("score"))
    return C.model_check(scored).groupBy("passed", "severity").agg(F.count(F.lit(1)).alias("n"))
