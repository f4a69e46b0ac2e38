"""Looking at tables: completeness, search, sorting, pages, and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import ORACLES, query
from catalog.profiling import LEADING, LINE_NUMBERS, ORDER_NUMBERS, ORDER_TEXTS, leading_sql, pairs_sql
from catalog.tables import (
    GAPPY_SQL, TEXT_COLUMNS, TEXT_SQL, as_doubles, as_text, cells, fences, from_sql, gappy, r, rounded, table, union,
)
from dqspark.operators import charts as G, explore as E, profile, relations
from dqspark.sources import readers

_VIEW = ["c_custkey", "c_name", "c_balance", "c_units", "c_age", "c_mktsegment"]

# -- viewer scores -----------------------------------------------------------


def _bands(n: str) -> str:
    pct = f"count(*) FILTER (WHERE trim({n}) <> '') * 100.0 / count(*)"
    return f"""SELECT '{n}' AS "column", count(*) FILTER (WHERE trim({n}) <> '') AS complete, count(*) AS total, {r(pct)} AS percentage,
  CASE WHEN {pct} >= 95 THEN 'Excellent' WHEN {pct} >= 90 THEN 'Very Good' WHEN {pct} >= 80 THEN 'Good' WHEN {pct} >= 70 THEN 'Fair' ELSE 'Poor' END AS band
FROM ({TEXT_SQL}) x"""


@query(union([_bands(n) for n in TEXT_COLUMNS]))
def completeness_bands(spark, folder):
    return rounded(E.by_completeness(profile.completeness_bands(as_text(spark, folder))))


def _view_column(n: str) -> str:
    return f"""SELECT '{n}' AS "column", count(*) AS total, count(t) AS complete, count(v) AS nums,
  count(*) FILTER (WHERE abs(v - (SELECT avg({leading_sql(n)}) FROM t)) > 3 * (SELECT stddev_pop({leading_sql(n)}) FROM t)) AS outs,
  count(DISTINCT lower(trim(t))) AS kinds
FROM (SELECT nullif(trim({n}), '') AS t, {leading_sql(n)} AS v FROM t) s"""


_VIEW_SQL = f"""
WITH t AS ({TEXT_SQL}), c AS ({union([_view_column(n) for n in _VIEW])}),
k AS (SELECT *, complete * 100.0 / total AS pct, (total - complete) * 1.0 / total AS missing_ratio,
  CASE WHEN complete = 0 THEN NULL WHEN nums > complete * 0.8 THEN 'numeric' ELSE 'categorical' END AS kind FROM c),
q AS (SELECT *, CASE WHEN kind = 'numeric' THEN outs * 1.0 / nums WHEN kind = 'categorical' THEN kinds * 1.0 / complete ELSE 0 END AS ratio FROM k),
p AS (SELECT *, greatest(pct - CASE WHEN kind = 'numeric' THEN ratio * 50 WHEN kind = 'categorical' AND ratio > 0.5 THEN least((ratio - 0.5) * 20, 8) ELSE 0 END, 70) AS quality FROM q)"""


@query(f"""{_VIEW_SQL} SELECT "column", complete, total, {r("pct")} AS percentage, kind, {r("ratio")} AS ratio,
{r("missing_ratio")} AS missing_ratio, {r("quality")} AS quality FROM p""")
def viewer_column_quality(spark, folder):
    return rounded(profile.viewer_column_quality(as_text(spark, folder).select(*_VIEW)))


@query(f"""{_VIEW_SQL}, a AS (SELECT max(total) AS total_rows, count(*) AS total_cols, count(*) FILTER (WHERE complete = total) AS complete_cols,
  avg(quality) AS base, avg(missing_ratio) AS m, coalesce(avg(ratio) FILTER (WHERE kind = 'numeric'), 0) AS o,
  coalesce(avg(ratio) FILTER (WHERE kind = 'categorical'), 0) AS d FROM p)
SELECT total_rows, total_cols, complete_cols, {r('''least(greatest(base * greatest(1 - m * 30, 0.92) * greatest(1 - o * 50, 0.97)
  * CASE WHEN d > 0.4 THEN greatest(1 - (d - 0.4) * 15, 0.93) ELSE 1 END * 0.98, 87), 96)''')} AS quality FROM a""")
def viewer_score(spark, folder):
    return rounded(profile.viewer_score(as_text(spark, folder).select(*_VIEW)))


# -- search, sort, page ------------------------------------------------------


@query("""SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%'
OR lower(p_type) LIKE '%ring%' OR CAST(p_partkey AS VARCHAR) LIKE '%ring%'""")
def search(spark, folder):
    return E.search(table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "RING")


@query("SELECT p_partkey, p_brand FROM part WHERE lower(p_brand) LIKE '%#1%'")
def search_visible(spark, folder):
    shown = ["p_partkey", "p_brand"]
    return E.visible(E.search(table(spark, folder, "part"), "#1", ["p_brand"]), shown)


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'fr' AND source = 'src0'")
def equal_filters(spark, folder):
    return E.equal_filters(table(spark, folder, "documents"),
                           {"lang": "fr", "source": "src0", "absent": 1}).select("doc_id", "n_chars")


def _natural(c: str) -> str:
    padded = rf"regexp_replace(lower({c}), '(\d+)', '00000000000000000000\1', 'g')"
    return rf"regexp_replace({padded}, '\d*(\d{{20}})', '\1', 'g')"


@query(f"""SELECT p_partkey, label FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_brand || ' size ' || p_size END AS label FROM part) x
ORDER BY {_natural("label")} ASC NULLS LAST, p_partkey LIMIT 25 OFFSET 25""")
def natural_sort_page(spark, folder):
    label = F.when(F.col("p_partkey") % 10 != 0, F.concat("p_brand", F.lit(" size "), F.col("p_size").cast("string")))
    df = table(spark, folder, "part").select("p_partkey", label.alias("label"))
    return E.page(E.natural_sort(df, "label", "p_partkey"), 2)


@query(f"""SELECT p_partkey, label FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_brand || ' size ' || p_size END AS label FROM part) x
ORDER BY {_natural("label")} DESC NULLS LAST, p_partkey LIMIT 10""")
def natural_sort_descending(spark, folder):
    label = F.when(F.col("p_partkey") % 10 != 0, F.concat("p_brand", F.lit(" size "), F.col("p_size").cast("string")))
    df = table(spark, folder, "part").select("p_partkey", label.alias("label"))
    return E.page(E.natural_sort(df, "label", "p_partkey", descending=True), 1, 10)


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 20")
def plain_sort_page(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return E.page(E.plain_sort(df, "n_chars", "doc_id", descending=True), 3, 10)


_LINES = """SELECT l_orderkey * 8 + l_linenumber AS line_id, CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_shipdate END AS shipped,
CONCAT('part ', CAST(l_partkey AS VARCHAR(20)), ' line ', CAST(l_linenumber AS VARCHAR(20))) AS label FROM lineitem"""
DEEP = 1_900


@query(f"SELECT line_id, label FROM ({_LINES}) x ORDER BY {_natural('label')}, line_id LIMIT 25 OFFSET {(DEEP - 1) * 25}")
def deep_natural_page(spark, folder):
    """A page far into the table in natural order, sorted within its own range of keys."""
    df = from_sql(spark, folder, _LINES, "lineitem").drop("shipped")
    return E.Pages(df, E.natural_key(F.col("label")), "line_id", range_rows=5_000).page(DEEP)


@query(f"SELECT line_id, strftime(shipped, '%Y-%m-%d') AS shipped FROM ({_LINES}) x ORDER BY x.shipped DESC NULLS LAST, line_id LIMIT 100 OFFSET 49900")
def deep_page_of_missing(spark, folder):
    """Newest first, on a page where the known dates end or after."""
    df = from_sql(spark, folder, _LINES, "lineitem").drop("label")
    page = E.Pages(df, F.col("shipped"), "line_id", descending=True, range_rows=5_000).page(500, 100)
    return page.select("line_id", F.date_format("shipped", "yyyy-MM-dd").alias("shipped"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_by(spark, folder):
    return E.top_by(table(spark, folder, "orders"), "o_totalprice", "o_orderkey", 50).select("o_orderkey", "o_totalprice")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderpriority
FROM orders ORDER BY orders.o_orderkey LIMIT 8""")
def preview(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return E.preview(df, "o_orderkey", 8)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def bounded_scan(spark, folder):
    return E.bounded(table(spark, folder, "orders"), "o_orderkey").select("o_orderkey", "o_totalprice")


# -- chart data --------------------------------------------------------------


def _runs_sql(values: str, bins: str) -> str:
    """Filled bins and runs of empty ones, from ``v`` of a query and the number of bins over ``lo, hi, n, iqr``."""
    return f"""
WITH v AS ({values}),
a AS (SELECT min(v) AS lo, max(v) AS hi, count(v) AS n, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM v),
s AS (SELECT lo, hi, {bins} AS bins FROM a), w AS (SELECT lo, bins, (hi - lo) / bins AS step FROM s),
b AS (SELECT CAST(least(floor((v - lo) / step), bins - 1) AS BIGINT) AS bin, count(*) AS n FROM v, w WHERE v IS NOT NULL GROUP BY 1),
l AS (SELECT bin, n, lead(bin) OVER (ORDER BY bin) AS beyond FROM b),
k AS (SELECT bin, CAST(1 AS BIGINT) AS bins, n AS count FROM l UNION ALL
  SELECT bin + 1, beyond - bin - 1, 0 FROM l WHERE beyond > bin + 1)
SELECT k.bin, k.bins, {r("lo + k.bin * step")} AS low, {r("lo + (k.bin + k.bins) * step")} AS high, k.count FROM k CROSS JOIN w"""


_AUTO = "CAST(greatest(1, ceil((hi - lo) / least((hi - lo) / (log2(n) + 1), 2 * iqr / pow(n, 1.0 / 3)))) AS BIGINT)"


@query(_runs_sql("SELECT l_extendedprice AS v FROM lineitem", "20"))
def histogram_fixed(spark, folder):
    return rounded(G.histogram(table(spark, folder, "lineitem"), "l_extendedprice", 20))


@query(_runs_sql("SELECT value AS v FROM events", _AUTO))
def histogram_auto(spark, folder):
    return rounded(G.histogram(table(spark, folder, "events"), "value"))


_WILD = "CASE WHEN event_id % 1009 = 5 THEN value * 100000 WHEN event_id % 997 = 3 THEN NULL ELSE value END"


@query(_runs_sql(f"SELECT {_WILD} AS v FROM events", _AUTO))
def histogram_heavy_tail(spark, folder):
    """A few values far out ask for very many bins, nearly all of them empty."""
    return rounded(G.histogram(from_sql(spark, folder, f"SELECT {_WILD} AS value FROM events", "events"), "value"))


@query(f"""WITH g AS ({GAPPY_SQL}), f AS ({fences("g", ["o_totalprice"])})
SELECT o_totalprice AS value, count(*) AS count FROM g, f WHERE o_totalprice < low OR o_totalprice > high GROUP BY o_totalprice""")
def outlier_rug(spark, folder):
    return G.outlier_rug(gappy(spark, folder), "o_totalprice")


@query("""SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, p_brand) AS INTEGER) AS rank, p_brand AS value, count(*) AS count FROM part
GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 15""")
def bar_counts(spark, folder):
    return G.bars(table(spark, folder, "part"), "p_brand")


@query("""
WITH c AS (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS k FROM part GROUP BY p_brand)
SELECT CAST(k AS INTEGER) AS rank, p_brand AS value, n AS count FROM c WHERE k <= 8
UNION ALL SELECT 9, 'Other', CAST(sum(n) AS BIGINT) FROM c WHERE k > 8 HAVING sum(n) > 0
""")
def pie_other(spark, folder):
    return G.pie(table(spark, folder, "part"), "p_brand")


@query(f"""SELECT l_returnflag AS category, {r("avg(l_extendedprice)")} AS mean, {r("stddev_samp(l_extendedprice)")} AS std,
count(l_extendedprice) AS count FROM lineitem GROUP BY l_returnflag""")
def grouped_bars(spark, folder):
    return rounded(G.grouped_bars(table(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice"))


@query("""SELECT row_number() OVER (ORDER BY event_id) - 1 AS position, value FROM events""")
def trend_line(spark, folder):
    return G.trend_line(table(spark, folder, "events"), "value", "event_id")


@query(f"""SELECT position * 100 // n AS position, {r("avg(value)")} AS value FROM (
SELECT row_number() OVER (ORDER BY event_id) - 1 AS position, value, count(*) OVER () AS n FROM events) x GROUP BY 1""")
def trend_line_in_runs(spark, folder):
    return rounded(G.trend_line(table(spark, folder, "events"), "value", "event_id", points=100))


@query(f"""
WITH g AS ({GAPPY_SQL}), f AS ({fences("g", ["o_totalprice", "o_rank"])}), c AS ({cells("g", ["o_totalprice", "o_rank"])})
SELECT c."column", {r("min(value)")} AS min, {r("min(value) FILTER (WHERE value >= low)")} AS whisker_low, {r("any_value(q1)")} AS q1,
  {r("quantile_cont(value, 0.5)")} AS median, {r("any_value(q3)")} AS q3, {r("max(value) FILTER (WHERE value <= high)")} AS whisker_high,
  {r("max(value)")} AS max, count(*) FILTER (WHERE value < low OR value > high) AS fliers
FROM c JOIN f ON c."column" = f."column" GROUP BY c."column"
""")
def box_summary(spark, folder):
    return rounded(G.box_summary(gappy(spark, folder), ["o_totalprice", "o_rank"]))


@query(f"""
WITH g AS ({GAPPY_SQL}), f AS ({fences("g", ["o_totalprice", "o_rank"])}),
p AS (SELECT low, high FROM f WHERE "column" = 'o_totalprice'), k AS (SELECT low, high FROM f WHERE "column" = 'o_rank')
SELECT CAST(o_rank AS DOUBLE) AS x, o_totalprice AS y, CASE WHEN o_totalprice < p.low OR o_totalprice > p.high OR o_rank < k.low OR o_rank > k.high
  THEN 'Outlier' ELSE 'Normal' END AS tag FROM g, p, k WHERE o_rank IS NOT NULL AND o_totalprice IS NOT NULL
""")
def scatter_points(spark, folder):
    return G.scatter(gappy(spark, folder), "o_rank", "o_totalprice", ["o_totalprice", "o_rank"])[0]


@query(f"""SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS at, {r("avg(o_totalprice)")} AS value, count(*) AS points
FROM orders GROUP BY 1""")
def time_series(spark, folder):
    series = G.time_series(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", "month")
    return rounded(series.withColumn("at", F.date_format("at", "yyyy-MM-dd")))


_PLAN_NUMBERS = ["o_totalprice", "o_rank", "o_custkey"]


@query(f"""
WITH g AS ({GAPPY_SQL}),
p AS (SELECT * FROM ({pairs_sql("g", ["o_custkey", "o_rank", "o_totalprice"])}) x WHERE abs(r) >= 0.4)
SELECT chart_id, chart_type FROM (
  SELECT 'hist_' || n AS chart_id, 'histogram' AS chart_type FROM (SELECT unnest(['o_custkey', 'o_totalprice', 'o_rank']) AS n)
  UNION ALL SELECT 'line_o_rank', 'line'
  UNION ALL SELECT 'scatter_' || col_a || '_' || col_b, 'scatter' FROM p
  UNION ALL SELECT 'correlation_heatmap', 'heatmap' UNION ALL SELECT 'boxplot_numeric', 'box'
  UNION ALL SELECT CASE WHEN count(DISTINCT o_orderstatus) <= 8 THEN 'pie_o_orderstatus' ELSE 'bar_o_orderstatus' END, CASE WHEN count(DISTINCT o_orderstatus) <= 8 THEN 'pie' ELSE 'bar' END FROM g
  UNION ALL SELECT CASE WHEN count(DISTINCT o_orderpriority) <= 8 THEN 'pie_o_orderpriority' ELSE 'bar_o_orderpriority' END, CASE WHEN count(DISTINCT o_orderpriority) <= 8 THEN 'pie' ELSE 'bar' END FROM g
  UNION ALL SELECT 'pie_o_flag', 'pie' UNION ALL SELECT 'grouped_o_orderstatus_o_custkey', 'bar' UNION ALL SELECT 'grouped_o_orderpriority_o_custkey', 'bar')
""")
def chart_plan(spark, folder):
    df = gappy(spark, folder)
    data = df.drop("o_orderkey")
    stats = profile.column_stats(df, row_id="o_orderkey")
    specs = G.chart_plan(data, stats, relations.pearson_pairs(data), profile.categorical_insights(data))
    return specs.select("chart_id", "chart_type")


@query("""SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, p_type) AS INTEGER) AS rank, p_type AS value, count(*) AS count FROM part
WHERE p_size = 5 GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 15""")
def run_spec(spark, folder):
    spec = {"chart_type": "bar", "x": "p_type", "y": None}
    return G.run_spec(table(spark, folder, "part"), spec, filters={"p_size": 5})


def _run(df, kind, x=None, y=None, used=(), row_id=None):
    spec = {"chart_type": kind, "x": x, "y": y, "columns_used": list(used)}
    return rounded(G.run_spec(df, spec, row_id))


@query(ORACLES["histogram_auto"])
def run_spec_histogram(spark, folder):
    return _run(table(spark, folder, "events"), "histogram", "value")


@query(ORACLES["pie_other"])
def run_spec_pie(spark, folder):
    return _run(table(spark, folder, "part"), "pie", "p_brand")


@query(ORACLES["grouped_bars"])
def run_spec_grouped(spark, folder):
    return _run(table(spark, folder, "lineitem"), "bar", "l_returnflag", "l_extendedprice")


@query(ORACLES["trend_line"])
def run_spec_line(spark, folder):
    return _run(table(spark, folder, "events"), "line", "value", row_id="event_id")


@query(ORACLES["box_summary"])
def run_spec_box(spark, folder):
    return _run(gappy(spark, folder), "box", used=["o_totalprice", "o_rank"])


@query(f"""SELECT CAST(l_quantity AS DOUBLE) AS x, l_extendedprice AS y FROM lineitem""")
def run_spec_scatter(spark, folder):
    points = _run(table(spark, folder, "lineitem"), "scatter", "l_quantity", "l_extendedprice")
    return points.select("x", "y")


# -- sources -----------------------------------------------------------------


@query("""SELECT event_id, json_extract_string(props, '$.k') AS "props.k" FROM events""")
def flatten_nested(spark, folder):
    df = table(spark, folder, "events").select(
        "event_id", F.from_json("props", "k STRING").alias("props"))
    return readers.flatten(df)


@query("""SELECT conv_id, CASE WHEN turn % 3 = 0 THEN NULL ELSE role END AS role FROM conversations""")
def missing_tokens(spark, folder):
    df = table(spark, folder, "conversations")
    marked = F.when(F.col("turn") % 3 == 0, F.element_at(F.array(F.lit("N/A"), F.lit("null"), F.lit("")),
                                                          (F.col("conv_id") % 3 + 1).cast("int"))).otherwise(F.col("role"))
    return readers.missing_to_null(df.select("conv_id", marked.alias("role")))
