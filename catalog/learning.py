"""Dataset features, the classifier, the feedback loop and its stream."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog import query
from catalog.corruption import CUSTOMER, EIGHT, features_sql, grid, grid_sql, normal, picked_features
from catalog.tables import (
    FEEDBACK_SQL, GAPPY_SQL, as_doubles, feedback, gappy, r, rounded, table, union,
)
from dqspark.functions.ordering import bucket_count
from dqspark.functions.scratch import scratch_folder
from dqspark.operators import clean as K, corrupt as D, features as X, feedback as L, model as M, quality as Q
from dqspark.plans.retrain import retrain, training_table
from dqspark.sources import sinks
from dqspark.streaming import feedback_stream as W

# -- features ----------------------------------------------------------------

SET_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
SET_TEXTS = ["l_returnflag", "l_linestatus", "l_batch"]
# Every supplier is one dataset; a few gaps and a constant column are added.
SETS_SQL = """SELECT CAST(l_suppkey AS VARCHAR(20)) AS dataset_id, l_quantity, l_extendedprice, l_discount,
  CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_tax END AS l_tax, l_linenumber, l_returnflag, l_linestatus,
  'batch' AS l_batch FROM lineitem"""


def sets(spark, folder):
    df = table(spark, folder, "lineitem")
    return df.select(
        F.col("l_suppkey").cast("string").alias("dataset_id"), "l_quantity", "l_extendedprice", "l_discount",
        F.when(F.col("l_orderkey") % 9 != 0, F.col("l_tax")).alias("l_tax"), "l_linenumber", "l_returnflag",
        "l_linestatus", F.lit("batch").alias("l_batch"))


_SETS = f"WITH {features_sql(SETS_SQL, SET_NUMBERS, SET_TEXTS)}"


@query(f"{_SETS} SELECT dataset_id, num_rows, {picked_features(EIGHT)} FROM f")
def features8_by_dataset(spark, folder):
    return rounded(X.features8(X.measures(sets(spark, folder), "dataset_id")).select("dataset_id", "num_rows", *EIGHT))


_SIX = ["missing_ratio", "duplicate_ratio", "numeric_ratio", "constant_cols"]


@query(f"{_SETS} SELECT dataset_id, {picked_features(_SIX)}, {r('avg_variance', 0)} AS avg_variance, {r('avg_skewness')} AS avg_skewness FROM f")
def features6_by_dataset(spark, folder):
    six = X.features6(X.measures(sets(spark, folder), "dataset_id"))
    return rounded(six.select("dataset_id", *_SIX, "avg_variance", "avg_skewness"), avg_variance=0)


@query(f"""{_SETS} SELECT dataset_id, {picked_features(_SIX)}, {r('norm_variance')} AS norm_variance, {r('skewness')} AS skewness FROM f""")
def features6_normalised(spark, folder):
    six = X.features6_normalised(X.measures(sets(spark, folder), "dataset_id"))
    return rounded(six.select("dataset_id", *_SIX, "norm_variance", "skewness"))


@query(f"""{_SETS} SELECT dataset_id, {picked_features(_SIX + ["norm_variance", "skewness"])}, {r("numeric_ratio")} AS type_consistency,
{r("least(cardinality_ratio * 100, 100)")} AS cardinality_pct, {r("skewness_variance")} AS skewness_variance, {r("raw_kurtosis")} AS mean_kurtosis FROM f""")
def features10_by_dataset(spark, folder):
    ten = X.features10(X.measures(sets(spark, folder), "dataset_id"))
    return rounded(ten.drop("num_rows", "num_columns"))


@query(f"""{_SETS}, z AS (SELECT dataset_id, missing_ratio AS m, duplicate_ratio AS d, numeric_ratio AS n, least(avg_variance, 1e6) / 1e4 AS v, avg_skewness AS s FROM f)
SELECT dataset_id, {r("m * d")} AS missing_x_duplicate, {r("m * n")} AS missing_x_numeric, {r("v * s")} AS variance_x_skew,
  {r("ln(1 + v)")} AS log_variance, {r("ln(1 + abs(s))")} AS log_skew, {r("v / (abs(s) + 1e-10)", 2)} AS variance_per_skew,
  {r("abs(s) / (v + 1e-10)")} AS skew_per_variance FROM z""")
def features13_by_dataset(spark, folder):
    six = X.features6(X.measures(sets(spark, folder), "dataset_id"), X.VARIANCE_CAP)
    scaled = X.features13(six.withColumn("avg_variance", F.col("avg_variance") / 1e4))
    return rounded(scaled.select(
        "dataset_id", "missing_x_duplicate", "missing_x_numeric", "variance_x_skew", "log_variance", "log_skew",
        "variance_per_skew", "skew_per_variance"), variance_per_skew=2)


_TABLES = {"customer": ("c_custkey", ["c_custkey2", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"]),
           "supplier": ("s_suppkey", ["s_nationkey", "s_acctbal"], ["s_name"]),
           "part": ("p_partkey", ["p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"])}


def _cell_features_sql(name: str) -> str:
    _, numbers, texts = _TABLES[name]
    source = f"SELECT '{name}' AS dataset_id, * {', c_custkey % 7 AS c_custkey2' if name == 'customer' else ''} FROM {name}"
    return (f"SELECT * FROM (WITH {features_sql(source, numbers, texts)} SELECT dataset_id, num_rows, {picked_features(EIGHT)} FROM f) x")


@query(union([_cell_features_sql(n) for n in _TABLES]))
def features8_of_cells(spark, folder):
    cells = None
    for name, (key, numbers, texts) in _TABLES.items():
        df = table(spark, folder, name)
        if name == "customer":
            df = df.withColumn("c_custkey2", F.col("c_custkey") % 7)
        part = X.to_cells(df.select(key, *numbers, *texts), F.lit(name), key)
        cells = part if cells is None else cells.unionByName(part)
    return rounded(X.features8(X.cell_measures(cells)).select("dataset_id", "num_rows", *EIGHT))


_GRID = f"WITH {features_sql(grid_sql(), CUSTOMER[:2], CUSTOMER[2:])}"


def grid_features(spark, folder):
    m = X.measures(grid(spark, folder), "dataset_id", "c_custkey", ["label", "severity"])
    return X.features8(m)


@query(f"""{_GRID}, s AS (SELECT dataset_id, 100 - CASE WHEN missing_ratio > 0.2 THEN 30 WHEN missing_ratio > 0.1 THEN 15 WHEN missing_ratio > 0.05 THEN 5 ELSE 0 END
  - CASE WHEN duplicate_ratio > 0.1 THEN 20 WHEN duplicate_ratio > 0.05 THEN 10 ELSE 0 END - CASE WHEN constant_cols > num_columns * 0.2 THEN 15 ELSE 0 END AS score FROM f)
SELECT dataset_id, CAST(score AS BIGINT) AS rule_score, CASE WHEN score >= 70 THEN 1 ELSE 0 END AS rule_label FROM s""")
def rule_label(spark, folder):
    return Q.rule_label(grid_features(spark, folder)).select("dataset_id", "rule_score", "rule_label")


def _flag(i: int, n: str) -> str:
    kind, limit, slack = X.RULES[n]
    away = f"abs({n} - {limit})" if kind == "near" else n
    test = {"cap": f"{n} <= {limit}", "near": f"{away} < {slack}", "none": f"{n} = 0", "under": f"{n} < {limit * slack}"}
    scale = max(limit * slack if kind == "under" else limit, X.LEAST_SCALE)
    return f"""SELECT dataset_id, {i} AS feature_no, '{n}' AS feature, {r(n)} AS value, CAST({limit} AS DOUBLE) AS threshold,
CASE WHEN {test[kind]} THEN 'PASS' ELSE 'FLAG' END AS status,
{r(f"greatest(0, least(1, 1 - {away} / {scale}))")} AS radar FROM f"""


@query(f"{_SETS} {union([_flag(i, n) for i, n in enumerate(EIGHT)])}")
def feature_flags(spark, folder):
    return rounded(X.feature_flags(X.features8(X.measures(sets(spark, folder), "dataset_id"))))


# -- training sets -----------------------------------------------------------

TRAIN_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


DAMAGED = [
    D.Variant("good", 1, ""), D.Variant("missing", 0, "", (("nulls", 18, 1),)),
    D.Variant("duplicates", 0, "", copies=(25, 2)), D.Variant("outliers", 0, "", (("outliers", 12, 3),))]


def labelled_sets(spark, folder):
    """Features of every supplier's rows as they are and in three damaged versions.

    The rows move once, to their supplier's task; versions and groups are made there.
    """
    df = table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), "l_suppkey", *TRAIN_COLUMNS)
    tasks = bucket_count(df.count() * len(DAMAGED) * len(TRAIN_COLUMNS))
    rows = D.variants(df.repartition(tasks, "l_suppkey"), "row_id", DAMAGED, keep=["l_suppkey"])
    eight = X.features8(X.measures(rows.drop("severity"), "dataset_id", "row_id", ["label"], within=["l_suppkey"]))
    named = F.concat("dataset_id", F.lit("_"), F.col("l_suppkey").cast("string"))
    return eight.withColumn("dataset_id", named).drop("l_suppkey")


def saved_sets(spark, folder):
    """The training table written once, so that the model's many passes read it."""
    path = scratch_folder(spark, "training")
    labelled_sets(spark, folder).write.parquet(path)
    return spark.read.parquet(path)


@query(f"""WITH g AS (SELECT doc_id, lang, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(n_chars AS DOUBLE) END AS n_chars FROM documents)
SELECT doc_id, {r("coalesce(n_chars, (SELECT avg(n_chars) FROM g))")} AS n_chars FROM g""")
def features_mean_imputed(spark, folder):
    df = table(spark, folder, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("n_chars").cast("double")).alias("n_chars"))
    return rounded(X.mean_imputed(df, ["n_chars"]))


@query(f"""SELECT o_orderkey, {r("(o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER ()")} AS price,
{r("(o_custkey - avg(o_custkey) OVER ()) / stddev_samp(o_custkey) OVER ()")} AS customer FROM orders""")
def features_standardised(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    scaled = X.standardised(df, ["o_totalprice", "o_custkey"])
    v = vector_to_array("scaled")
    return rounded(scaled.select("o_orderkey", v[0].alias("price"), v[1].alias("customer")))


def _moved(i: int, n: str) -> str:
    drawn = normal(f"c.copy * {X.COPY_SALT} + {42 + i}", "('0x' || substr(md5(dataset_id), 1, 8))::BIGINT")
    return r(f"CASE WHEN c.copy = 0 THEN {n} ELSE least(100.0, greatest(0.0, {n} + {drawn} * 0.05)) END", 5) + f" AS {n}"


@query(f"""{_GRID} SELECT dataset_id, c.copy AS copy, {", ".join(_moved(i, n) for i, n in enumerate(EIGHT))}
FROM f CROSS JOIN (SELECT CAST(unnest(range(6)) AS INTEGER) AS copy) c""")
def features_augmented(spark, folder):
    made = X.augmented(grid_features(spark, folder), copies=5)
    return rounded(made.select("dataset_id", "copy", *EIGHT), 5)


@query()
def features_downsampled(spark, folder):
    return X.downsampled(saved_sets(spark, folder), "dataset_id")


# -- models ------------------------------------------------------------------


@query()
def forest_scores(spark, folder):
    df = saved_sets(spark, folder)
    return M.score(M.train(df), df).select("dataset_id", "label", "quality", "score", "probability_good", "probability_bad")


@query()
def forest_report(spark, folder):
    df = saved_sets(spark, folder)
    return M.report(M.train(df), df).select(
        "dataset_id", "quality_score", "rating", F.to_json("feature_importance").alias("importance"))


@query()
def logistic_scores(spark, folder):
    df = saved_sets(spark, folder)
    return M.score(M.train(df, learner=M.logistic(df.count())), df).select("dataset_id", "label", "quality", "score")


@query()
def cross_validation(spark, folder):
    return M.cross_validate(saved_sets(spark, folder), "dataset_id")


@query()
def shadow_validation(spark, folder):
    fit, test = M.hold_out(saved_sets(spark, folder))
    current = M.train(fit, learner=M.forest(numTrees=5, maxDepth=1))
    return M.shadow_validate(current, M.train(fit, learner=M.forest()), test)


@query()
def model_comparison(spark, folder):
    fit, test = M.hold_out(saved_sets(spark, folder))
    return M.compare({
        "stump_forest": M.score(M.train(fit, learner=M.forest(numTrees=5, maxDepth=1)), test),
        "logistic": M.score(M.train(fit, learner=M.logistic(fit.count())), test),
        "forest": M.score(M.train(fit, learner=M.forest()), test)})


@query()
def evaluation_by_label(spark, folder):
    fit, test = M.hold_out(saved_sets(spark, folder))
    return M.evaluate_by_label(M.train(fit, learner=M.forest()), test)


@query()
def depth_and_penalty_sweep(spark, folder):
    return M.sweep(saved_sets(spark, folder))


@query()
def learning_curve(spark, folder):
    return M.learning_curve(saved_sets(spark, folder), "dataset_id")


@query()
def feature_dominance(spark, folder):
    return M.dominance(saved_sets(spark, folder))


_PREDICTED = """SELECT labels.quality AS label, CASE WHEN documents.n_chars > 800 THEN 1 ELSE 0 END AS prediction
FROM labels JOIN documents ON labels.doc_id = documents.doc_id"""


def _predicted(spark, folder):
    both = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    return both.select(F.col("quality").alias("label"), (F.col("n_chars") > 800).cast("int").alias("prediction"))


@query(f"SELECT label, prediction, count(*) AS n FROM ({_PREDICTED}) p GROUP BY label, prediction")
def confusion(spark, folder):
    return M.confusion(_predicted(spark, folder))


@query(f"""WITH c AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM ({_PREDICTED}) p)
SELECT {r("(tp + tn) * 1.0 / (tp + fp + fn + tn)")} AS accuracy, {r("(tp * 1.0 / (tp + fn) + tn * 1.0 / (tn + fp)) / 2")} AS balanced_accuracy,
  {r("tp * 1.0 / (tp + fp)")} AS precision, {r("tp * 1.0 / (tp + fn)")} AS recall, {r("2.0 * tp / (2 * tp + fp + fn)")} AS f1, tp, fp, fn, tn FROM c""")
def class_metrics(spark, folder):
    return rounded(M.class_metrics(_predicted(spark, folder)))


_PROMOTION = """SELECT event_id, 0.8 AS current_f1, 0.8 + (event_id % 7 - 3) / 50.0 AS candidate_f1, 0.7 AS current_balanced_accuracy,
  0.7 + (event_id % 5 - 1) / 40.0 AS candidate_balanced_accuracy, 0.9 AS current_auc_roc, 0.9 + (event_id % 3 - 1) / 30.0 AS candidate_auc_roc FROM events"""


@query(f"""WITH d AS (SELECT event_id, candidate_f1 - current_f1 AS a, candidate_balanced_accuracy - current_balanced_accuracy AS b, candidate_auc_roc - current_auc_roc AS c
  FROM (SELECT event_id, {", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in ["current_f1", "candidate_f1", "current_balanced_accuracy", "candidate_balanced_accuracy", "current_auc_roc", "candidate_auc_roc"])} FROM ({_PROMOTION}) q) p),
k AS (SELECT event_id, CAST((a > 0.02) AS INTEGER) + CAST((b > 0.02) AS INTEGER) + CAST((c > 0.02) AS INTEGER) AS improved,
  CAST((a < -0.01) AS INTEGER) + CAST((b < -0.01) AS INTEGER) + CAST((c < -0.01) AS INTEGER) AS degraded FROM d)
SELECT event_id, improved, degraded, improved >= 2 AND degraded = 0 AS promoted,
  CASE WHEN improved >= 2 AND degraded = 0 THEN 'meaningful improvement' WHEN degraded > 0 THEN 'degradation detected' ELSE 'insufficient improvement' END AS reason FROM k""")
def promotion_rule(spark, folder):
    e = F.col("event_id")
    pairs = table(spark, folder, "events").select(
        "event_id", F.lit(0.8).alias("current_f1"), (F.lit(0.8) + (e % 7 - 3) / 50.0).alias("candidate_f1"),
        F.lit(0.7).alias("current_balanced_accuracy"), (F.lit(0.7) + (e % 5 - 1) / 40.0).alias("candidate_balanced_accuracy"),
        F.lit(0.9).alias("current_auc_roc"), (F.lit(0.9) + (e % 3 - 1) / 30.0).alias("candidate_auc_roc"))
    return M.promotion(pairs).select("event_id", "improved", "degraded", "promoted", "reason")


# -- feedback ----------------------------------------------------------------

_VALID = "predicted_score >= 0 AND predicted_score <= 100 AND actual_label BETWEEN 0 AND 3"
_ACCEPT = f"({_VALID} AND ((actual_label >= 2 AND predicted_score < 50) OR (actual_label = 0 AND predicted_score > 70)))"


@query(f"""SELECT id, {_ACCEPT} AS accepted, CASE WHEN NOT ({_VALID}) THEN 'invalid' WHEN actual_label = 1 THEN 'neutral'
  WHEN actual_label >= 2 AND predicted_score < 50 THEN 'good_data_low_score' WHEN actual_label = 0 AND predicted_score > 70 THEN 'bad_data_high_score'
  ELSE 'agrees' END AS reason FROM ({FEEDBACK_SQL}) f""")
def feedback_gate(spark, folder):
    return L.gate(feedback(spark, folder)).select("id", "accepted", "reason")


@query(f"SELECT id, predicted_score, actual_label FROM ({FEEDBACK_SQL}) f WHERE NOT ({_VALID})")
def feedback_quarantine(spark, folder):
    return L.quarantine(feedback(spark, folder)).select("id", "predicted_score", "actual_label")


_CAP = f"""SELECT id, dataset_hash, arrival FROM (SELECT id, dataset_hash, CAST(row_number() OVER (PARTITION BY dataset_hash ORDER BY ts, id) AS INTEGER) AS arrival
FROM ({FEEDBACK_SQL}) f WHERE {_ACCEPT}) x WHERE arrival <= 3"""


@query(_CAP)
def feedback_cap(spark, folder):
    accepted = L.gate(feedback(spark, folder)).where("accepted")
    return L.first_per_dataset(accepted).select("id", "dataset_hash", "arrival")


@query(f"SELECT dataset_hash, count(*) AS accepted_rows FROM ({FEEDBACK_SQL}) f WHERE {_ACCEPT} GROUP BY dataset_hash")
def accepted_per_dataset(spark, folder):
    return L.accepted_per_dataset(feedback(spark, folder))


@query(f"SELECT id, CASE WHEN actual_label >= 2 THEN 1 ELSE 0 END AS label FROM ({FEEDBACK_SQL}) f WHERE feature_count = 8 ORDER BY id DESC LIMIT 1000")
def training_rows(spark, folder):
    return L.training_rows(feedback(spark, folder), 1000).select("id", "label")


_COUNTED = f"SELECT id, row_number() OVER (ORDER BY id) AS n FROM ({FEEDBACK_SQL}) f WHERE {_ACCEPT}"


@query(f"SELECT id, n AS feedback_count FROM ({_COUNTED}) x WHERE n >= 20 AND n % 20 = 0")
def retrain_points(spark, folder):
    accepted = L.gate(feedback(spark, folder)).where("accepted")
    return L.retrain_points(accepted.select("id")).select("id", "feedback_count")


@query(f"SELECT dataset_hash, count(*) AS n, 20 - count(*) % 20 AS until_retrain, count(*) >= 5 AND count(*) % 5 = 0 AS demo_trigger FROM ({FEEDBACK_SQL}) f GROUP BY dataset_hash")
def rows_to_retrain(spark, folder):
    counts = feedback(spark, folder).groupBy("dataset_hash").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("dataset_hash", "n", L.rows_to_retrain(F.col("n")).alias("until_retrain"),
                         L.triggers(F.col("n"), L.RETRAIN_EVERY_DEMO).alias("demo_trigger"))


@query(f"SELECT id, dataset_hash FROM ({FEEDBACK_SQL}) f ORDER BY id DESC LIMIT 500")
def feedback_retention(spark, folder):
    return L.newest(feedback(spark, folder)).select("id", "dataset_hash")


@query(f"""SELECT count(*) AS total_feedbacks, count(*) FILTER (WHERE feature_count = 8) AS valid_with_features, count(*) FILTER (WHERE feature_count <> 8) AS invalid_features,
  {r("count(*) FILTER (WHERE feature_count = 8) * 100.0 / count(*)")} AS health_percentage,
  CASE WHEN count(*) FILTER (WHERE feature_count = 8) * 100.0 / count(*) > 90 THEN 'healthy' WHEN count(*) FILTER (WHERE feature_count = 8) * 100.0 / count(*) > 70 THEN 'degraded' ELSE 'poor' END AS status
FROM ({FEEDBACK_SQL}) f""")
def feedback_health(spark, folder):
    return rounded(L.health(feedback(spark, folder)))


@query(f"""
WITH l AS (SELECT ts, 0.5 + (event_id % 40) / 100.0 AS cv FROM events ORDER BY ts DESC LIMIT 10),
a AS (SELECT count(*) AS n, arg_max(cv, ts) AS last, arg_min(cv, ts) AS first, max(ts) AS latest FROM l),
h AS (SELECT *, date_diff('second', date_trunc('second', latest), TIMESTAMP '2024-03-01 00:00:00') / 3600.0 AS hours FROM a)
SELECT n AS models_trained, {r("last")} AS current_cv_score, {r("(last - first) / first * 100")} AS improvement_percentage, {r("hours", 3)} AS hours_since_retrain,
  {r("CASE WHEN hours / 24 <= 0 THEN 1 WHEN hours / 24 >= 90 THEN 0.7 ELSE greatest(0.7, 1 - hours / 24 / 90 * 0.3) END", 5)} AS decay_factor,
  CASE WHEN hours / 24 < 7 THEN 'fresh' WHEN hours / 24 < 30 THEN 'good' WHEN hours / 24 < 90 THEN 'aging' ELSE 'stale' END AS model_status,
  {r("greatest(0, 720 - hours)", 3)} AS next_retrain_recommended_at FROM h
""")
def loop_stats(spark, folder):
    log = table(spark, folder, "events").select("ts", (F.lit(0.5) + (F.col("event_id") % 40) / 100.0).alias("cv_score"))
    stats = L.loop_stats(log, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))
    return rounded(stats.drop("latest_retrain_at"), hours_since_retrain=3, decay_factor=5, next_retrain_recommended_at=3)


@query(f"""SELECT dataset_hash, CAST(max(id) AS DOUBLE) AS newest_id FROM ({FEEDBACK_SQL}) f WHERE feature_count = 8 GROUP BY dataset_hash""")
def stored_features(spark, folder):
    rows = feedback(spark, folder)
    path = scratch_folder(spark, "features")
    sinks.save_features(rows.where(F.size("features") == 8).select(
        "dataset_hash", F.transform("features", lambda v: v + F.col("id")).alias("features"), F.col("ts").cast("timestamp").alias("saved_at")), path)
    found = sinks.lookup_features(spark.read.parquet(path), rows)
    return found.select("dataset_hash", F.col("features")[0].alias("newest_id"))


@query()
def retrained_model(spark, folder):
    rows = feedback(spark, folder).withColumn("features", F.when(F.size("features") == 8, F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda i: ((F.col("id") + i) % 10) / 10.0)).otherwise(F.col("features")))
    done = retrain(saved_sets(spark, folder), rows)
    return done.log.select("cv_score", "feedback_samples", "total_training_samples", "action", "promoted", "validation_reason")


# -- streams -----------------------------------------------------------------


def event_stream(spark, folder, name):
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def time_cuts(events, shares):
    """Points of time with about these shares of the rows before them."""
    seconds = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return [int(t) for t in seconds.approxQuantile("t", shares, 0.001)]


def fed(spark, folder):
    """The event stream as feedback that arrives in three batches, each taken in by a run of its own."""
    events = table(spark, folder, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    one, two = time_cuts(events, [1 / 3, 2 / 3])
    rows = events.select(
        F.col("event_id").alias("id"), F.md5((F.col("user_id") % 40).cast("string")).alias("dataset_hash"),
        F.expr("CASE WHEN event_id % 53 = 0 THEN -5.0D WHEN event_id % 59 = 0 THEN 150.0D ELSE CAST((event_id * 37) % 101 AS DOUBLE) END").alias("predicted_score"),
        F.expr("CASE WHEN event_id % 61 = 0 THEN 4 ELSE CAST(event_id % 4 AS INT) END").alias("actual_label"),
        F.expr("transform(sequence(1, 8), i -> CAST(i AS DOUBLE))").alias("features"), "ts")
    path = scratch_folder(spark, "feedback")
    for part in (at < one, at.between(one, two - 1), at >= two):
        rows.where(part).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        W.feedback_intake(stream, path, f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return path


@query(_CAP.replace("SELECT id, dataset_hash, arrival", "SELECT id, dataset_hash", 1))
def stream_feedback(spark, folder):
    """The gate and the cap on a stream of several batches; equals the batch rule on the same rows."""
    return W.taken_rows(spark, fed(spark, folder)).select("id", "dataset_hash")


@query(f"SELECT id, n AS feedback_count FROM (SELECT id, row_number() OVER (ORDER BY id) AS n FROM ({_CAP}) c) x WHERE n % 20 = 0")
def stream_retrain_points(spark, folder):
    """What fires on the stream; equals the batch rule on the rows taken."""
    return W.retrain_points(spark, fed(spark, folder)).select("id", "feedback_count")


_LATE = "event_id % 11 = 5 AND ts < (SELECT min(ts) + (max(ts) - min(ts)) / 6 FROM events)"


@query(f"""SELECT event_id, user_id, {r("coalesce(v, (SELECT quantile_cont(v, 0.5) FROM e))")} AS value
FROM (SELECT *, {_LATE} AS late FROM e) x WHERE NOT late""".replace(
    "SELECT event_id, user_id,", "WITH e AS (SELECT *, CASE WHEN event_id % 5 = 2 THEN NULL ELSE value END AS v FROM events) SELECT event_id, user_id,", 1))
def stream_clean_late(spark, folder):
    """A plan on rows that arrive in three batches, some of them twice, some after others and some too late.

    Half a day is waited.  The last batch brings rows of the first sixth of the time,
    which are dropped, and rows held back from the last hours of the batch before, which
    are not; every later batch repeats rows of the one before.
    """
    events = table(spark, folder, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
        F.expr("CASE WHEN event_id % 5 = 2 THEN NULL ELSE value END").alias("value"))
    micros = F.unix_micros("ts")
    first, last = events.agg(F.min(micros), F.max(micros)).first()
    sixth = (last - first) / 6
    hours = 3_600_000_000
    late = (F.col("event_id") % 11 == 5) & (micros < first + sixth)
    held = (F.col("event_id") % 3 == 0) & micros.between(int(first + 4 * sixth - 6 * hours), int(first + 4 * sixth - 1))
    part = F.when(late | held, 2).otherwise(F.least(F.floor((micros - first) / (2 * sixth)), F.lit(2)).cast("int"))
    parts = events.withColumn("part", part)
    plan = K.fit(events, K.CleaningProfile(
        fill_missing_strategy="median", drop_empty_rows=False, drop_duplicates=False), "event_id")
    path = scratch_folder(spark, "late")
    for k in range(3):
        fresh = parts.where(F.col("part") == k)
        # Copies get an id of their own.
        again = parts.where((F.col("part") == k - 1) & (F.col("event_id") % 7 == 1)).withColumn(
            "event_id", -1 - F.col("event_id"))
        fresh.union(again).drop("part").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        (W.clean_stream(stream, plan, event_time="ts", delay="12 hours").writeStream.format("parquet")
         .option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
         .trigger(availableNow=True).start().awaitTermination())
    return rounded(spark.read.parquet(f"{path}/rows").select("event_id", "user_id", "value"))


@query(f"""WITH g AS ({GAPPY_SQL}) SELECT o_orderkey, {r("coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM g))")} AS o_totalprice,
  {r("coalesce(o_custkey, (SELECT quantile_cont(CAST(o_custkey AS DOUBLE), 0.5) FROM g))")} AS o_custkey FROM g""")
def stream_clean(spark, folder):
    """A plan fitted on the table, applied to its rows as they arrive."""
    names = ["o_orderkey", "o_totalprice", "o_custkey"]
    plan = K.fit(gappy(spark, folder).select(*names), K.CleaningProfile(
        fill_missing_strategy="median", drop_empty_rows=False, drop_duplicates=False), "o_orderkey")
    stream = event_stream(spark, folder, "orders").select(
        "o_orderkey", F.expr("CASE WHEN o_orderkey % 5 = 2 THEN NULL WHEN o_orderkey % 97 = 1 THEN o_totalprice * 20 ELSE o_totalprice END").alias("o_totalprice"),
        F.expr("CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE o_custkey END").alias("o_custkey"))
    path = scratch_folder(spark, "cleaned")
    run = (W.clean_stream(stream, plan).writeStream.format("parquet").option("path", f"{path}/rows")
           .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())
    run.awaitTermination()
    return rounded(spark.read.parquet(f"{path}/rows"))
