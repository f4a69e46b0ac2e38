import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dqspark.operators import clean as K, dedup, schema
from dqspark.plans.certify import certify, scout


def test_names():
    names = ["Sales Count", "  Spaces  ", "MixedCase", "UPPERCASE", "With-Dashes", "With/Slashes", "sales-count", "%"]
    assert schema.standard_names(names) == [
        "sales_count", "spaces", "mixedcase", "uppercase", "with_dashes", "with_slashes", "sales_count_2", "col_7"]


def test_messy_frame_ends_clean(rows):
    df = rows(
        "id BIGINT, `Full Name` STRING, Age STRING, City STRING, Gone STRING",
        (1, "Ann", "31", "Rome", None), (2, "Bob", "x", "Rome", None), (3, None, "45", "Oslo", None),
        (4, "Ann", "31", "Rome", None), (5, None, None, None, None), (6, "Eve", "52", None, None))
    cleaned, plan = K.clean(df, row_id="id")
    got = {r["id"]: r.asDict() for r in cleaned.collect()}
    assert set(got) == {1, 2, 3, 6}
    assert cleaned.columns == ["id", "full_name", "age", "city"]
    assert got[2]["age"] == 45.0 and got[6]["city"] == "Rome" and got[3]["full_name"] == "Ann"
    m = K.clean_metrics(cleaned, plan).first().asDict()
    assert m == {"rows_input": 6, "columns_input": 5, "duplicates_removed": 1, "empty_rows_removed": 1,
                 "empty_columns_removed": 1, "columns_standardized": 4, "missing_values_filled": 3,
                 "outliers_removed": 0, "rows_output": 4, "columns_output": 4}
    again, _ = K.clean(cleaned, row_id="id")
    assert sorted(again.collect()) == sorted(cleaned.collect())


def test_strategy_follows_skew(rows):
    data = [(i, "t", float(i), float(2 ** i)) for i in range(12)] + [(12, "t", None, None)]
    df = rows("id BIGINT, t STRING, even DOUBLE, steep DOUBLE", *data)
    fills = K.fit(df, row_id="id").fills
    assert (fills["even"].strategy, fills["even"].value) == ("mean", 5.5)
    assert (fills["steep"].strategy, fills["steep"].value) == ("median", 48.0)
    short = rows("id BIGINT, t STRING, v DOUBLE", *[(i, "t", float(i)) for i in range(5)], (9, "t", None))
    assert K.fit(short, row_id="id").fills["v"].strategy == "median"


def test_median_fill_of_repeated_pattern(spark):
    ages = [25.0, None, 35.0, None, 45.0, 50.0, None, 60.0, None, 70.0] * 102
    pdf = pd.DataFrame({"id": range(1020), "age": ages})
    df = spark.createDataFrame(pdf).withColumn("age", F.when(~F.isnan("age"), F.col("age")))
    rules = K.CleaningProfile(fill_missing_strategy="median", drop_duplicates=False, drop_empty_rows=False)
    cleaned, plan = K.clean(df, rules, "id")
    assert plan.fills["age"].value == pdf.age.median()
    assert cleaned.where("age IS NULL").count() == 0 and cleaned.count() == 1020


def test_mode_tie_and_unknown(rows):
    df = rows("id BIGINT, a STRING, b STRING", (1, "y", None), (2, "x", None), (3, None, None))
    plan = K.fit(df, K.CleaningProfile(drop_empty_cols=False, drop_duplicates=False, drop_empty_rows=False), "id")
    assert plan.fills["a"].value == "x"
    assert (plan.fills["b"].strategy, plan.fills["b"].value) == ("unknown_fallback", "Unknown")
    assert {r["b"] for r in K.transform(df, plan).collect()} == {"Unknown"}


def test_dates_and_flags_keep_their_type(rows):
    day = dt.datetime(2024, 1, 2)
    df = rows("id BIGINT, d TIMESTAMP, f BOOLEAN", (1, day, True), (2, day, True), (3, None, None))
    cleaned, _ = K.clean(df, K.CleaningProfile(drop_duplicates=False, drop_empty_rows=False), "id")
    assert dict(cleaned.dtypes)["d"] == "timestamp" and dict(cleaned.dtypes)["f"] == "boolean"
    assert {(r["d"], r["f"]) for r in cleaned.collect()} == {(day, True)}


def test_forward_fill_needs_an_order(rows):
    df = rows("v DOUBLE", (1.0,), (None,))
    rules = K.CleaningProfile(fill_missing_strategy="ffill", drop_duplicates=False, drop_empty_rows=False)
    with pytest.raises(ValueError):
        K.clean(df, rules)


def test_outlier_methods(rows):
    df = rows("id BIGINT, v DOUBLE", *[(i, float(i % 5)) for i in range(40)], (99, 500.0))
    for method in ("iqr", "iqr_sequential", "zscore"):
        rules = K.CleaningProfile(handle_outliers=True, outlier_method=method, drop_duplicates=False)
        cleaned, plan = K.clean(df, rules, "id")
        assert cleaned.where("id = 99").count() == 0
        assert K.clean_metrics(cleaned, plan).first()["outliers_removed"] == 1


def test_duplicates_are_null_safe(rows):
    df = rows("id BIGINT, a STRING, b DOUBLE", (3, "x", None), (1, "x", None), (2, "y", 1.0))
    assert {r["id"] for r in dedup.drop_duplicate_rows(df, "id").collect()} == {1, 2}
    marked = {r["id"]: r["is_duplicate"] for r in dedup.mark_duplicates(df, "id").collect()}
    assert marked == {1: False, 2: False, 3: True}


def test_fingerprint_ignores_order_and_sees_changes(rows):
    a = rows("a STRING, b BIGINT", ("x", 1), ("y", None))
    b = rows("a STRING, b BIGINT", ("y", None), ("x", 1))
    c = rows("a STRING, b BIGINT", ("y", 0), ("x", 1))
    digest = [dedup.fingerprint(d).first()["digest"] for d in (a, b, c)]
    assert digest[0] == digest[1] != digest[2]


def test_inference_prefers_time_and_needs_most_rows(rows):
    data = [(f"2024-01-0{i}", str(i), "a" if i < 4 else str(i), str(i) if i > 2 else "k") for i in range(1, 10)]
    df = rows("d STRING, n STRING, mostly STRING, some STRING", *data)
    got = {r["column"]: r["inferred"] for r in schema.infer_report(df).collect()}
    assert got == {"d": "datetime", "n": "numeric", "mostly": "categorical", "some": "numeric"}


def test_hint_matching():
    assert schema.hinted("country") and not schema.hinted("country", "token")
    assert schema.hinted("order_id", "token")


def test_certificate(rows):
    data = [(i, float(i), float(i * 2 + i % 3), "ab"[i % 2], f"t{i}") for i in range(60)]
    df = rows("id BIGINT, x DOUBLE, y_count DOUBLE, kind STRING, name STRING", *data, (60, 300.0, 600.0, "a", "z"),
              (61, 1.0, 3.0, "b", "t1"))
    done = certify(df, "id")
    try:
        v = done.verdict.first()
        assert v["status"] in ("APPROVED", "APPROVED_WITH_WARNINGS") and v["checks_total"] > 10
        assert done.metrics.first()["duplicates_removed"] == 1
        stats = {r["column"]: r for r in done.stats.collect()}
        assert stats["x"]["trend"] == "increasing" and "id" not in stats
        kinds = {r["kind"] for r in done.insights.collect()}
        assert {"strongest_pair", "trend_increasing"} <= kinds
        ids = {r["chart_id"] for r in done.charts.collect()}
        assert {"hist_x", "line_x", "scatter_x_y_count", "pie_kind", "grouped_kind_x"} <= ids
    finally:
        done.release()


def test_scout_rejects_small_tables(rows):
    report = scout(rows("id BIGINT, a STRING, b STRING", (1, "x", None), (2, "y", "z")), "id").first()
    assert not report["is_dataset"]
    assert report["sample_data"][0] == {"a": "x", "b": None}
    assert 0 < report["confidence_score"] <= 0.99
