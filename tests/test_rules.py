import math

import pytest
from pyspark.sql import functions as F

from dqspark.functions import scalars as S
from dqspark.operators import checks as C, feedback as L, model as M, quality as Q


def one(rows, value, fn):
    return rows("v STRING", (value,)).select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text, want", [
    (" 12 ", 12.0), ("12abc", None), ("nan", None), ("inf", None), ("1e3", 1000.0), ("", None), (None, None)])
def test_numbers(rows, text, want):
    assert one(rows, text, S.to_number) == want


@pytest.mark.parametrize("text, want", [
    ("12abc", 12.0), ("  -3.5kg", -3.5), (".5", 0.5), ("abc", None), ("7.", 7.0), ("", None)])
def test_leading_numbers(rows, text, want):
    assert one(rows, text, S.leading_number) == want


@pytest.mark.parametrize("text, want", [
    ("a|b", "a•b"), ("# title", " # title"), ("- item", " - item"), (None, ""), ("plain", "plain")])
def test_table_cells(rows, text, want):
    assert one(rows, text, S.table_cell) == want


def test_details_and_slugs(rows):
    assert one(rows, "C:\\run|x ['a']", S.detail_text) == "C:/run•x (a)"
    assert one(rows, "__a b/c__", S.slug) == "a_b_c"
    assert one(rows, "!!!", lambda c: S.slug(c, 60, "col")) == "col"
    assert one(rows, "a\r\nb\x00\u200bc\td", S.strip_controls) == "a\nbc\td"


@pytest.mark.parametrize("score, label, accepted", [
    (75.0, 0, True), (45.0, 0, False), (60.0, 2, False), (40.0, 2, True), (50.0, 1, False), (70.0, 1, False),
    (30.0, 3, True), (80.0, 3, False), (70.0, 0, False), (69.0, 0, False), (50.0, 4, False), (10.0, -1, False),
    (-50.0, 2, False), (150.0, 0, False), (float("nan"), 0, False), (float("inf"), 0, False), (None, 2, False)])
def test_feedback_gate(rows, score, label, accepted):
    df = rows("predicted_score DOUBLE, actual_label INT", (score, label))
    assert L.gate(df).first()["accepted"] is accepted


def test_feedback_cap_and_trigger(rows):
    data = [(i, "hot" if i % 3 else f"d{i}", float(i)) for i in range(1, 61)]
    df = rows("id BIGINT, dataset_hash STRING, ts DOUBLE", *data)
    kept = L.first_per_dataset(df).collect()
    assert sorted(r["id"] for r in kept if r["dataset_hash"] == "hot") == [1, 2, 4]
    assert len(kept) == 3 + 20
    points = L.retrain_points(df.select("id"), buckets=8).collect()
    assert sorted(r["feedback_count"] for r in points) == [20, 40, 60]
    assert [r["id"] for r in L.newest(df, 2).collect()] == [60, 59]


def test_training_rows_need_eight_features(rows):
    df = rows("id BIGINT, features ARRAY<DOUBLE>, actual_label INT",
              (1, [0.1] * 8, 3), (2, [], 2), (3, [0.1] * 2, 0), (4, None, 1), (5, [0.2] * 8, 1))
    assert {(r["id"], r["label"]) for r in L.training_rows(df).collect()} == {(1, 1), (5, 0)}
    h = L.health(df).first()
    assert (h["valid_with_features"], h["status"]) == (2, "poor")
    assert L.health(df.where("id < 0")).first()["status"] == "no_data"


@pytest.mark.parametrize("days, want", [(-1, 1.0), (0, 1.0), (45, 0.85), (90, 0.7), (400, 0.7)])
def test_decay(rows, days, want):
    got = rows("h DOUBLE", (days * 24.0,)).select(Q.decay(F.col("h")).alias("d")).first()["d"]
    assert math.isclose(got, want)


def test_verdict_levels(rows):
    schema = "check_id STRING, category STRING, description STRING, passed BOOLEAN, severity STRING, detail STRING"
    def checks(*data):
        return rows(schema, *[(str(i), c, "", p, s, "") for i, (c, p, s) in enumerate(data)])
    good = checks(*[(d, True, "error") for d in C.DIMENSIONS])
    assert C.verdict(good).first().asDict() == {
        "overall_confidence": 0.8, "status": "APPROVED", "checks_passed": 6, "checks_total": 6}
    blocked = checks(("accuracy", False, "error"), ("consistency", True, "info"))
    assert C.verdict(blocked).first()["status"] == "REJECTED"
    warned = checks(*[(d, d != "ml_assessment", "warning") for d in C.DIMENSIONS])
    assert C.verdict(warned).first()["status"] == "APPROVED_WITH_WARNINGS"
    # An unscored category still blocks.
    chart = checks(*[(d, True, "error") for d in C.DIMENSIONS], ("visualization", False, "error"))
    assert C.verdict(chart).first()["status"] == "REJECTED"


@pytest.mark.parametrize("deltas, promoted, reason", [
    ((0.03, 0.03, 0.0), True, "meaningful improvement"), ((0.03, 0.0, 0.0), False, "insufficient improvement"),
    ((0.05, 0.05, -0.02), False, "degradation detected"), ((0.03, 0.03, -0.005), True, "meaningful improvement")])
def test_promotion(rows, deltas, promoted, reason):
    names = ("f1", "balanced_accuracy", "auc_roc")
    row = [0.5] * 3 + [0.5 + d for d in deltas]
    schema = ", ".join([f"current_{n} DOUBLE" for n in names] + [f"candidate_{n} DOUBLE" for n in names])
    got = M.promotion(rows(schema, tuple(row))).first()
    assert (got["promoted"], got["reason"]) == (promoted, reason)


def test_scores_of_an_empty_table(rows):
    df = rows("id BIGINT, a DOUBLE, b STRING", (1, 1.0, "x")).where("id < 0")
    s = Q.quality_scores(df, row_id="id").first()
    assert (s["completeness"], s["uniqueness"], s["outliers"]) == (0.0, 0.0, 0.95)


def test_forms_of_time(rows):
    from dqspark.functions.scalars import parse_timestamp
    from dqspark.operators import schema

    forms = {
        "2023-01-05": "2023-01-05 00:00:00", "2023-01-05T10:00:00": "2023-01-05 10:00:00",
        "2023-01-05T10:00:00.25Z": "2023-01-05 10:00:00.25", "2023-01-05T10:00:00+02:00": "2023-01-05 08:00:00",
        "1/5/2023": "2023-01-05 00:00:00", "1/5/2023 9:07": "2023-01-05 09:07:00",
        "Jan 5, 2023": "2023-01-05 00:00:00", "5 Jan 2023": "2023-01-05 00:00:00",
        "2023/01/05 10:11:12": "2023-01-05 10:11:12", "2023-1-5": "2023-01-05 00:00:00",
        "5-1-2023": "2023-01-05 00:00:00", "2023-01-05 10:11:12.5": "2023-01-05 10:11:12.5",
        "2023": None, "12345678": None, "a long text with 2023 in it that is not a time": None,
    }
    df = rows("t STRING", *[(f,) for f in forms])
    got = {r["t"]: r["s"] for r in df.select("t", parse_timestamp(F.col("t")).cast("string").alias("s")).collect()}
    assert got == forms
    iso = rows("t STRING", ("2023-01-05T10:00:00",), ("2024-02-29T23:59:59.123",), (None,))
    assert schema.infer_report(iso).first()["inferred"] == "datetime"
    assert dict(schema.infer_types(iso).dtypes)["t"] == "timestamp"
