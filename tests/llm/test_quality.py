"""Rules over statistics: their making, their compiled form and how they do on labels held out."""

import math
import zlib

import pytest
from pyspark.sql import functions as F

from dqspark.llm import quality, queries

DESCRIPTION = """RandomForestClassificationModel: uid=x, numTrees=2, numClasses=2, numFeatures=20
  Tree 0 (weight 1.0):
    If (feature 1 <= 7.5)
     If (feature 1 <= 2.5)
      Predict: 0.0
     Else (feature 1 > 2.5)
      Predict: 1.0
    Else (feature 1 > 7.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 19 <= 1.0E-4)
     Predict: 0.0
    Else (feature 19 > 1.0E-4)
     If (feature 1 <= 7.5)
      Predict: 1.0
     Else (feature 1 > 7.5)
      Predict: 0.0
"""
LOW, HIGH = float("-inf"), float("inf")


@pytest.fixture(scope="module")
def model(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return quality.train(docs, labels), docs, labels


def test_paths_become_rules():
    got = {r.bounds for r in quality.rules_of(DESCRIPTION)}
    assert got == {
        (("n_words", LOW, 7.5),), (("n_words", LOW, 2.5),), (("n_words", 2.5, 7.5),), (("n_words", 7.5, HIGH),),
        (("compressed", LOW, 1e-4),), (("compressed", 1e-4, HIGH),),
        (("compressed", 1e-4, HIGH), ("n_words", LOW, 7.5)), (("compressed", 1e-4, HIGH), ("n_words", 7.5, HIGH))}
    assert quality.rules_of("") == []


def test_statistics_by_hand():
    got = dict(zip(quality.STATISTICS, quality.statistics_of("The CAT the the\n\n | ok. 42!\n | ok. 42!\n".encode())))
    assert got["n_words"] == 10 and got["n_lines"] == 3 and got["n_bytes"] == 39
    assert got["distinct_words"] == 0.6 and got["top_word"] == 0.2 and got["repeated_words"] == 0.1
    assert got["upper_words"] == 0.1 and got["capital_words"] == 0.1 and got["bare_words"] == 0.2
    assert got["digits"] == pytest.approx(4 / 26) and got["symbols"] == pytest.approx(2 / 26)
    assert got["repeated_lines"] == pytest.approx(1 / 3) and got["ended_lines"] == pytest.approx(2 / 3)
    for text in ("", " \n\t"):
        assert quality.statistics_of(text.encode()) == [0.0] * len(quality.STATISTICS)


def test_compiled_rules_score_as_plain_ones(model, documents, given):
    ensemble = model[0]
    assert ensemble.rules
    rows = list(given.items()) + [(1000, None), (1001, ""), (1001, ""), (1002, "x" * 200_000), (None, "a b c")]
    got = quality.scored(documents(*rows), ensemble).collect()
    assert got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    want = []
    for d, text in rows:
        values = dict(zip(quality.STATISTICS, quality.statistics_of((text or "").encode())))
        raw = ensemble.bias + sum(w for r, w in ensemble.rules if r.holds(values))
        held = d is None or zlib.crc32(str(d).encode()) % 4 == 2
        want.append((d, held, 1 / (1 + math.exp(-raw))))
    key = lambda r: (r[0] is not None, r[0] or 0)
    for mine, (d, held, score) in zip(sorted(got, key=key), sorted(want, key=key)):
        assert (mine.doc_id, mine.held_out, mine.predicted) == (d, held, int(score >= 0.7))
        assert mine.score == pytest.approx(score, rel=1e-9)


def test_held_out_labels(model):
    ensemble, docs, labels = model
    met = quality.scored(docs, ensemble).join(labels, "doc_id").where("held_out")
    n, right = met.agg(F.count("*"), F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()
    assert n > 60 and right >= 0.95
    assert met.where("quality = 1 AND predicted = 0").count() <= n * 0.03


def test_fit_repeats_itself_and_leaves_held_out_labels_alone(spark, model):
    ensemble, docs, labels = model
    turned = labels.repartition(5).withColumn("quality", F.when(
        quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs.repartition(3), turned) == ensemble


def test_nothing_to_learn(spark, documents):
    label = "doc_id LONG, quality INT"
    rows = [(i, f"text {i}") for i in range(8)]
    none = quality.train(documents(*rows), spark.createDataFrame([], label))
    assert none.rules == () and none.bias == 0
    ones = quality.train(documents(*rows), spark.createDataFrame([(i, 1) for i in range(8)] + [(None, 0), (1, None)], label))
    assert ones.rules == () and ones.bias > 0
    few = quality.train(documents(*rows), spark.createDataFrame([(i, i % 2) for i in range(8)], label))
    assert {r.doc_id for r in quality.scored(documents(*rows), few).collect()} == set(range(8))
    assert quality.scored(documents(), ones).count() == 0


def test_query_scores_every_document(spark):
    got = queries.QUERIES["op11_quality_rules"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 200
