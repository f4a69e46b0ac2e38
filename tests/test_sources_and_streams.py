import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dqspark.functions.scratch import scratch_folder
from dqspark.functions.settle import settle
from dqspark.operators import clean as K, corrupt as D, explore, features as X, feedback as L, model as M
from dqspark.plans.retrain import retrain
from dqspark.sources import readers as R, sinks
from dqspark.streaming import feedback_stream as W


def test_csv_tokens_order_and_limit(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("id,name\n1,Ann\n2,NA\n3,\n4,\"x, \"\"y\"\"\"\n")
    df = R.read(spark, str(f), row_id="row")
    assert [(r["id"], r["name"]) for r in df.orderBy("row").collect()] == [
        ("1", "Ann"), ("2", None), ("3", None), ("4", 'x, "y"')]
    assert [r["id"] for r in R.read(spark, str(f), row_id="row", max_rows=2).orderBy("row").collect()] == ["1", "2"]


def test_file_row_ids_follow_the_file_over_many_splits(spark, tmp_path):
    f = tmp_path / "long.csv"
    f.write_text("n,pad\n" + "".join(f"{i},{'x' * 40}\n" for i in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = R.read_csv(spark, str(f), row_id="row").orderBy("row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [int(r["n"]) for r in got] == list(range(4000))
    assert len({r["row"] for r in got}) == 4000


def test_file_row_ids_do_not_shuffle_the_scan(spark, tmp_path):
    for k in (1, 0):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    df = spark.read.parquet(str(tmp_path / "part0"), str(tmp_path / "part1"))
    numbered = R.with_file_row_id(df, parquet=True)
    plan = numbered._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [r["id"] for r in numbered.orderBy("row_id").collect()] == list(range(20))
    assert R.file_ranks(spark.range(3)).count() == 0


def test_settled_tables_start_no_job_on_the_data(spark):
    small = settle(spark.range(6).groupBy((F.col("id") % 2).alias("k")).agg(
        F.collect_list(F.struct("id")).alias("l"), F.lit(None).cast("string").alias("nothing")))
    assert "LocalRelation" in small._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["k"], len(r["l"]), r["nothing"]) for r in small.collect()) == [(0, 3, None), (1, 3, None)]
    assert settle(spark.range(0)).collect() == []


def test_tolerant_csv(spark, tmp_path):
    f = tmp_path / "bad.csv"
    f.write_bytes("a,b\n1,caf\xe9\n2,y,z,q\n3,w\n".encode("latin-1"))
    read = R.read_csv(spark, str(f), tolerant=True)
    assert [(r["a"], r["b"]) for r in read.collect()] == [("1", "café"), ("3", "w")]
    assert read.count() == 2 and [r["a"] for r in read.select("a").collect()] == ["1", "3"]


def test_json_shapes(spark, tmp_path):
    def read(name, value):
        f = tmp_path / name
        f.write_text(json.dumps(value, indent=1))
        return R.read(spark, str(f))
    listed = read("list.json", [{"a": 1, "b": {"c": "x", "d": [1, 2]}}, {"a": 2, "b": {"c": "y", "d": []}}])
    assert listed.columns == ["a", "b.c", "b.d"] and listed.count() == 2
    first = read("first.json", {"z": [{"k": 1}, {"k": 2}, {"k": 3}], "a": [9], "m": 1})
    assert first.columns == ["k"] and first.count() == 3
    numbers = read("numbers.json", {"q": [1, 2], "n": {"x": 1}})
    assert [r["value"] for r in numbers.collect()] == [1, 2]
    flat = read("flat.json", {"url": "u", "stats": {"n": 3}})
    assert flat.columns == ["stats.n", "url"] and flat.count() == 1


def test_dispatch(spark, tmp_path):
    f = tmp_path / "table.data"
    f.write_text("a,b\n1,2\n")
    assert R.read(spark, str(f)).columns == ["a", "b"]
    with pytest.raises(ValueError):
        R.read(spark, "https://example.com/a.csv")
    with pytest.raises(ValueError):
        R.read(spark, str(f), fmt="xlsx")


def test_labelled_folder_as_cells(spark, tmp_path):
    for side in ("good", "bad"):
        (tmp_path / side).mkdir()
    (tmp_path / "good" / "g.csv").write_text("a,b,c\n" + "".join(f"{i},{i * i},t{i}\n" for i in range(1, 9)))
    (tmp_path / "bad" / "b.csv").write_text("x,y\n1,\n1,\n1,\nq,5\n")
    (tmp_path / "bad" / "tiny.csv").write_text("x,y\n1,2\n")
    cells = R.read_labelled(spark, {1: str(tmp_path / "good"), 0: str(tmp_path / "bad")})
    assert {(r[0], r[1]) for r in cells.select("dataset_id", "label").distinct().collect()} == {("g.csv", 1), ("b.csv", 0)}
    got = {r["dataset_id"]: r for r in X.features8(X.cell_measures(cells)).collect()}
    assert (got["g.csv"]["num_rows"], got["g.csv"]["num_columns"], got["g.csv"]["numeric_ratio"]) == (8, 3, 2 / 3)
    assert (got["b.csv"]["duplicate_ratio"], got["b.csv"]["missing_ratio"]) == (0.5, 3 / 8)


def test_wide_files_are_read_whole(spark, tmp_path):
    (tmp_path / "w.csv").write_text("\n".join(
        ",".join(f"{p}{i}" for i in range(600)) for p in ("c", "1", "2", "3", "4")) + "\n")
    cells = R.read_labelled(spark, {1: str(tmp_path)})
    assert cells.count() == 2400 and cells.select("col_name").distinct().count() == 600
    assert cells.where("col_name = 'c599'").orderBy("row_id").first()["value"] == "1599"


def test_json_lines_and_row_ids_of_every_format(spark, tmp_path):
    lines = tmp_path / "lines.json"
    lines.write_text("".join(json.dumps({"a": i, "b": {"c": [i]}}) + "\n" for i in range(3)))
    assert [r["a"] for r in R.read(spark, str(lines), row_id="row").orderBy("row").collect()] == [0, 1, 2]
    single = tmp_path / "single.json"
    single.write_text(json.dumps({"z": [{"k": i} for i in range(5)]}))
    got = R.read(spark, str(single), row_id="row", max_rows=3).orderBy("row").collect()
    assert [r["k"] for r in got] == [0, 1, 2]
    listed = tmp_path / "listed.json"
    listed.write_text(json.dumps([{"k": i} for i in range(4)], indent=1))
    assert [r["k"] for r in R.read(spark, str(listed), row_id="row", max_rows=2).collect()] == [0, 1]
    folder = str(tmp_path / "table.parquet")
    spark.range(1000).repartition(5).sortWithinPartitions("id").write.parquet(folder)
    rows = R.read(spark, folder, row_id="row").orderBy("row").collect()
    assert len({r["row"] for r in rows}) == 1000 and sorted(r["id"] for r in rows) == list(range(1000))
    assert R.read(spark, folder, row_id="row", max_rows=7).count() == 7
    sinks.write_result(spark.range(4), str(tmp_path / "own"))
    assert R.read(spark, str(tmp_path / "own"), fmt="json").count() == 4


def test_json_files_are_judged_one_by_one(spark, tmp_path):
    folder = tmp_path / "a b"
    folder.mkdir()
    (folder / "1.json").write_text('{"name": "[x]", "items": [{"k": 1, "v": {"w": 1.5}}, {"k": 2}], "more": [{"k": 9}]}')
    (folder / "2.json").write_text(json.dumps({"z": 1, "more": [{"k": 3}], "items": [{"k": 8}]}, indent=1))
    (folder / "3 lines.json").write_text('{"k": 4, "tags": [1]}\n\n{"k": 5, "tags": [2, 3]}\n')
    (folder / "4.json").write_text('[{"k": 6}, 7, "text"]')
    (folder / "5.json").write_text('{"k": 10, "odd name`": {"OBJECT": "VOID", "x": null}}')
    (folder / "6.json").write_text('{"none": []}')
    got = R.read_json(spark, str(folder), row_id="row").orderBy("row").collect()
    assert [r["k"] for r in got] == [1, 2, 3, 4, 5, 6, None, None, 10]
    assert [r["value"] for r in got if r["value"] is not None] == ["7", "text"]
    assert (got[0]["v.w"], got[3]["tags"], got[8]["odd name`.OBJECT"]) == (1.5, "[1]", "VOID")
    assert len({r["row"] for r in got}) == len(got)
    assert sorted(map(str, R.read_json(spark, str(folder)).drop("value").select("k").collect())) == sorted(
        str(r) for r in R.read_json(spark, str(folder), row_id="row").select("k").collect())
    (folder / "7.json").write_text('{"broken": ')
    with pytest.raises(Exception):
        R.read_json(spark, str(folder)).collect()


def test_a_wide_cell_widens_no_file(spark, tmp_path):
    text = "a," * 10_000
    (tmp_path / "w.csv").write_text("x,y,z\n" + "".join(f'{i},"{text}",q\n' for i in range(3)) + '4,"say ""hi"", ok",,extra\n\n5\n')
    (tmp_path / "n.csv").write_text('"k, 1",l\n' + "1,NA\n" * 5)
    cells = R.read_labelled(spark, {1: str(tmp_path)})
    wide = {(r["row_id"], r["col_name"]): r["value"] for r in cells.where("dataset_id = 'w.csv'").collect()}
    assert sorted(v for (_, c), v in wide.items() if c == "y" and v) == [text] * 3 + ['say "hi", ok']
    assert sorted(str(v) for (_, c), v in wide.items() if c == "z") == ["None", "None", "q", "q", "q"]
    assert {r["col_name"] for r in cells.where("dataset_id = 'n.csv'").collect()} == {"k, 1", "l"}
    assert cells.where("dataset_id = 'n.csv' AND value IS NULL").count() == 5


def test_natural_order_of_long_digit_runs(rows):
    names = ["x9000000000000000000000001", "x10000000000000000000002", "x2", "x010", "X9", "x", "1" + "0" * 40, "9" * 30]
    df = rows("name STRING, id BIGINT", *[(n, i) for i, n in enumerate(names)], (None, 99))
    got = [r["name"] for r in explore.natural_sort(df, "name", "id").collect()]
    assert got == ["9" * 30, "1" + "0" * 40, "x", "x2", "X9", "x010", "x10000000000000000000002",
                   "x9000000000000000000000001", None]


def test_log_and_features_round_trip(spark, tmp_path):
    log = str(tmp_path / "log")
    for i in range(3):
        sinks.append_log(spark.createDataFrame([(f"2024-01-0{i + 1}", i / 10)], "timestamp STRING, cv_score DOUBLE"), log)
    newest = sinks.model_history(sinks.read_log(spark, log), 2).collect()
    assert [r["timestamp"] for r in newest] == ["2024-01-03", "2024-01-02"] and newest[0]["promoted"] is None
    out = str(tmp_path / "out")
    sinks.write(spark.range(3), out, "csv")
    assert spark.read.option("header", True).csv(out).count() == 3
    sinks.write_result(spark.range(2), str(tmp_path / "res"))
    assert spark.read.json(str(tmp_path / "res")).count() == 2


def test_scratch_folder_uses_the_shared_setting(spark):
    assert scratch_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


FEEDBACK_ROW = "id BIGINT, dataset_hash STRING, predicted_score DOUBLE, actual_label INT, features ARRAY<DOUBLE>"
FEEDBACK = [(i, "hot" if i % 3 else f"d{i % 7}", 80.0 if i % 2 else 40.0, 0 if i % 2 else 2, [0.1] * 8) for i in range(60)]


def _arrive(spark, folder, rows):
    spark.createDataFrame(rows, FEEDBACK_ROW).withColumn("ts", F.timestamp_seconds("id")).write.mode("append").parquet(folder)


def _take_in(spark, tmp_path, **options):
    stream = spark.readStream.schema(W.FEEDBACK_SCHEMA).parquet(str(tmp_path / "in"))
    run = W.feedback_intake(stream, str(tmp_path / "out"), str(tmp_path / "state"), **options)
    run.trigger(availableNow=True).start().awaitTermination()


def test_stream_equals_batch_over_many_batches(spark, tmp_path):
    fired = []
    for part in range(4):
        _arrive(spark, str(tmp_path / "in"), FEEDBACK[part * 15 : part * 15 + 15] + [(None, "hot", 80.0, 0, [0.1] * 8)])
        _take_in(spark, tmp_path, every=5, on_retrain=fired.append)
    every = spark.createDataFrame(FEEDBACK, FEEDBACK_ROW).withColumn("ts", F.timestamp_seconds("id"))
    want = L.first_per_dataset(L.gate(every).where("accepted"))
    ids = sorted(r["id"] for r in want.collect())
    assert sorted(r["id"] for r in W.taken_rows(spark, str(tmp_path / "out")).collect()) == ids
    assert fired == list(range(5, len(ids) + 1, 5))
    points = {(r["id"], r["feedback_count"]) for r in W.retrain_points(spark, str(tmp_path / "out")).collect()}
    assert points == {(r["id"], r["feedback_count"]) for r in L.retrain_points(want, 5).collect()}


def test_a_replayed_batch_takes_and_fires_once(spark, tmp_path):
    fired, out = [], str(tmp_path / "out")

    def fails(count):
        if count == 10 and not fired.count(10):
            fired.append(10)
            raise RuntimeError("lost")
        fired.append(count)

    rows = [(i, f"d{i // 2}", 80.0, 0, [0.1] * 8) for i in range(24)]
    for part, chunk in enumerate((rows[:8], rows[8:16], rows[16:])):
        _arrive(spark, str(tmp_path / "in"), chunk)
        if part == 1:
            with pytest.raises(Exception):
                _take_in(spark, tmp_path, every=5, on_retrain=fails)
        _take_in(spark, tmp_path, every=5, on_retrain=fails)
    assert fired == [5, 10, 10, 15, 20]
    assert sorted(r["id"] for r in W.taken_rows(spark, out).collect()) == list(range(24))
    assert sorted(r["feedback_count"] for r in W.retrain_points(spark, out).collect()) == [5, 10, 15, 20]
    # A batch handled to its end, but not marked so by the stream, fires nothing again.
    batch = spark.read.parquet(out + "/rows/batch_id=2")
    assert W.store_batch(spark.createDataFrame(batch.collect(), batch.schema), 2, out, 5) == []
    assert sorted(r["feedback_count"] for r in W.retrain_points(spark, out).collect()) == [5, 10, 15, 20]


def test_intake_calls_back_per_full_batch(spark, tmp_path):
    _arrive(spark, str(tmp_path / "in"), [(i, f"d{i}", 80.0, 0, [0.1] * 8) for i in range(45)])
    fired = []
    _take_in(spark, tmp_path, on_retrain=fired.append)
    assert fired == [20, 40]


def test_late_and_repeated_rows_on_a_stream(spark, tmp_path):
    schema = "id BIGINT, ts TIMESTAMP, v DOUBLE"
    hour = lambda h, i, v: (i, datetime(2024, 1, 1) + timedelta(hours=h), v)
    plan = K.fit(spark.createDataFrame([hour(0, 1, 1.0), hour(1, 2, 3.0), hour(2, 3, None)], schema), K.CleaningProfile(
        fill_missing_strategy="median", drop_duplicates=False, drop_empty_rows=False), "id")
    batches = [[hour(10, 1, 1.0), hour(10, 2, 1.0), hour(11, 3, None)], [hour(20, 4, 4.0), hour(11, 5, 2.0)],
               [hour(2, 6, 9.0), hour(20, 7, 4.0), hour(19, 8, 5.0)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        (W.clean_stream(stream, plan, event_time="ts", delay="2 hours").writeStream.format("parquet")
         .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
         .trigger(availableNow=True).start().awaitTermination())
    got = sorted((r["id"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # 5 repeats the filled 3, 7 repeats 4, 6 is older than the watermark, 8 is late but within the delay.
    assert got == [(1, 1.0), (3, 2.0), (4, 4.0), (8, 5.0)] or got == [(2, 1.0), (3, 2.0), (4, 4.0), (8, 5.0)]


def test_plan_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else float(i), None if i % 5 == 0 else "k") for i in range(40)],
                               "id BIGINT, v DOUBLE, t STRING")
    df.write.parquet(str(tmp_path / "in"))
    rules = K.CleaningProfile(drop_duplicates=False)
    plan = K.fit(df, rules, "id")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = W.clean_stream(stream, plan).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    run.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(K.transform(df, plan).collect())


def test_damage_is_repeatable_and_grows(spark):
    df = spark.range(5000).select("id", (F.col("id") * 1.5).alias("v"), F.col("id").cast("string").alias("t"))
    for make in (D.nulls, D.duplicates, D.outliers, D.text_damage, D.mixed, D.near_duplicates):
        assert sorted(make(df, 10, "id", 1).collect(), key=str) == sorted(make(df, 10, "id", 1).collect(), key=str)
    gaps = [D.nulls(df, p, "id").where("v IS NULL").count() for p in (5, 12, 25)]
    assert gaps[0] < gaps[1] < gaps[2] and abs(gaps[2] - 1250) < 150
    assert D.duplicates(df, 10, "id").select("id").distinct().count() == D.duplicates(df, 10, "id").count()


def test_features_match_pandas(spark):
    pdf = spark.createDataFrame([(1.0, "a", 10.0), (2.0, "b", 10.0), (None, "a", 10.0), (4.0, "a", 10.0), (9.0, None, 10.0), (9.0, None, 10.0)],
                                "x DOUBLE, s STRING, k DOUBLE")
    got = X.features8(X.measures(pdf)).first()
    p = pdf.toPandas()
    cvs = [p.x.std() / p.x.mean(), 0.0]
    assert got["missing_ratio"] == 3 / 18 and got["duplicate_ratio"] == 1 / 6 and got["constant_cols"] == 1
    assert got["numeric_ratio"] == 2 / 3 and abs(got["norm_variance"] - sum(cvs) / 2) < 1e-12
    assert abs(got["skewness"] - abs(p.x.skew()) / 2) < 1e-12
    assert abs(got["mean_kurtosis"] - min(abs(p.x.kurtosis()) / 2 / 10, 1)) < 1e-12
    assert abs(got["cardinality_ratio"] - (4 + 2 + 1) / 3 / 6) < 1e-12


def _separable(spark, rows=80):
    cols = ", ".join(f"CASE WHEN id % 2 = 0 THEN rand({i}) ELSE 1 + rand({i}) END AS {n}" for i, n in enumerate(X.FEATURES8))
    return spark.sql(f"SELECT concat('d', id) AS dataset_id, CAST(id % 2 AS INT) AS label, {cols} FROM range({rows})")


def test_model_learns_and_retrains(spark, tmp_path):
    path = str(tmp_path / "sets")
    _separable(spark).write.parquet(path)
    df = spark.read.parquet(path)
    model = M.train(df, learner=M.forest(numTrees=10, maxDepth=4))
    scored = M.score(model, df)
    assert M.class_metrics(scored).first()["accuracy"] == 1.0
    row = scored.first()
    assert abs(row["probability_good"] + row["probability_bad"] - 1) < 1e-9 and 50 <= row["score"] <= 100
    feedback = spark.sql("SELECT id, CASE WHEN id % 5 = 0 THEN 0 ELSE 3 END AS actual_label, array_repeat(1.2D, 8) AS features FROM range(25)")
    few = retrain(df, feedback.limit(5))
    assert not few.success and "5/20" in few.reason
    done = retrain(df, feedback, model, numTrees=5, maxDepth=3)
    assert done.success and done.log.first()["feedback_samples"] == 25 and not done.promoted


def test_downsampling_keeps_the_ratio(spark):
    df = spark.sql("SELECT concat('d', id) AS k, CAST(id < 20 AS INT) AS label FROM range(200)")
    counts = {r["label"]: r["count"] for r in X.downsampled(df, "k").groupBy("label").count().collect()}
    assert counts == {1: 20, 0: 30}


def test_natural_order(rows):
    df = rows("id BIGINT, v STRING", (1, "item 10"), (2, "item 2"), (3, None), (4, "Item 1"))
    assert [r["id"] for r in explore.natural_sort(df, "v", "id").collect()] == [4, 2, 1, 3]
    assert [r["id"] for r in explore.natural_sort(df, "v", "id", descending=True).collect()] == [1, 2, 4, 3]
