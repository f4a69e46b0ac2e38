"""What must hold at any size: one scan per grid, bounded rows per chart and page, repeatable draws."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from catalog import cleaning, learning, tables
from dqspark.operators import charts, clean, corrupt, explore, features, model


def scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.fixture()
def people(spark, tmp_path):
    rows = [(i, float(i % 17) if i % 5 else None, f"t{i % 11}") for i in range(400)]
    spark.createDataFrame(rows, "id LONG, x DOUBLE, t STRING").write.parquet(str(tmp_path / "p"))
    return spark.read.parquet(str(tmp_path / "p"))


def test_grid_is_one_scan_and_equals_each_damage_alone(people):
    grid = corrupt.severity_grid(people, "id")
    assert scans(grid) == 1
    assert grid.select("dataset_id").distinct().count() == 16

    def rows(df):
        return sorted(map(str, df.select("id", "x", "t").collect()))

    def part(name):
        return rows(grid.where(F.col("dataset_id") == name))

    assert part("original") == rows(people)
    assert part("missing_severe") == rows(corrupt.nulls(people, 25.0, "id", 0))
    assert part("duplicates_medium") == rows(corrupt.duplicates(people, 12.0, "id", 1000))
    assert part("outliers_light") == rows(corrupt.outliers(people, 5.0, "id", 2000))
    assert part("inconsistency_severe") == rows(corrupt.column_nulls(people, 25.0, "id", 3000))
    assert part("mixed_medium") == rows(corrupt.mixed(people, 12.0, "id", 4000))


def test_ladder_is_one_scan_and_equals_its_steps(people):
    ladder = corrupt.intensity_ladder(people, "id")
    assert scans(ladder) == 1
    assert ladder.select("dataset_id").distinct().count() == 23
    pct = 100 * (0.15 + (4 / 15) * 0.35)
    step = corrupt.nulls(people, pct * 0.3, "id", 400)
    step = corrupt.duplicates(corrupt.noise(step, pct * 0.2, "id", 420), pct * 0.2, "id", 440)
    made = {r["id"]: (r["x"], r["t"]) for r in ladder.where("dataset_id = 'bad_4'").collect()}
    for r in step.collect():
        x, t = made.pop(r["id"])
        assert t == r["t"] and (x == r["x"] or abs(x - r["x"]) < 1e-9)
    assert not made


def test_variants_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "id LONG, x DOUBLE, t STRING")
    assert corrupt.severity_grid(empty, "id").count() == 0
    assert corrupt.intensity_ladder(empty, "id").count() == 0


def test_augmented_rows_are_repeatable_and_keep_gaps(spark):
    rows = [(f"d{i}", float(i), None if i % 3 else 1.0) for i in range(30)]
    one = spark.createDataFrame(rows, "dataset_id STRING, a DOUBLE, b DOUBLE")
    made = [sorted(map(str, features.augmented(df, ("a", "b"), copies=2).collect()))
            for df in (one, one.repartition(5).orderBy(F.desc("dataset_id")))]
    assert made[0] == made[1] and len(made[0]) == 90
    assert features.augmented(one, ("a", "b"), copies=2).where("b IS NULL").count() == 60


def test_heavy_tail_has_few_histogram_rows(spark):
    values = [random.Random(3).gauss(0, 1) for _ in range(5)] + [i / 100 for i in range(3000)] + [1e9, None]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    rows = sorted(charts.histogram(df, "v").collect())
    filled = [r for r in rows if r["count"]]
    assert sum(r["count"] for r in rows) == len(values) - 1
    assert len(rows) <= 2 * len(filled) and max(r["bins"] for r in rows) > 1_000_000
    # Rows join without holes.
    for a, b in zip(rows, rows[1:]):
        assert a["bin"] + a["bins"] == b["bin"] and a["high"] == pytest.approx(b["low"])
    assert rows[-1]["high"] == pytest.approx(1e9)


def test_histogram_of_none_and_of_one_value(spark):
    empty = spark.createDataFrame([(None,)], "v DOUBLE")
    assert charts.histogram(empty, "v").count() == 0
    same = spark.createDataFrame([(4.0,)] * 3, "v DOUBLE")
    assert [(r["count"], r["low"], r["high"]) for r in charts.histogram(same, "v").collect()] == [(3, 3.5, 4.5)]


@pytest.mark.parametrize("descending", [False, True])
def test_pages_equal_the_sorted_table(spark, descending):
    draw = random.Random(7)
    rows = [(i, draw.choice([None, "a", "b", "c10", "c9", f"k{draw.randint(0, 40)}"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id LONG, k STRING")
    key = explore.natural_key(F.col("k"))
    whole = [r["id"] for r in explore.natural_sort(df, "k", "id", descending).collect()]
    pages = explore.Pages(df, key, "id", descending, range_rows=200)
    for number in (1, 7, 60, 61, 118, 120):
        assert [r["id"] for r in pages.page(number).collect()] == whole[(number - 1) * 25: number * 25]
        assert pages.find((number - 1) * 25, 25)[3] <= 400
    assert [r["id"] for r in pages.page(3, 500).collect()] == whole[1000:1500]
    assert pages.page(121).count() == 0 and pages.page(121).columns == ["id", "k"]


def test_pages_end_where_nothing_can_be_cut(spark):
    df = spark.createDataFrame([(1, "x")] * 50, "id LONG, k STRING")
    pages = explore.Pages(df, F.col("k"), "id", range_rows=10)
    assert pages.page(2).count() == 25 and pages.page(3).count() == 0


def test_sample_is_repeatable_and_fills_everywhere(spark):
    rows = [(i, float(i) if i != 99 else None, "a" if i % 2 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "id LONG, x DOUBLE, t STRING")
    first = {r["id"] for r in clean.bottom_sample(df, "id", 20).collect()}
    again = {r["id"] for r in clean.bottom_sample(df.repartition(7).orderBy(F.desc("id")), "id", 20).collect()}
    assert first == again and len(first) == 20
    cleaned, plan = clean.clean(df, row_id="id", sample_rows=20)
    assert plan.rows_input == 20
    assert cleaned.count() == 100 and cleaned.where("x IS NULL OR t IS NULL").count() == 0
    with pytest.raises(ValueError):
        clean.clean(df, sample_rows=20)


def test_studies_cover_their_grids(spark):
    rows = [(f"d{i}", i % 2, *[float((i * (j + 3)) % 10) / 10 + i % 2 for j in range(8)]) for i in range(60)]
    names = ", ".join(f"{n} DOUBLE" for n in features.FEATURES8)
    df = spark.createDataFrame(rows, f"dataset_id STRING, label INT, {names}")
    swept = model.sweep(df, depths=(2, 5), cs=(0.1, 10.0), trees=5).collect()
    assert {(r["setting"], r["value"]) for r in swept} == {
        ("forest_depth", 2.0), ("forest_depth", 5.0), ("logistic_c", 0.1), ("logistic_c", 10.0)}
    assert all(0 <= r["test_accuracy"] <= 1 for r in swept)
    curve = {r["share"]: r for r in model.learning_curve(df, "dataset_id", shares=(0.5, 1.0), folds=3, numTrees=5, maxDepth=3).collect()}
    assert curve[1.0]["rows"] == 40 and curve[0.5]["rows"] < 40 and curve[1.0]["accuracy"] > 0.9


def test_variants_of_a_small_file_are_made_by_many_tasks(people):
    one = people.coalesce(1)
    assert corrupt.severity_grid(one, "id").rdd.getNumPartitions() > 1
    assert corrupt.intensity_ladder(one, "id").rdd.getNumPartitions() > 1


def test_kept_columns_stay_and_do_not_move_the_damage(people):
    plans = [corrupt.Variant("gaps", 0, "", (("nulls", 30.0, 1),)), corrupt.Variant("far", 0, "", (("outliers", 30.0, 3),))]
    kept = corrupt.variants(people.selectExpr("id", "id % 7 AS owner", "x", "t"), "id", plans, keep=["owner"])
    plain = corrupt.variants(people, "id", plans)
    assert sorted(map(str, kept.drop("owner").collect())) == sorted(map(str, plain.collect()))
    assert kept.where("owner <> id % 7 OR owner IS NULL").count() == 0


def test_measures_within_a_partitioned_key_move_no_cells(people):
    rows = people.selectExpr("CASE WHEN id % 9 = 0 THEN NULL ELSE id % 7 END AS owner", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS part",
                             "CASE WHEN id % 10 = 1 THEN -0.0D WHEN id % 10 = 2 THEN double('nan') ELSE x END AS x", "t").union(
        spark_rows(people))
    inside = features.measures(rows.repartition(8, "owner"), "part", within=["owner"])
    moved = [line for line in inside._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert moved and not any(f"{start}{name}#" in line for line in moved for start in "( " for name in ("number", "text", "x", "t"))
    named = rows.selectExpr("concat(part, '_', owner) AS dataset_id", "x", "t")
    both = [features.features8(m).select("name", *features.FEATURES8) for m in (
        inside.selectExpr("concat(part, '_', owner) AS name", "*").drop("owner", "part"),
        features.measures(named, "dataset_id").withColumnRenamed("dataset_id", "name"))]
    first, second = [sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect()) for df in both]
    assert first == second and len(first) == 14


def spark_rows(people):
    return people.sparkSession.createDataFrame(
        [(1, "a", 0.0, "t1"), (1, "a", 0.0, "t1"), (2, "b", None, None)], "owner LONG, part STRING, x DOUBLE, t STRING")


def test_folds_are_dealt_once_for_the_many_passes_of_a_fit(spark):
    rows = [(f"d{i}", i % 2, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "dataset_id STRING, label INT, x DOUBLE")
    fit, test = model.hold_out(df)
    for part in (fit, test):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Relation [" in plan
        # A pass over few rows is a few tasks, whatever the number of shuffle partitions.
        assert part.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert sorted(r[0] for r in fit.unionByName(test).collect()) == sorted(r[0] for r in rows)
    assert {r["label"]: r["count"] for r in test.groupBy("label").count().collect()} == {0: 6, 1: 6}


def test_downsampling_reads_saved_features(spark):
    drawn = learning.features_downsampled(spark, "/root/testdata/sf0.001")
    assert "l_quantity" not in drawn._jdf.queryExecution().optimizedPlan().toString()
    assert {r["label"]: r["count"] for r in drawn.groupBy("label").count().collect()} == {1: 10, 0: 15}


def test_costly_cells_of_a_small_file_are_made_by_many_tasks(spark):
    folder = "/root/testdata/sf0.001"
    plain, dealt = [tables.from_sql(spark, folder, cleaning.TIMES_SQL, "orders", cells=n) for n in (0, 18)]
    assert dealt.rdd.getNumPartitions() > plain.rdd.getNumPartitions()
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
    plan = cleaning.infer_time_formats(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan
