"""A selection of registered queries beside their SQL, and the entry points.

``tools/compare.py`` runs all of them.
"""

import pytest

import __spark_entry__ as entry
from tools.compare import database, rows_of

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "column_stats", "categorical_insights", "top_values", "pearson_pairs_with_gaps", "spearman_trend", "line_fit",
    "drop_duplicate_rows", "fingerprint", "infer_report", "coercion_report", "clean_smart", "impute_forward",
    "quality_scores", "sanity_checks", "verdict", "viewer_score", "histogram_auto", "pie_other", "box_summary",
    "corrupt_mixed", "corrupt_near_duplicates", "features8_by_dataset", "features8_of_cells", "feedback_cap",
    "retrain_points", "stream_feedback", "type_table", "infer_time_formats", "histogram_heavy_tail", "deep_natural_page",
    "deep_page_of_missing", "intensity_ladder_features", "features_augmented", "clean_fitted_on_sample", "corrupt_mixed_realistic",
]


@pytest.fixture(scope="module")
def duck():
    return database(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
