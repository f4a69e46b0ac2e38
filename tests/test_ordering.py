import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dqspark.functions import ordering as O
from dqspark.operators import profile, relations


@pytest.fixture(scope="module")
def skewed(spark):
    """One value holds a third of the rows; another column has gaps."""
    rng = np.random.default_rng(5)
    n = 6000
    pdf = pd.DataFrame({"id": rng.permutation(n).astype("int64"), "v": rng.normal(size=n).round(2)})
    pdf.loc[pdf.id % 3 == 0, "v"] = 0.25
    pdf["w"] = np.where(pdf.id % 5 == 0, np.nan, pdf.id * 0.5 + rng.normal(size=n))
    df = spark.createDataFrame(pdf).withColumn("w", F.when(~F.isnan("w"), F.col("w")))
    return df, pdf.sort_values("id").reset_index(drop=True)


@pytest.mark.parametrize("bins", [200, 2048])
def test_quantiles_equal_pandas(skewed, monkeypatch, bins):
    df, pdf = skewed
    monkeypatch.setattr(O, "BINS", bins)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = O.quantiles(df, ["v", "w"], shares)
    for n in ("v", "w"):
        assert np.allclose(found[n], pdf[n].quantile(shares), rtol=1e-12)


def test_quantiles_of_heavy_tails(spark):
    """From the largest doubles to the least, rounds stay few because every one cuts the interval."""
    values = [s * 10.0 ** e * (1 + k / 7) for s in (1, -1) for e in range(-300, 300, 40) for k in range(9)]
    values += [0.0, -0.0, 5e-324, 1.7e308, -1.7e308]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    shares = [0.0, 0.03, 0.31, 0.5, 0.77, 1.0]
    assert O.quantiles(df, ["v"], shares)["v"] == pytest.approx(pd.Series(values).quantile(shares).tolist(), rel=1e-12)


def test_column_with_few_values(spark):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 1000 = 7 THEN id * 1.0 - 2500 END AS rare")
    found = O.quantiles(df, ["id", "rare"], [0.5])
    assert found == {"id": [2499.5], "rare": [-493.0]}
    assert relations.trends(df, ["rare"], "id").first()["trend"] == "increasing"


def test_quantiles_of_empty_and_single_value_columns(rows):
    df = rows("a DOUBLE, b DOUBLE, c BIGINT", (None, 4.0, 7), (None, 4.0, 9), (None, None, 8))
    found = O.quantiles(df, ["a", "b", "c"], [0.25, 0.5])
    assert found == {"a": [None, None], "b": [4.0, 4.0], "c": [7.5, 8.0]}


def test_positions_and_forward_fill(skewed):
    df, pdf = skewed
    placed = O.row_positions(df, "id", buckets=16).toPandas().sort_values("id")
    assert (placed.position.to_numpy() == np.arange(len(pdf))).all()
    filled = O.forward_fill(df, ["w"], "id", buckets=16).toPandas().sort_values("id")
    assert np.allclose(filled.w.fillna(-9), pdf.w.ffill().fillna(-9))


def test_known_positions_skip_gaps(skewed):
    df, pdf = skewed
    found = O.known_positions(df, ["v", "w"], "id", buckets=16).toPandas()
    for i, n in enumerate(("v", "w")):
        want = pdf[["id", n]].dropna().assign(position=lambda d: range(len(d)))
        got = found[found.column == i].sort_values("id")
        assert (got.position.to_numpy() == want.position.to_numpy()).all()
        assert (got.known == len(want)).all()


def test_spearman_equals_pandas(skewed):
    df, pdf = skewed
    got = relations.trends(df, ["v", "w"], "id", buckets=16).toPandas().set_index("column")
    for n in ("v", "w"):
        s = pdf[n].dropna().reset_index(drop=True)
        want = s.rank().corr(pd.Series(range(len(s))))
        assert abs(got.rho[n] - want) < 1e-12
    assert got.trend.to_dict() == {"v": "flat", "w": "increasing"}


def test_short_trends_use_the_critical_value(rows):
    up = rows("id BIGINT, v DOUBLE", *[(i, float(i)) for i in range(6)])
    assert relations.trends(up, ["v"], "id").first()["trend"] == "increasing"
    # r = 0.6 with five rows is not significant.
    weak = rows("id BIGINT, v DOUBLE", (0, 2.0), (1, 1.0), (2, 3.0), (3, 5.0), (4, 2.5))
    assert relations.trends(weak, ["v"], "id").first()["trend"] == "flat"
    few = rows("id BIGINT, v DOUBLE", (0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0))
    assert relations.trends(few, ["v"], "id").first()["trend"] is None
    same = rows("id BIGINT, v DOUBLE", *[(i, 7.0) for i in range(9)])
    assert relations.trends(same, ["v"], "id").first()["trend"] == "flat"


def test_critical_values_match_the_t_distribution():
    """The table is checked against a numeric integral of Student's t density."""
    from math import gamma, pi, sqrt

    for i, t in enumerate(relations.T_CRITICAL):
        df = relations.T_FIRST_DF + i
        x = np.linspace(0, t, 20001)
        density = gamma((df + 1) / 2) / (sqrt(df * pi) * gamma(df / 2)) * (1 + x * x / df) ** (-(df + 1) / 2)
        middle = 2 * ((density[1:] + density[:-1]) / 2 * np.diff(x)).sum()
        assert abs(middle - 0.95) < 1e-5


def test_wide_and_long_pairs_agree(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(300, 7)), columns=list("abcdefg"))
    pdf["g"] = 1.0
    pdf.loc[::4, "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("a", F.when(~F.isnan("a"), F.col("a")))
    got = {(r.col_a, r.col_b): r.r for r in relations.pearson_matrix(df).collect()}
    want = pdf.corr()
    for (a, b), r in got.items():
        assert (r is None) == ("g" in (a, b))
        if r is not None:
            assert abs(r - want.loc[a, b]) < 1e-12
    few = {(r.col_a, r.col_b): r.r for r in relations.pearson_matrix(df, ["a", "b", "c"]).collect()}
    assert all(abs(few[k] - got[k]) < 1e-12 for k in few)


def test_column_stats_equal_pandas(skewed):
    df, pdf = skewed
    got = profile.column_stats(df, ["v", "w"]).toPandas().set_index("column")
    for n in ("v", "w"):
        s = pdf[n].dropna()
        q1, q3 = s.quantile([0.25, 0.75])
        out = ((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum()
        assert got.loc[n, ["mean", "median", "std", "q1", "q3"]].tolist() == pytest.approx(
            [s.mean(), s.median(), s.std(), q1, q3], abs=1e-6)
        assert got.outlier_count[n] == out
        assert got.missing_count[n] == pdf[n].isna().sum()
