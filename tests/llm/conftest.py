import duckdb
import pytest

from dqspark.llm import queries

FOLDER = "/root/testdata/sf0.001"
DOCUMENT = "doc_id LONG, text STRING"


@pytest.fixture
def documents(spark):
    """Make documents from (doc_id, text) rows, with columns whose names operators use inside."""
    def make(*rows):
        plain = spark.createDataFrame(list(rows), DOCUMENT)
        return plain.selectExpr("doc_id", "text", "1 AS n", "'x' AS th", "2 AS node", "3 AS pos", "4 AS digest",
                                "5 AS component", "6 AS rank", "7 AS part", "8 AS keep_id", "9 AS fp")
    return make


@pytest.fixture(scope="session")
def given(spark):
    """The documents of the smallest given tables, as a dictionary."""
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.fixture(scope="session")
def agree(spark):
    """Whether a registered query equals its SQL on the smallest given tables."""
    def check(name, tables):
        con = duckdb.connect()
        for t in tables:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
        want = con.execute(queries.ORACLES[name])
        columns = [d[0] for d in want.description]
        got = queries.QUERIES[name](spark, FOLDER)
        assert sorted(got.columns) == sorted(columns)
        key = lambda r: tuple((v is None, str(v)) for v in r)
        assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)
    return check
