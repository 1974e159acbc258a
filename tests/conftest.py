import pytest

from reportmill.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Applies a column function to rows of arguments and returns the values in order."""

    def run(fn, rows, schema):
        from pyspark.sql import functions as F

        data = [(i, *r) for i, r in enumerate(rows)]
        df = spark.createDataFrame(data, f"row_index int, {schema}")
        cols = [F.col(c) for c in df.columns[1:]]
        return [r[0] for r in df.orderBy("row_index").select(fn(*cols)).collect()]

    return run
