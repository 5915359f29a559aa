import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from cargoscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared").as_uri()
    folders = {"spark.checkpoint.dir": shared, "spark.sql.warehouse.dir": f"{shared}/warehouse"}
    session = local_session("tests", 8, **folders)
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """DataFrame from tuples and a schema text."""
    return lambda schema, *data: spark.createDataFrame(list(data), schema)


@pytest.fixture
def apply(spark):
    """Value of a column expression for each input value."""

    def run(fn, schema, *values):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {schema}")
        out = df.select("i", fn(F.col("c")).alias("r")).orderBy("i").collect()
        return [r["r"] for r in out]

    return run
