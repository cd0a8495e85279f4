import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from rankfold.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "rankfold-tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *columns):
    """Sorted tuples of a DataFrame's rows."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


@pytest.fixture(scope="session")
def collect():
    return rows


@pytest.fixture(scope="session")
def one(spark):
    """Evaluates a Column function on single values: one(f, *values) -> result."""
    from pyspark.sql import functions as F

    def evaluate(func, *values, schema="string"):
        names = [f"c{i}" for i in range(len(values))]
        df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} {schema}" for n in names))
        return df.select(func(*[F.col(n) for n in names]).alias("r")).head()[0]

    return evaluate


@pytest.fixture(scope="session")
def many(spark):
    """Evaluates a Column function on many values at once."""
    from pyspark.sql import functions as F

    def evaluate(func, values, schema="string"):
        df = spark.createDataFrame(list(enumerate(values)), f"i int, v {schema}")
        return [r[1] for r in sorted(df.select("i", func(F.col("v"))).collect())]

    return evaluate
