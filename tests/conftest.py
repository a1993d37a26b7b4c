import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """Evaluates an expression over one row of string columns a, b, ..."""

    def run(expression, *values):
        names = [chr(97 + i) for i in range(len(values))]
        df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)) if values else spark.range(1)
        return df.select(expression.alias("x")).first().x

    return run
