import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column function over one literal row of named texts."""
    from pyspark.sql import functions as F

    def value(function, *args):
        row = spark.range(1).select(*[F.lit(a).alias(f"a{i}") for i, a in enumerate(args)])
        return row.select(function(*[F.col(f"a{i}") for i in range(len(args))]).alias("v")).first()["v"]

    return value
