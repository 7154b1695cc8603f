import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("kept")))
    return session


@pytest.fixture
def rows(spark):
    """Rows of a frame as sorted tuples in the given column order."""

    def collect(df, *columns, digits=6):
        def shown(value):
            return round(value, digits) if isinstance(value, float) else value

        picked = df.select(*columns) if columns else df
        found = [tuple(shown(v) for v in r) for r in picked.collect()]
        return sorted(found, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))

    return collect
