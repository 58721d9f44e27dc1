import os
import sys
from datetime import UTC, datetime

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


#: Ten events of two source types, an hour apart.
EVENTS = [(datetime(2023, 1, 1, i, 0, 0, tzinfo=UTC), f"raw {i + 1:02d}", "idx_a" if i < 5 else "idx_b", f"stream{i % 2 + 1}", "host", f"127.{i}.{i}.{i}", str(i % 3), i + 1, "o") for i in range(10)]


@pytest.fixture(scope="session")
def events(spark):
    from sluice.sources.events import EVENT_SCHEMA

    return spark.createDataFrame(EVENTS, EVENT_SCHEMA).cache()


@pytest.fixture
def run(spark, events):
    from sluice.engine import Engine

    def go(query, source=None, **options):
        df = Engine(spark, source=events if source is None else source, **options).run(query)
        return df

    return go


@pytest.fixture
def value(spark):
    """The value of an expression over one made row."""
    from sluice.engine import Engine

    def go(expression, **options):
        return Engine(spark, **options).run(f"| makeresults | eval v={expression} | fields v").first()["v"]

    return go
