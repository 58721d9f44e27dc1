from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from sluice.plans.lexer import QueryError
from sluice.plans.timespec import absolute, instant, relative, relative_column, span_seconds, spark_format

NOW = datetime(2024, 3, 31, 13, 45, 30, 500000, UTC)  # a Sunday

CASES = {
    "now": NOW,
    "-1d": datetime(2024, 3, 30, 13, 45, 30, 500000, UTC),
    "-1mon": datetime(2024, 2, 29, 13, 45, 30, 500000, UTC),
    "+1y": datetime(2025, 3, 31, 13, 45, 30, 500000, UTC),
    "-h": datetime(2024, 3, 31, 12, 45, 30, 500000, UTC),
    "@d": datetime(2024, 3, 31, tzinfo=UTC),
    "-1d@h+5m": datetime(2024, 3, 30, 13, 5, tzinfo=UTC),
    "@w0": datetime(2024, 3, 31, tzinfo=UTC),
    "@w1": datetime(2024, 3, 25, tzinfo=UTC),
    "@w7": datetime(2024, 3, 31, tzinfo=UTC),
    "@q": datetime(2024, 1, 1, tzinfo=UTC),
    "-2q@q": datetime(2023, 7, 1, tzinfo=UTC),
    "@y": datetime(2024, 1, 1, tzinfo=UTC),
    "@mon-3hours": datetime(2024, 2, 29, 21, tzinfo=UTC),
}


@pytest.mark.parametrize("text", CASES)
def test_relative(text):
    assert relative(text, NOW) == CASES[text]


def test_relative_column_agrees(spark):
    row = spark.range(1).select(*[F.unix_micros(relative_column(F.lit(NOW).cast("timestamp"), t)).alias(t) for t in CASES]).first()
    for t, want in CASES.items():
        assert row[t] == int(want.timestamp() * 1_000_000), t


@pytest.mark.parametrize("text", ["3h", "-1x", "@bogus", "", "-1d@", "yesterday"])
def test_bad(text):
    with pytest.raises(QueryError):
        relative(text, NOW)


def test_years_are_bounded():
    assert relative("-5000y", NOW).year == 1000


def test_absolute():
    assert absolute("01/02/2024:03:04:05") == datetime(2024, 1, 2, 3, 4, 5, tzinfo=UTC)
    assert absolute("2024-01-02T03:04:05.5+02:00") == datetime(2024, 1, 2, 1, 4, 5, 500000, UTC)
    assert absolute("2024-01-02 03", "%Y-%m-%d %H") == datetime(2024, 1, 2, 3, tzinfo=UTC)
    assert absolute("nonsense") is None


def test_late_bounds_round_up():
    assert instant("latest", "2024-01-02T03:04:05.1Z", None, NOW) == datetime(2024, 1, 2, 3, 4, 6, tzinfo=UTC)
    assert instant("earliest", "1.5", None, NOW).microsecond == 500000


def test_spans_and_formats():
    assert span_seconds("5m") == 300 and span_seconds("mon") == 2592000
    assert spark_format("%Y/%m at %T") == "yyyy/MM 'at' HH:mm:ss"
