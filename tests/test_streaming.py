import pytest

from sluice.engine import Engine
from sluice.streaming.runner import StreamRunner


@pytest.fixture
def stream(spark, events, tmp_path):
    path = str(tmp_path / "in")
    events.repartition(3).write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def collect(spark, events, stream, query):
    seen = []
    StreamRunner(Engine(spark, source=events)).run(query, stream, lambda df, aggregated: seen.append((df.collect(), aggregated)), 120)
    return seen


def test_aggregate_then_tail(spark, events, stream):
    seen = collect(spark, events, stream, 'index=idx_* | eval x=offset*2 | stats sum(x) AS s count BY sourcetype | sort -num(s) | eval t=s+"!"')
    rows, aggregated = seen[-1]
    assert aggregated and [(r["sourcetype"], r["s"], r["count"], r["t"]) for r in rows] == [("stream2", "60", 5, "60!"), ("stream1", "50", 5, "50!")]


def test_rows_come_newest_first(spark, events, stream):
    seen = collect(spark, events, stream, "index=idx_a | fields _time offset")
    assert sorted(r["offset"] for rows, _ in seen for r in rows) == [1, 2, 3, 4, 5]
    assert all([r["offset"] for r in rows] == sorted((r["offset"] for r in rows), reverse=True) for rows, _ in seen)


def test_timechart_and_predict(spark, events, stream):
    rows, _ = collect(spark, events, stream, "index=* | timechart span=1h count AS n | predict n AS p")[-1]
    assert len(rows) == 15


def test_dedup_with_watermark(spark, events, stream):
    seen = collect(spark, events, stream, "index=* | dedup sourcetype | fields sourcetype")
    assert {r["sourcetype"] for rows, _ in seen for r in rows} == {"stream1", "stream2"}


def test_running_total(spark, events, tmp_path):
    path = str(tmp_path / "one")
    events.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    seen = collect(spark, events, stream, "index=* | accum offset AS total | fields _time offset total")
    assert {(r["offset"], r["total"]) for rows, _ in seen for r in rows} == {(i, str(i * (i + 1) // 2)) for i in range(1, 11)}


def test_running_total_like_the_batch_with_nulls_and_large_numbers(spark, tmp_path):
    from datetime import UTC, datetime

    at = lambda i: datetime(2024, 1, 1, 0, 0, i, tzinfo=UTC)
    rows = [(at(i), i, x, y) for i, (x, y) in enumerate([(2**53 + 1, "1"), (1, "x"), (None, "2.5"), (1, None), (1, "3")])]
    df = spark.createDataFrame(rows, "_time timestamp, offset bigint, x bigint, y string")
    path = str(tmp_path / "one")
    df.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    for query, columns in (("| accum x AS total", ["offset", "x", "y", "total"]), ("| accum y", ["offset", "x", "y"])):
        seen = []
        StreamRunner(Engine(spark, source=df)).run(query, stream, lambda d, aggregated: seen.extend(d.collect()), 120)
        got = sorted([tuple(r[c] for c in columns) for r in seen])
        assert got == sorted(tuple(r[c] for c in columns) for r in Engine(spark, source=df).run(query).collect())
        assert [r[1] for r in got] == [2**53 + 1, 1, None, 1, 1]
