from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from sluice.engine import Engine
from sluice.plans.lexer import QueryError


def col(df, name):
    return [r[name] for r in df.collect()]


def test_search_semantics(run):
    assert run("index=idx_a raw*01").count() == 0  # an inner star is literal
    assert run('index=IDX_A "RAW 0"').count() == 5
    assert run("index=idx_* NOT sourcetype=stream1").count() == 5
    assert run("index=* source=127.3.3.*").count() == 1
    assert run("index=idx_a offset>3 OR offset=1").count() == 3
    assert run("host=ho").count() == 10  # a prefix is enough
    assert run("index IN (idx_b)").count() == 5
    assert run("earliest=2023-01-01T03:00:00 latest=2023-01-01T05:00:00").count() == 2


def test_subsearch(run):
    assert sorted(col(run("index=* [ search offset<3 | fields _raw ]"), "offset")) == [1, 2]
    assert run("index=* [ search offset>100 | fields _raw ]").count() == 0
    assert run("index=* NOT [ search offset<3 | fields _raw ]").count() == 8


def test_fields_and_table(run):
    assert run("index=* | fields off* _raw").columns == ["offset", "_raw"]
    assert run("index=* | fields - _*").columns[0] == "index"
    assert run("index=* | table source nothing index").columns == ["source", "index"]
    assert run("index=* | table nothing").columns == []
    for q in ("fields nothing",):
        with pytest.raises(QueryError):
            run(f"index=* | {q}")


def test_rename_strcat_fillnull(run):
    r = run('index=* offset=1 | rename offset AS o, none AS n | strcat index "-" o out | strcat allrequired=true index none gone | fillnull value=x gone').first()
    assert r["out"] == "idx_a-1" and r["gone"] == "x"


def test_replace(spark, run):
    df = spark.createDataFrame([("?$.data^){", "lost")], "_raw string, host string")
    assert run('* | replace "?$.data*" WITH "SomethingNew*" IN _raw', df).first()["_raw"] == "SomethingNew^){"
    assert run('* | replace "*data*" WITH "*SomethingNew*" IN _raw', df).first()["_raw"] == "?$.SomethingNew^){"
    assert run("* | replace lost WITH found", df).first()["host"] == "found"


def test_rex(spark, run):
    df = spark.createDataFrame([('{"rainfall_rate": 139.875}',), ("none",), (None,)], "_raw string")
    assert col(run('| rex ".*rainfall_rate\\":\\s(?<rain_FALL>\\d+.\\d+)"', df), "rain_FALL") == ["139.875", None, None]
    assert run('| rex mode=sed "s;rainfall_rate;meltdown_rate;g"', df).first()["_raw"] == '{"meltdown_rate": 139.875}'
    assert run('| rex mode=sed "s/a/X/2g"', spark.createDataFrame([("banana",)], "_raw string")).first()[0] == "banXnX"
    assert run('| rex mode=sed "s/a/X/2"', spark.createDataFrame([("banana",)], "_raw string")).first()[0] == "banXna"
    for bad in ('mode=sed "rainfall"', '"no group"'):
        with pytest.raises(QueryError):
            run(f"| rex {bad}", df)


@pytest.mark.parametrize("text, want", [("329abc", "329"), ("329.45abc", "329.45"), (".54e2abc", ".54E2"), ("-0.54e2abc", "-0.54E2"), ("-0.21.54e2abc", ""), ("+21.54e23abc", "+21.54E23"), ("+21.54e-23abc", "+21.54E-23"), ("+21.54e+23abc", "+21.54E+23")])
def test_rmunit(spark, run, text, want):
    assert run("| convert rmunit(x)", spark.createDataFrame([(text,)], "x string")).first()["x"] == want


def test_convert(spark, run):
    df = spark.createDataFrame([("12:34:56", "1,000", "2m", "02:03.5", "3.50", "x")], "dur string, c string, m string, ms string, n string, w string")
    r = run('| convert dur2sec("dur|offset") AS s rmcomma(c) memk(m) mstime(ms) auto(n) num(w)', df).first()
    assert (r["s"], r["c"], r["m"], r["ms"], r["n"], r["w"]) == ("45296", "1000", "2048.0", "123500", "3.5", None)
    with pytest.raises(Exception, match="no duration"):
        run("| convert dur2sec(w)", df).collect()


def test_rangemap(spark, run):
    df = spark.createDataFrame([("-10",), ("0",), ("10",), ("35",), ("47.2",), ("word",)], "_raw string")
    assert col(run("| rangemap field=_raw lo=0-5 med=6-34 hi=35-48 vlo=-20--10", df), "range") == [["vlo"], ["lo"], ["med"], ["hi"], ["hi"], ["None"]]


def test_spath_and_xmlkv(spark, run):
    df = spark.createDataFrame([('{"json":"debugo","lil":"xml"}',), ("<main><sub>1</sub></main>",), ("bad",)], "_raw string")
    got = run("| spath", df)
    assert got.columns == ["_raw", "json", "lil", "sub"]
    assert [tuple(r)[1:] for r in got.collect()] == [("debugo", "xml", ""), ("", "", "1"), ("", "", "")]
    assert run("| spath output=o path=json", df).first()["o"] == "debugo"
    assert run("| xmlkv", df).columns == ["_raw", "sub"]


def test_format(spark, run):
    df = spark.createDataFrame([("1", ["x", "y"])], "a string, m array<string>")
    assert run("| format", df).first()["search"] == '( ( a="1" AND ( m="x" OR m="y" )  ) ) '


def stats_rows(spark):
    times = [datetime(2001 + i, 1, 1, tzinfo=UTC) for i in range(11)] + [datetime(2011, 1, 1, 0, 0, 1, tzinfo=UTC)]
    return spark.createDataFrame([(t, o, "idx") for t, o in zip(times, [*range(1, 12), 11])], "_time timestamp, offset bigint, index string")


def test_aggregate_goldens(spark, run):
    r = run("| stats exactperc50(offset) AS e perc50(offset) AS p earliest(offset) AS f latest(offset) AS l values(offset) AS v list(offset) AS li mode(offset) AS m stdev(offset) AS s stdevp(offset) AS sp sum(offset) AS t dc(offset) AS d", stats_rows(spark)).first()
    assert r["e"] == 6.5 and r["p"] == 6 and (r["f"], r["l"]) == ("1", "11")
    assert r["v"] == "1\n10\n11\n2\n3\n4\n5\n6\n7\n8\n9" and r["li"] == "\n".join(map(str, [*range(1, 12), 11]))
    assert r["m"] == "11" and r["t"] == "77" and r["d"] == 11
    assert abs(r["s"] - 3.4761089357690347) < 1e-12 and abs(r["sp"] - 3.3281209246193093) < 1e-12


def test_percentiles_are_values_at_their_places(spark, run):
    df = spark.range(120_000).selectExpr("id * 7919 % 120000 AS n", "cast(id % 100 AS string) AS s", "id * 7919 % 120000 + 9007199254740993L AS big", "id * 7919 % 120000 - 60000 + if(id * 7919 % 120000 < 60000, -9007199254740993L, 9007199254740993L) AS both")
    r = run("| stats perc50(n) AS a p95(n) AS b upperperc99.9(n) AS c perc0.01(n) AS d perc7(s) AS e perc50(big) AS f perc100(big) AS g perc25(both) AS h perc75(both) AS i", df).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == (59_999, 113_999, 119_879, 11, 6.0)
    assert (r["f"], r["g"]) == (59_999 + 2**53 + 1, 119_999 + 2**53 + 1)
    assert (r["h"], r["i"]) == (29_999 - 60_000 - 2**53 - 1, 89_999 - 60_000 + 2**53 + 1)


def test_aggregates_of_texts_and_lists(spark, run):
    df = spark.createDataFrame([("3", ["1", "x"]), ("2.5", ["2", "3.5"]), ("word", None), (None, [])], "s string, m array<string>")
    r = run("| stats sum(s) AS a sum(m) AS b min(s) AS lo max(s) AS hi avg(s) AS av count(s) AS n mode(nothing) AS mo", df).first()
    assert (r["a"], r["b"], r["lo"], r["hi"], r["av"], r["n"], r["mo"]) == ("5.5", "6.5", "2.5", "word", 2.75, 3, "")


def test_stats_is_sorted_and_capped(run):
    assert col(run("index=* | stats count BY offset", recall_size=3), "offset") == [1, 2, 3]


def test_timechart_fills(run):
    out = run("index=* sourcetype=stream1 | timechart span=1h count(_raw) AS craw BY sourcetype").collect()
    assert len(out) == 9 and [r["craw"] for r in out[:3]] == [1, 0, 1] and out[1]["sourcetype"] == "0"
    assert run("index=* earliest=2023-01-01T00:00:00 latest=2023-01-01T00:30:00 | timechart span=1min count").count() == 31


def test_eventstats(run):
    assert set(col(run("index=* | eventstats avg(offset) AS a"), "a")) == {5.5}
    got = run("index=* | eventstats avg(offset) AS a BY sourcetype")
    assert got.columns[-1] == "a" and {(r["sourcetype"], r["a"]) for r in got.collect()} == {("stream1", 5.0), ("stream2", 6.0)}


def test_dedup_options(spark, run):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a"), (5, None), (6, None)], "offset bigint, x string")
    assert sorted(col(run("| dedup x", df), "offset")) == [1, 3, 5]
    assert sorted(col(run("| dedup 2 x", df), "offset")) == [1, 2, 3, 5, 6]
    assert sorted(col(run("| dedup x keepempty=true", df), "offset")) == [1, 3, 5, 6]
    assert sorted(col(run("| dedup x consecutive=true", df), "offset")) == [1, 3, 4, 5]
    assert sorted(col(run("| dedup x sortby -num(offset)", df), "offset")) == [3, 4, 6]
    assert run("| dedup x keepevents=true", df).count() == 6


def test_addtotals(spark, run):
    df = spark.createDataFrame([(x, 1) for x in ("-10", "0", "10", "35", "47.2")], "_raw string, offset bigint")
    assert col(run("| addtotals", df), "Total") == ["-9.0", "1.0", "11.0", "36.0", "48.2"]
    out = run("| addtotals col=true row=false", df).collect()
    assert len(out) == 6 and out[-1]["_raw"] == "82.2" and out[-1]["offset"] == "5"


def test_accum(spark, run):
    df = spark.createDataFrame([(datetime(2020, 1, 1, i, tzinfo=UTC), x) for i, x in enumerate(["-10", "0", "10", "35", "47.2"])], "_time timestamp, _raw string")
    assert col(run("| accum _raw", df), "_raw") == ["-10", "-10", "0", "35", "82.2"]
    df = spark.createDataFrame([(datetime(2020, 1, 1, i, tzinfo=UTC), x) for i, x in enumerate(["10", "string", "100", "another_string", "55.0"])], "_time timestamp, _raw string")
    assert col(run("| accum _raw", df), "_raw") == ["10", "string", "110", "another_string", "165.0"]
    assert col(run("| accum _raw AS s", df), "s") == ["10", None, "110", None, "165.0"]


def test_running_sum_by_pieces_is_exact(spark):
    from sluice.operators.aggregate import running_sums

    df = spark.range(5000).select(F.timestamp_seconds(F.col("id") * 37 % 997).alias("_time"), F.col("id").alias("offset"), (F.col("id") % 11 - 5).alias("x"))
    rows = running_sums(df, s=F.col("x")).orderBy("_time", "offset").collect()
    total = 0
    for r in rows:
        total += r["x"]
        assert r["s"] == total


def test_predict(run):
    out = run("index=* | timechart span=1h avg(offset) AS avgo | predict avgo AS pred upper 98=u98 lower 98=l98")
    assert out.columns == ["_time", "avgo", "pred", "u98(pred)", "l98(pred)"]
    rows = out.collect()
    assert len(rows) == 15 and [r["avgo"] for r in rows[-5:]] == [None] * 5
    k = 2.0 / 3.22
    assert abs(rows[0]["pred"] - (5.5 + k * (1 - 5.5))) < 1e-12
    with pytest.raises(QueryError, match="requires a preceding aggregate"):
        run("index=* | predict offset AS p")
    with pytest.raises(QueryError):
        run("index=* | timechart span=1h count AS c | predict c AS p algorithm=BILL")


def test_sort(run):
    assert col(run("index=* | sort + auto(offset) desc"), "offset") == list(range(10, 0, -1))
    assert col(run("index=* | sort 10 + str(offset)"), "offset") == [1, 10, 2, 3, 4, 5, 6, 7, 8, 9]
    assert col(run("index=* | sort - ip(source)"), "source")[0] == "127.9.9.9"
    assert run("index=* | sort offset", recall_size=4).count() == 4


def test_addresses_sort_by_their_four_numbers(spark, run):
    given = ["10.0.1499.7", "10.0.1000.12", "10.0.999.200", "10.0.1499.12", "10.0.70000.1", "10.1.0.0", "9.0.0.1", "no address"]
    want = ["no address", "9.0.0.1", "10.0.999.200", "10.0.1000.12", "10.0.1499.7", "10.0.1499.12", "10.0.70000.1", "10.1.0.0"]
    df = spark.createDataFrame([(g,) for g in given], "a string")
    assert col(run("| sort + ip(a)", df), "a") == want
    assert col(run("| sort - ip(a)", df), "a") == want[::-1]
    assert col(run("| sort + auto(a)", df), "a") == [*want[1:], want[0]]


def test_join(run):
    sub = '[ search index=* | eval a=case(offset<2,"1",offset<3,"2",offset>2,"1") ]'
    rows = run(f"index=* | join type=left max=3 offset {sub} | sort offset").collect()
    assert [r["R_a"] for r in rows] == ["1", "2", "1"] + [None] * 7
    assert run(f"index=* | join max=0 offset {sub}").count() == 10
    assert run("index=* | join usetime=true earlier=false max=0 host [ search offset>8 ]").count() == 19
    assert "R__raw" in run("index=* | join max=0 overwrite=false offset [ search offset>8 ]").columns
    for q in ("nothing [ search offset=1 ]", "offset [ search offset=1 | fields host ]"):
        with pytest.raises(QueryError):
            run(f"index=* | join {q}")


def test_top_and_makeresults(run):
    assert run("index=* | top 3 host").count() == 3
    out = run("| makeresults count=4 annotate=true")
    assert out.count() == 4 and out.columns[0] == "_time" and len(out.columns) == 7


def test_delivery(spark, events):
    e = Engine(spark, source=events, recall_size=3)
    seen = []
    out = e.deliver("index=*", lambda df, aggregated: seen.append(aggregated))
    assert [r["offset"] for r in out.collect()] == [10, 9, 8] and seen == [False]
    assert e.latest_time("index=idx_a").first()["latest"].hour == 4


def test_files(spark, run, tmp_path):
    path = str(tmp_path / "x")
    assert run(f'index=* | stats count(offset) BY index | p exec hdfs save "{path}"').first()["_raw"] == "HDFS save complete."
    with pytest.raises(QueryError):
        run(f'index=* | p exec hdfs save "{path}"')
    assert run(f'| p exec hdfs load "{path}"').columns == ["index", "count(offset)"]
    run(f'index=* | p exec hdfs save "{path}" overwrite=true format=csv')
    got = run(f'| p exec hdfs load "{path}"')
    assert got.count() == 10 and dict(got.dtypes)["offset"] == "bigint"
    assert {r["name"] for r in run(f'| p exec hdfs list "{path}"').collect()} == {"data", "description.json"}
    assert run(f'| p exec hdfs list "{path}/none"').count() == 0
    assert run(f'| p exec hdfs delete "{path}"').first()["success"]
    assert not run(f'| p exec hdfs delete "{path}"').first()["success"]


def test_config(spark, events):
    e = Engine(spark, source=events, config={"flag": True})
    e.run("| p set config flag false")
    assert e.config["flag"] is False
    with pytest.raises(QueryError):
        e.run("| p set config nothing 1")
    with pytest.raises(QueryError):
        e.run("| p set config recall-size many")


def test_bloom_filters_hold_their_tokens(spark, run):
    import math

    rows = run("index=* | p exec tokenizer | p exec bloom create").collect()
    assert {r["partition"] for r in rows} == {"0", "1", "2"}
    bits = int.from_bytes(rows[0]["filter"], "little")
    assert 0 < bin(bits).count("1") <= 12 * round(-math.log(0.01) / math.log(2))


def test_plans_stay_in_the_jvm(run):
    plan = run('index=* | eval a=offset*2+1, b=if(a>3,"x",_raw), c=spath(_raw,"k") | stats sum(a) dc(b) BY sourcetype')._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "BatchEvalPython" not in plan


def test_filters_reach_the_scan(spark):
    from sluice.sources.events import TableCatalog

    e = Engine(spark, TableCatalog(spark, "/root/testdata/sf0.001"))
    plan = e.run("index=events event_type=click earliest=2024-01-05T00:00:00 | fields event_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp,event_type:string>" in plan.replace("timestamp_ntz", "timestamp")


INNER = ["_n", "_x", "_new", "_last", "_piece", "_end", "_before", "_before0", "_sum", "_shown", "_parts", "_whole", "_all", "_by0", "_window", "_at", "_row", "_k0", "_s"]


@pytest.mark.parametrize("query", ["accum offset AS total", "accum partition", "dedup 2 sourcetype", "dedup sourcetype", "dedup sourcetype consecutive=true", "dedup host sortby -num(offset)", "eventstats count AS n BY sourcetype", "timechart span=1h count AS n BY _at _window", "join max=0 offset [ search index=idx_a | table offset source ]"])
def test_inner_names_leave_columns_alone(spark, events, run, query):
    from pyspark.sql import functions as F

    wide = events.withColumns({c: F.lit(f"user {c}") for c in INNER})
    out = run(f"index=* | {query}", source=wide)
    rows = out.collect()
    assert rows and all(r[c] in (f"user {c}", "0") for r in rows for c in INNER if c in out.columns)
    if not query.startswith("timechart"):
        assert set(INNER) <= set(out.columns)
        plain = run(f"index=* | {query}").select("offset").collect()
        assert len(plain) == len(rows)
