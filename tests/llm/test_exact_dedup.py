import pytest
from pyspark.sql import functions as F

from sluice.llm.exact_dedup import exact_dedup, maybe_repeated

DOCS = "doc_id bigint, text string"


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def brute(rows):
    least = {}
    for i, t in rows:
        if t is not None:
            least[t] = min(least.get(t, (True, 0)), (i is None, i or 0))
    return sorted([(None if no else i, t) for t, (no, i) in least.items()] + [(i, None) for i, t in rows if t is None], key=str)


@pytest.mark.parametrize("options", [{}, {"bits_per_row": 1, "n_hashes": 1}, {"max_filter_mb": 0}])
def test_like_brute_force(table, rng, options):
    rows = [(i, f"text {rng.randrange(700)} " * rng.randrange(1, 4)) for i in range(1500)]
    rng.shuffle(rows)
    got = kept(exact_dedup(table(rows, DOCS).repartition(5), **options))
    assert got == brute(rows)


def test_filter_has_no_false_negatives_and_few_false_positives(table):
    rows = [(i, f"t{i // 2 if i < 200 else i}") for i in range(4000)]
    out = maybe_repeated(table(rows, DOCS), "text")
    flagged = {r["doc_id"] for r in out.where(out[out.columns[-1]]).collect()}
    assert set(range(200)) <= flagged and len(flagged) < 400


@pytest.mark.parametrize("options", [{}, {"max_filter_mb": 0}])
def test_nulls_ties_and_clashes(table, options):
    rows = [(3, "a"), (1, "a"), (None, "a"), (2, ""), (5, ""), (6, None), (6, None), (7, "b"), (7, "b"), (None, "c"), (8, "A"), (9, "a "), (10, "x" * 300_000), (11, "x" * 300_000)]
    df = table(rows, DOCS, clash=True)
    out = exact_dedup(df, **options)
    assert out.columns == df.columns
    assert kept(out) == brute(rows)
    assert {r["_row"] for r in out.collect()} == {df.first()["_row"]}


def test_rows_with_same_key_and_text_but_other_columns_leave_one(table):
    df = table([(1, "a", "p"), (1, "a", "q")], DOCS + ", x string")
    assert exact_dedup(df).count() == 1


def test_empty(table):
    assert exact_dedup(table([], DOCS)).collect() == []


def test_whole_table_survives_but_for_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = exact_dedup(docs)
    assert out.count() == docs.select("text").distinct().count()
    assert out.agg(F.countDistinct("doc_id")).first()[0] == out.count()


@pytest.mark.parametrize("options", [{}, {"max_filter_mb": 0}])
def test_only_rows_that_may_repeat_are_shuffled(spark, options):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    flagged = maybe_repeated(docs, "text", **options)
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert kept(exact_dedup(docs, **options)) == kept(exact_dedup(docs))


def test_a_group_of_files_at_a_time(spark, table, rng, tmp_path):
    rows = [(i, f"text {rng.randrange(300)}") for i in range(900)]
    table(rows, DOCS).repartition(6).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    flagged = maybe_repeated(docs, "text", max_filter_mb=0)
    assert flagged.count() == 900 and flagged._jdf.queryExecution().optimizedPlan().toString().count("Relation") == len(docs.inputFiles()) > 1
    assert kept(exact_dedup(docs, max_filter_mb=0)) == brute(rows)


def test_text_of_a_third_of_the_rows(table):
    rows = [(i, "same" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    for options in ({}, {"max_filter_mb": 0}):
        assert kept(exact_dedup(table(rows, DOCS).repartition(4), **options)) == brute(rows)
