import importlib.util

import numpy as np
import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline", allow_module_level=True)

import corpus_pipeline  # noqa: E402
from sluice.llm.chat import TOKENIZER, encoding  # noqa: E402
from sluice.llm.common import materialize  # noqa: E402
from sluice.llm.simhash import MAX_DISTANCE, blocks, distances, fingerprints  # noqa: E402

ENC, _ = encoding(TOKENIZER)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BAD = "vile scum filth rot"


@pytest.fixture
def folder(spark, rng, prose, tmp_path):
    """Clean, toxic, copied and nearly copied documents, and odd rows."""
    rows = [(i, prose(rng, rng.randint(40, 400), 20_000)) for i in range(300)]
    toxic = [(1000 + i, f"{prose(rng, 60, 20_000)} {BAD} {BAD} {prose(rng, 30, 20_000)}") for i in range(150)]
    copies = [(2000 + i, rows[i][1]) for i in range(40)]
    near = [(3000 + i, f"{rows[i + 50][1]} changed{i}") for i in range(40)]
    odd = [(4000, None), (4001, ""), (None, "a document without an id"), (4002, prose(rng, 9000, 20_000))]
    full = [(i, t, "xx", f"src{(i or 0) % 3}", len(t or "")) for i, t in [*rows, *toxic, *copies, *near, *odd]]
    spark.createDataFrame(full, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in rows[:200]] + [(i, 0, 1) for i, _ in toxic[:100]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids, columns, names = {}, docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        names.append(name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            docs = materialize(out)
            ids[name] = sorted(r["doc_id"] for r in docs.where("doc_id IS NOT NULL").select("doc_id").collect())
        else:
            bins = out.collect()
    assert names == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    clean = {*range(300), *range(2000, 2040), *range(3000, 3040), 4000, 4001, 4002}
    assert len(clean - set(ids["toxicity"])) <= 3 and len(set(ids["toxicity"]) - clean) <= 3
    assert not {i for i in ids["exact dedup"] if 2000 <= i < 2040 and i - 2000 in ids["toxicity"]}
    assert set(ids["near dedup"]) == {i for i in ids["exact dedup"] if not (3000 <= i < 3040 and i - 2950 in ids["toxicity"])}
    assert ids["mixing"] == ids["near dedup"]
    length = {r["doc_id"]: len(ENC.encode_ordinary(r["text"] or "")) for r in docs.collect() if r["doc_id"] is not None}
    packed = {}
    for r in bins:
        assert r["used"] == sum(r["lengths"]) == len(r["input_ids"]) <= 2048
        for i, n in zip(r["doc_ids"], r["lengths"]):
            packed[i] = packed.get(i, 0) + n
    assert packed == {i: n for i, n in length.items() if n}


def test_near_copies_without_a_shared_block_go(spark, table, rng, prose):
    rows, own = [], blocks(16)
    while len(rows) < 12:
        words = prose(rng, 150, 20_000).split()
        other = [f"edit{rng.randrange(10**6)}" if rng.random() < 0.1 else w for w in words]
        texts = [" ".join(words), " ".join(other)]
        a, b = fingerprints(texts)
        digits = np.unpackbits((a ^ b).astype(">i8").view(np.uint8)).reshape(96, 4).any(axis=1)
        if distances(a, b) <= MAX_DISTANCE and digits[own].any(axis=1).all():
            rows += [(len(rows) + k, t, "xx", "s", len(t)) for k, t in enumerate(texts)]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, table(rows, DOCS), "").collect()) == list(range(0, 12, 2))


def test_run_gives_what_the_stages_give(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder))
    # only the names of the files, and so of the shards, may differ
    key = lambda df: sorted((sorted(r["doc_ids"]), r["used"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, folder)) == key(corpus_pipeline.STAGES[-1][1](spark, docs, folder))


def test_packing_with_clashing_columns_and_without_files(spark, table, tmp_path):
    df = table([(i, f"a b c {i}", "xx", "s", 9) for i in range(50)], DOCS, clash=True).drop("a map")
    df.write.parquet(f"{tmp_path}/mixed")
    for docs in (spark.read.parquet(f"{tmp_path}/mixed"), df):
        bins = corpus_pipeline.packed(spark, docs, "").collect()
        assert sorted(i for r in bins for i in r["doc_ids"]) == list(range(50)) and sum(r["used"] for r in bins) == sum(len(ENC.encode_ordinary(f"a b c {i}")) for i in range(50))


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_sql(spark):
    import duckdb

    from sluice.llm import registry

    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in registry.SQL.items():
        df, found = registry.QUERIES[name](spark, sf), con.sql(sql)
        assert sorted(df.columns) == sorted(found.columns)
        got = sorted(tuple(r[c] for c in found.columns) for r in df.collect())
        assert got == sorted(found.fetchall())


def test_all_on_an_empty_documents_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
