from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.llm.chat import TOKENIZER, encoding
from sluice.llm.packing import best_fit, crossover, evolve, fitness, found, pack

DOCS = "doc_id bigint, text string"


def naive_best_fit(lengths, capacity):
    free, out = [], []
    for x in lengths:
        fits = [b for b, r in enumerate(free) if r >= x]
        if fits:
            b = min(fits, key=lambda b: free[b])
        else:
            b = len(free)
            free.append(capacity)
        free[b] -= x
        out.append(b)
    return free, out


@given(st.lists(st.integers(1, 50), min_size=1, max_size=80))
@settings(deadline=None, max_examples=60)
def test_best_fit(lengths):
    x = np.array(lengths, np.int32)
    of = best_fit(x, np.arange(len(x)), 50)
    free, _ = naive_best_fit(lengths, 50)
    assert sorted(50 - np.bincount(of, x).astype(int)) == sorted(free)


@given(st.lists(st.integers(1, 50), min_size=2, max_size=80), st.integers(0, 99))
@settings(deadline=None, max_examples=60)
def test_crossover_makes_packings(lengths, seed):
    x, rng = np.array(lengths, np.int32), np.random.default_rng(seed)
    a, b = found(x, 50, 2, rng)
    child = crossover(x, a, b, 50, rng)
    assert child.min() >= 0 and np.bincount(child, x).max() <= 50


def test_evolution_never_gets_worse():
    rng = np.random.default_rng(1)
    x = rng.integers(200, 900, 400).astype(np.int32)
    start = found(x, 2048, 4, rng)
    best = evolve(x, start, 2048, 40, rng)
    assert fitness(x, best[0], 2048) >= max(fitness(x, p, 2048) for p in start)
    assert len(np.unique(best[0])) <= len(np.unique(start[0]))


def least_bins(lengths, capacity):
    """The fewest bins there can be, by trying all ways."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def go(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(lengths):
            best = len(free)
            return
        for r in {r for r in free if r >= lengths[i]}:
            free[free.index(r)] -= lengths[i]
            go(i + 1, free)
            free[free.index(r - lengths[i])] += lengths[i]
        go(i + 1, free + [capacity - lengths[i]])

    go(0, [])
    return best


def test_small_packings_are_the_best_there_are():
    rng = np.random.default_rng(4)
    exact = 0
    for _ in range(60):
        x = rng.integers(8, 61, 12).astype(np.int32)
        got = min(len(np.unique(evolve(x, found(x, 100, 8, rng), 100, 48, rng)[0])) for _ in range(4))  # as many islands as pack() has
        least = least_bins(x.tolist(), 100)
        assert least <= got <= least + 1
        exact += got == least
    assert exact >= 57


ENC, _ = encoding(TOKENIZER)


def check(bins, texts, capacity):
    """Every token in one piece of one bin, no bin too full, and the pieces of a document decode to its text. texts has (id, text)."""
    seen = defaultdict(list)
    for r in bins:
        assert r["used"] == sum(r["lengths"]) == len(r["input_ids"]) <= capacity
        at = 0
        for i, s, n in zip(r["doc_ids"], r["starts"], r["lengths"]):
            seen[i].append((s, n, r["input_ids"][at : at + n]))
            at += n
        if r["bin"] is None:
            assert r["used"] == capacity and len(r["doc_ids"]) == 1
    want = {i: t for i, t in texts if i is not None and t}
    assert seen.keys() == want.keys()
    for i, pieces in seen.items():
        pieces.sort()
        assert [s for s, _, _ in pieces] == np.cumsum([0, *(n for _, n, _ in pieces)])[:-1].tolist()
        ids = [x for _, _, own in pieces for x in own]
        assert ids == ENC.encode_ordinary(want[i]) and ENC.decode(ids) == want[i]
    numbers = [(r["shard"], r["bin"]) for r in bins if r["bin"] is not None]
    assert len(numbers) == len(set(numbers))


def test_pack(table, rng, prose):
    rows = [(i, prose(rng, rng.choice([1, 3, 10, 25, 40, 90, 230]))) for i in range(600)]
    bins = pack(table(rows, DOCS).repartition(4), capacity=64, shard_docs=100).collect()
    check(bins, rows, 64)
    assert len({r["shard"] for r in bins}) > 2
    # no worse than best fit decreasing in each shard
    for shard in {r["shard"] for r in bins}:
        own = [r for r in bins if r["shard"] == shard and r["bin"] is not None]
        pieces = sorted((n for r in own for n in r["lengths"]), reverse=True)
        assert len(own) <= len(naive_best_fit(pieces, 64)[0])


def test_same_bins_however_the_rows_lie(table, rng, prose):
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(200)]
    key = lambda r: (r["shard"], r["bin"] is None, r["bin"] or 0, r["doc_ids"], r["starts"])
    one = sorted(pack(table(rows, DOCS).repartition(3), capacity=64).collect(), key=key)
    rng.shuffle(rows)
    assert sorted(pack(table(rows, DOCS).repartition(6), capacity=64).collect(), key=key) == one


def test_whole_table_decodes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(pack(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], 2048)


def test_nulls_ties_and_clashes(table):
    chinese = "春眠不觉晓处处闻啼鸟" * 320
    rows = [(1, "a b c"), (2, None), (3, ""), (4, " \n\t "), (None, "x y"), (5, "a b c"), (6, "w " * 5000), (7, chinese), (8, "x" * 300_000), (9, "<|endoftext|>")]
    bins = pack(table(rows, DOCS, clash=True)).collect()
    check(bins, rows, 2048)
    assert sum(7 in r["doc_ids"] for r in bins) > 1
    twice = pack(table([(1, "a b"), (1, "a b")], DOCS)).collect()
    assert [(r["doc_ids"], r["lengths"]) for r in twice] == [([1, 1], [2, 2])]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a")]])
def test_empty(table, rows):
    assert pack(table(rows, DOCS)).collect() == []


def test_own_shards(table):
    rows = [(i, "x " * i) for i in range(1, 40)]
    bins = pack(table(rows, DOCS), capacity=50, shard=F.col("doc_id") % 3).collect()
    check(bins, rows, 50)
    assert all(str(i % 3) == r["shard"] for r in bins for i in r["doc_ids"])
