from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm.suffix_dedup import common_prefixes, repeated_spans, suffix_array

DOCS = "doc_id bigint, text string"


@given(st.lists(st.integers(1, 3), max_size=60) | st.lists(st.integers(1, 40), max_size=60))
@settings(deadline=None, max_examples=300)
def test_suffix_array(body):
    s = [*body, 0]
    sa = suffix_array(s)
    assert sa == sorted(range(len(s)), key=lambda i: s[i:])
    lcp = common_prefixes(s, sa)
    for k in range(1, len(s)):
        a, b = s[sa[k - 1] :], s[sa[k] :]
        assert lcp[k] == next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)


def test_suffix_array_of_many():
    a = np.random.default_rng(3).integers(1, 4, 20_000)
    a[5000:9000] = a[:4000]
    s = [*a.tolist(), 0]
    sa = np.array(suffix_array(s))
    assert sorted(sa) == list(range(len(s)))
    rank = np.empty(len(s), int)
    rank[sa] = np.arange(len(s))
    x = np.array(s)[sa]
    following = np.append(rank, -1)[sa + 1]
    assert all((x[k], following[k]) < (x[k + 1], following[k + 1]) for k in range(len(s) - 1))


def brute(rows, passage):
    """Every window of every document against all the others'."""
    of = defaultdict(set)
    for i, t in rows:
        w = t.split()
        for a in range(len(w) - passage + 1):
            of[tuple(w[a : a + passage])].add(i)
    out = set()
    for i, t in rows:
        w = t.split()
        cut = []
        for a in range(len(w) - passage + 1):
            if len(of[tuple(w[a : a + passage])]) > 1:
                cut.append(a)
        spans = []
        for a in cut:
            if spans and a <= spans[-1][1]:
                spans[-1][1] = a + passage
            else:
                spans.append([a, a + passage])
        out |= {(i, a, b) for a, b in spans}
    return out


def spans(df):
    rows = df.collect()
    got = [(r["doc_id"], r["start_word"], r["end_word"]) for r in rows]
    assert len(set(got)) == len(got)
    return set(got), rows


@pytest.mark.parametrize("seed", range(4))
def test_like_brute_force(table, prose, seed):
    import random

    rng = random.Random(seed)
    shared = [prose(rng, n, 60) for n in (12, 13, 20, 35, 60)]
    rows = []
    for i in range(150):
        parts = [prose(rng, rng.randint(0, 60), 60)]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), prose(rng, rng.randint(0, 30), 60)]
        rows.append((i, " ".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, "a b " * 40), (203, "a b " * 70), (204, "q " * 90)]
    want = brute(rows, 12)
    got, found = spans(repeated_spans(table(rows, DOCS).repartition(4), passage=12, shard_words=2000))
    assert got == want and len(want) > 100
    words = dict(rows)
    for r in found:  # the first document has at least one passage of the run
        run, first = words[r["doc_id"]].split()[r["start_word"] : r["end_word"]], " " + " ".join(words[r["first_doc_id"]].split()) + " "
        assert r["first_doc_id"] <= r["doc_id"] and any(f" {' '.join(run[k : k + 12])} " in first for k in range(len(run) - 11))


def test_nulls_ties_and_clashes(table, rng, prose):
    p, long = prose(rng, 60), prose(rng, 600_000)
    rows = [(1, p), (2, f"x  {p}\n y"), (2, f"x  {p}\n y"), (None, p), (3, None), (4, ""), (5, "too short"), (6, p + " " + p), (7, long), (8, "start " + long)]
    got, _ = spans(repeated_spans(table(rows, DOCS, clash=True)))
    assert got == {(1, 0, 60), (2, 1, 61), (6, 0, 120), (7, 0, 600_000), (8, 1, 600_001)}


def test_repeats_within_a_document_dont_count(table, rng, prose):
    p = prose(rng, 60)
    assert repeated_spans(table([(1, p + " " + p), (1, p + " " + p), (2, prose(rng, 80, 9999))], DOCS)).collect() == []


def test_empty(table):
    assert repeated_spans(table([], DOCS)).collect() == []


def test_whole_table_like_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got, _ = spans(repeated_spans(docs))
    assert got == brute(rows, 50) and got
