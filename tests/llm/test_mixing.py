from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm.mixing import apportion, block_slots, edf_period, mix, schedule

DOCS = "doc_id bigint, text string, source string"


@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(1, 40), min_size=1, max_size=8))
@settings(deadline=None, max_examples=60)
def test_less_than_one_block_from_the_weight_at_every_slot(shares):
    length, slots = sum(shares.values()), edf_period(shares)
    assert sorted(x for s in slots.values() for x in s) == list(range(length))
    for s, own in slots.items():
        done = 0
        for t in range(length):
            done += t in own
            assert abs(done - (t + 1) * shares[s] / length) < 1


@given(st.dictionaries(st.sampled_from("abcdefgh"), st.floats(0.001, 1000), min_size=1), st.integers(1, 500))
@settings(deadline=None, max_examples=60)
def test_apportion(weights, parts):
    got = apportion(weights, parts)
    n, total = max(parts, len(weights)), sum(weights.values())
    assert sum(got.values()) == n and min(got.values()) >= 1
    if n > 100 * len(weights):
        assert all(abs(c - n * weights[s] / total) < len(weights) + 1 for s, c in got.items())


def test_schedule_places_all_blocks():
    blocks = {"a": 1003, "b": 17, "c": 240, "z": 5, "none": 0}
    phases = schedule(blocks, {"a": 3.0, "b": 1.0, "c": 2.0}, 60)
    slots = Counter()
    for s, lo, hi, first, c, length, offsets in phases:
        slots.update(first + (k // c) * length + offsets[k % c] for k in range(hi - lo))
    assert set(slots) == set(range(sum(blocks.values()))) and set(slots.values()) == {1}


def ordered(df, source="source"):
    slot, rank = df.columns[-2:]
    return [(r[slot], r[rank], r[source], r["doc_id"]) for r in df.collect()]


@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.3, None: 0.2}])
def test_order_and_deviation(table, rng, weights):
    rows = [(i, f"t{i}", rng.choices(["a", "b", None], [20, 3, 6])[0]) for i in range(3000)]
    out = mix(table(rows, DOCS).repartition(5), weights=weights, block_docs=4, resolution=100)
    got = ordered(out)
    assert got == sorted(got, key=lambda x: x[:2])  # the order of partitions and rows is the mixed one
    assert sorted(x[3] for x in got) == list(range(3000))
    size = Counter(s for _, _, s in rows)
    total = {s: (weights[s] if weights else n**0.5) for s, n in size.items()}
    parts = apportion({("null" if s is None else f"={s}"): w for s, w in total.items()}, 100)
    share = {s: parts["null" if s is None else f"={s}"] / 100 for s in size}
    last = {s: max(x[0] for x in got if x[2] == s) for s in size}
    source_of = {x[0]: x[2] for x in got}
    done = Counter()
    for slot in range(min(last.values())):
        done[source_of[slot]] += 1
        assert all(abs(done[s] - (slot + 1) * share[s]) < 1 for s in size)
    for s in size:
        blocks = Counter(x[0] for x in got if x[2] == s)
        assert sorted(blocks.values())[1:] == [4] * (len(blocks) - 1)


def test_same_result_however_the_rows_lie(table, rng):
    rows = [(i, f"t{i}", rng.choice("ab")) for i in range(500)]
    one = ordered(mix(table(rows, DOCS).repartition(3)))
    rng.shuffle(rows)
    assert ordered(mix(table(rows, DOCS).repartition(7))) == one


def test_nulls_ties_and_clashes(table):
    rows = [(1, "a", "x"), (1, "a", "x"), (None, None, None), (None, "", ""), (2, "z" * 200_000, "null"), (3, "b", None)]
    df = table(rows, DOCS, clash=True)
    out = mix(df, block_docs=1)
    assert out.columns[:-2] == df.columns and out.count() == 6
    assert {r["_slot"] for r in out.collect()} == {df.first()["_slot"]}
    assert sorted(r[out.columns[-2]] for r in out.collect()) == list(range(6))


def test_empty(table):
    assert mix(table([], DOCS)).collect() == []


def test_sources_without_weight_come_last(table):
    rows = [(i, "t", "ab"[i % 2]) for i in range(64)]
    got = ordered(mix(table(rows, DOCS), weights={"a": 1.0}, block_docs=4))
    assert [x[2] for x in got] == ["a"] * 32 + ["b"] * 32


def worst(blocks, weights, slots):
    """The greatest distance of any source from its target weight, in blocks, over the first slots; none may run out before."""
    place = {x: s for s, own in block_slots(blocks, weights, None).items() for x in own}
    assert sorted(place) == list(range(sum(blocks.values())))
    total, done, off = sum(weights.values()), Counter(), 0.0
    for t in range(slots):
        done[place[t]] += 1
        if t % 97 == 0 or t == slots - 1:
            off = max(off, max(abs(done[s] - (t + 1) * w / total) for s, w in weights.items()))
    return off


def test_target_weights_over_many_slots():
    sizes = {"hot": 4000, **{f"s{i}": 2000 for i in range(20)}}
    assert worst(sizes, {s: n**0.5 for s, n in sizes.items()}, 20_000) < 1 + 1e-6


@pytest.mark.parametrize("n", [100, 500, 1500])
def test_target_weights_with_many_sources(n):
    blocks = {"hot": 5000, **{f"s{i}": 30 for i in range(n)}}
    assert worst(blocks, {"hot": 0.5, **{f"s{i}": 0.5 / n for i in range(n)}}, 5000) < 1 + 1e-6


def test_share_when_sources_run_out():
    blocks, weights = {"a": 700, "b": 20, "c": 333, "z": 9}, {"a": 2.0, "b": 1.0, "c": 1.0}
    got = block_slots(blocks, weights, None)
    assert sorted(x for own in got.values() for x in own) == list(range(1062)) and min(got["z"]) == 1053
    for t in range(80, 1053):
        past = t - 80  # b is used up after 80 slots, c after 1019
        want = 40 + past * 2 / 3 if t < 1019 else 666 + t - 1019
        assert abs(sum(x < t for x in got["a"]) - want) < 1 + 1e-6
