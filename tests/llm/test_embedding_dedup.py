import numpy as np
import pytest

from sluice.llm.embedding_dedup import FOOTRULE, SHARED, embedding_dedup, groups, index_size, near_pairs, permutations, shared_pivots, unit

VECTORS = "vec_id bigint, embedding array<float>"


def brute(units, threshold):
    cosine = units.astype(np.float64) @ units.T.astype(np.float64)
    return {(int(a), int(b)) for a, b in np.argwhere(np.triu(cosine >= threshold, 1))}


def planted(seed=0, n=400, width=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width))
    base /= np.linalg.norm(base, axis=1)[:, None]
    near = []
    for i in range(0, n, 3):
        noise = rng.normal(size=width)
        noise /= np.linalg.norm(noise)
        c = rng.uniform(0.93, 1)
        near.append(c * base[i] + np.sqrt(1 - c * c) * noise)
    return np.concatenate([base, near]).astype(np.float32)


def test_pairs_recall(table):
    x = planted()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    nodes = table(rows, "node bigint, v array<float>")
    units = unit([v.tolist() for v in x], 64)
    want = brute(units, 0.95)
    found = near_pairs(nodes).collect()
    got = {(r["u"], r["v"]) for r in found}
    assert len(found) == len(got)
    assert got <= brute(units, 0.95 - 1e-6) and len(got & want) >= 0.9 * len(want) > 50


def test_groups_of_the_table(spark):
    """All vectors are queries; groups are those of the pairs found by comparing all with all."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids = [r["vec_id"] for r in rows]
    want = {(ids[a], ids[b]) for a, b in brute(unit([r["embedding"] for r in rows], len(rows[0]["embedding"])), 0.95)}
    root = {r["id"]: r["root"] for r in groups(df).collect()}
    assert sum(root.get(a, a) == root.get(b, b) for a, b in want) >= 0.9 * len(want)
    assert {i for p in want for i in p} >= root.keys()


def test_permutations():
    rng = np.random.default_rng(2)
    x, p = rng.normal(size=(30, 8)).astype(np.float32), rng.normal(size=(20, 8)).astype(np.float32)
    want = np.argsort(-(x @ p.T), axis=1, kind="stable")[:, :7]
    assert (permutations(x, p, 7) == want).all()


@pytest.mark.parametrize("n", [10_000, 1_000_000, 30_000_000])
def test_index_keeps_nine_of_ten_pairs_at_every_size(n):
    pivots, kept = index_size(n)
    rng = np.random.default_rng(3)
    made = lambda k: (lambda v: v / np.linalg.norm(v, axis=1)[:, None])(rng.normal(size=(k, 64)))
    points, x, z = made(pivots), made(2000), made(2000)
    z -= (z * x).sum(axis=1)[:, None] * x
    y = 0.95 * x + (1 - 0.95**2) ** 0.5 * z / np.linalg.norm(z, axis=1)[:, None]
    shared, moved = shared_pivots(permutations(x, points, kept), permutations(y, points, kept))
    assert ((shared >= SHARED) & (moved <= FOOTRULE)).mean() >= 0.9


def test_shared_pivots():
    shared, moved = shared_pivots(np.array([[1, 2, 3], [1, 2, 3], [1, 2, 3]]), np.array([[1, 2, 3], [3, 2, 1], [7, 8, 9]]))
    assert shared.tolist() == [3, 3, 0] and moved.tolist() == [0, 4 / 12, 1]


def test_each_width_has_its_index(table):
    x, y = planted(7, 60), planted(8, 30, 40)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v.tolist()) for i, v in enumerate(y)]
    got = {(r["u"], r["v"]) for r in near_pairs(table(rows, "node bigint, v array<float>")).collect()}
    want = brute(unit([v.tolist() for v in x], 64), 0.95) | {(1000 + a, 1000 + b) for a, b in brute(unit([v.tolist() for v in y], 40), 0.95)}
    assert got <= want and len(got) >= 0.9 * len(want) and any(u >= 1000 for u, _ in got)


def test_groups_keep_the_least(table):
    x = planted(4, 60)
    a, b = x[0], x[1]
    rows = [(50, a.tolist()), (40, a.tolist()), (41, (a + 0.02 * b).tolist()), (60, b.tolist()), (61, (2 * b).tolist()), (70, x[2].tolist())]
    got = {r["vec_id"]: (r["dup_root"], r["dup_kept"]) for r in embedding_dedup(table(rows, VECTORS)).collect()}
    assert got == {50: (40, False), 40: (40, True), 41: (40, False), 60: (60, True), 61: (60, False), 70: (70, True)}


def test_nulls_ties_and_clashes(table):
    v = planted(5, 10)[0].tolist()
    nan, zero = [float("nan")] * 64, [0.0] * 64
    rows = [(2, v), (1, v), (1, v), (None, v), (None, v), (3, None), (4, zero), (5, zero), (6, nan), (7, nan), (8, v[:10]), (9, []), (10, [None] * 64), (11, [float("inf")] * 64), (12, [float("inf")] * 64)]
    df = table(rows, VECTORS, clash=True)
    out = embedding_dedup(df)
    root, kept = out.columns[-2:]
    assert out.columns[:-2] == df.columns and root == "dup_root_"
    got = sorted(((r["vec_id"], r[root], r[kept]) for r in out.collect()), key=lambda x: (x[0] is None, x[0]))
    assert got == [(1, 1, True), (2, 1, False), *[(i, i, True) for i in range(3, 13)], (None, None, True), (None, None, True)]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 0.0])], [(1, [1.0, 0.0]), (2, [1.0, 0.0])]])
def test_few_rows(table, rows):
    out = embedding_dedup(table(rows, VECTORS)).collect()
    assert len(out) == len(rows) and sum(r["dup_kept"] for r in out) == min(1, len(rows))


def test_thousands_of_copies(table):
    x = planted(6, 20)
    rows = [(i, x[0].tolist()) for i in range(3000)] + [(5000 + i, v.tolist()) for i, v in enumerate(x[1:20])]
    out = embedding_dedup(table(rows, VECTORS)).where("dup_kept").collect()
    assert sorted(r["vec_id"] for r in out) == [0, *range(5000, 5019)]
