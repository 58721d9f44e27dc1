import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sluice.llm.common import components
from sluice.llm.simhash import HOT, MAX_DISTANCE, WORDS, block_bits, blocks, distances, fingerprint_table, fingerprints, groups, links_of_block, missed_links, near_links, root_pairs, simhash_dedup

DOCS = "doc_id bigint, text string"


def naive(text):
    """The fingerprint as one integer, bit by bit."""
    words = set(re.findall(r"\w+", text.lower()))
    if not words:
        return None
    total = [0] * (64 * WORDS)
    for w in words:
        raw = b"".join(xxhash.xxh3_128_digest(w.encode(), seed) for seed in range(WORDS // 2))
        bits = bin(int.from_bytes(raw, "big"))[2:].zfill(64 * WORDS)
        for i, b in enumerate(bits):
            total[i] += b == "1"
    return int("".join("1" if 2 * x > 2 * (len(words) // 2) else "0" for x in total), 2)


def as_int(words):
    return int("".join(f"{int(w) & (1 << 64) - 1:064b}" for w in words), 2)


def edited(rng, text, share):
    words = text.split()
    for i in rng.sample(range(len(words)), max(1, int(len(words) * share))):
        words[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_fingerprints(rng, prose):
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(30)] + ["", None, " .,! ", "Ä ä ß", "one"]
    for text, got in zip(texts, fingerprints(texts)):
        assert (None if got is None else as_int(got)) == (naive(text) if text else None)


def roots(edges):
    """The least node of each one's component."""
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("hot", [HOT, 3])
def test_groups_like_brute_force(table, rng, prose, hot):
    rows = []
    for i in range(120):
        base = prose(rng, rng.randint(60, 300))
        rows += [(3 * i, base), (3 * i + 1, edited(rng, base, 0.03)), (3 * i + 2, edited(rng, base, 0.12))]
    prints = {i: naive(t) for i, t in rows}
    pairs = {(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= MAX_DISTANCE}
    nodes = fingerprint_table(table(rows, DOCS), "text", "doc_id").withColumnRenamed("id", "node")
    got = {(r["u"], r["v"]) for r in near_links(nodes, hot=hot).collect()}
    assert got <= pairs  # no false link
    # all pairs that share a block, and so in groups together
    digit = lambda x, k: x >> 4 * (95 - k) & 15
    keys = {i: {(t, tuple(digit(x, k) for k in own)) for t, own in enumerate(blocks(16).tolist())} for i, x in prints.items()}
    shared = {(a, b) for a, b in pairs if keys[a] & keys[b]}
    assert len(shared) >= 0.95 * len(pairs) >= 100
    assert roots(got) == roots(shared)


@pytest.mark.parametrize("n", [10**3, 10**6, 10**8, 3 * 10**10])
def test_pairs_at_the_greatest_distance_share_a_block(n):
    rng, own = np.random.default_rng(2), blocks(block_bits(n))
    assert n / 2 ** block_bits(n) < 64 or n < 10**6
    hit = 0
    for _ in range(1500):
        changed = np.zeros(96, bool)
        changed[rng.choice(64 * WORDS, MAX_DISTANCE, replace=False) // 4] = True
        hit += (~changed[own]).all(axis=1).any()
    assert hit >= 0.88 * 1500


def test_a_block_of_many_near_copies(rng):
    base = np.array([rng.getrandbits(64) for _ in range(WORDS)], np.uint64)

    def flipped(x, bits):
        out = x.copy()
        for b in rng.sample(range(64 * WORDS), bits):
            out[b // 64] ^= np.uint64(1 << (b % 64))
        return out

    a = [flipped(base, rng.randint(0, 50)) for _ in range(400)]
    b = [flipped(flipped(base, 75), rng.randint(0, 30)) for _ in range(60)]
    c = [np.array([rng.getrandbits(64) for _ in range(WORDS)], np.uint64) for _ in range(90)]
    prints, nodes = np.stack(a + b + c), np.arange(550)
    pairs = [(i, j) for i in range(550) for j in np.flatnonzero(distances(prints[i + 1 :], prints[i]) <= MAX_DISTANCE) + i + 1]
    links = [(int(min(p)), int(max(p))) for u, v in links_of_block(nodes, prints, MAX_DISTANCE) for p in zip(u, v)]
    assert set(links) <= set(pairs) and roots(links) == roots([(int(i), int(j)) for i, j in pairs])
    assert len(links) < len(pairs) / 3


def test_one_document_of_each_group_stays(table, rng, prose):
    rows, first = [], []
    for g in range(25):
        base = prose(rng, 200, 20_000)
        first.append(100 * g)
        rows += [(100 * g, base)] + [(100 * g + k, base if k % 2 else edited(rng, base, 0.02)) for k in range(1, 5)]
    rows += [(10_000 + i, prose(rng, 150, 20_000)) for i in range(60)]
    out = {r["doc_id"] for r in simhash_dedup(table(rows, DOCS).repartition(4)).collect()}
    assert out == {*first, *range(10_000, 10_060)}


def test_thousands_of_copies(table, rng, prose):
    a = prose(rng, 80)
    rows = [(i, a) for i in range(4000)] + [(5000, edited(rng, a, 0.02))]
    assert [r["doc_id"] for r in simhash_dedup(table(rows, DOCS)).collect()] == [0]


def test_nulls_ties_and_clashes(table, rng, prose):
    a = prose(rng, 100)
    long = prose(rng, 50_000)
    rows = [(5, a), (4, a), (4, a), (None, a), (None, a), (6, None), (6, None), (7, None), (8, ""), (9, "..."), (10, ""), (11, long), (12, long)]
    df = table(rows, DOCS, clash=True)
    out = simhash_dedup(df)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], (r["text"] or "")[:5]) for r in out.collect()), key=str) == sorted([(4, a[:5]), (None, a[:5]), (None, a[:5]), (6, ""), (7, ""), (8, ""), (9, "..."), (10, ""), (11, long[:5])], key=str)


def test_empty(table):
    assert simhash_dedup(table([], DOCS)).collect() == []


def test_components(spark, rng):
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_groups_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = groups(docs).collect()
    assert all(r["root"] <= r["id"] for r in rows) and len({r["id"] for r in rows}) == len(rows)
    copies = docs.groupBy("text").agg(F.collect_list("doc_id").alias("i"), F.count("*").alias("n")).where("n > 1").collect()
    root = {r["id"]: r["root"] for r in rows}
    assert copies and all(len({root[i] for i in c["i"]}) == 1 for c in copies)
    assert np.all([r["root"] in root for r in rows])


def test_pairs_without_a_shared_block_are_linked(table, rng, prose):
    rows, own = [], blocks(16)
    while len(rows) < 16:
        base = prose(rng, 150, 20_000)
        other = edited(rng, base, 0.11)
        a, b = (as_int(x) for x in fingerprints([base, other]))
        digit = [(a ^ b) >> 4 * (95 - k) & 15 for k in range(96)]
        if (a ^ b).bit_count() <= MAX_DISTANCE and np.array(digit)[own].any(axis=1).all():
            rows += [(len(rows), base), (len(rows) + 1, other)]
    assert {(r["id"], r["root"]) for r in groups(table(rows, DOCS)).collect()} == {(i, i - i % 2) for i in range(16)}
    assert sorted(r["doc_id"] for r in simhash_dedup(table(rows, DOCS)).collect()) == list(range(0, 16, 2))


def planted(n, seed):
    """Fingerprints of which many are 50 to 70 bits apart, some 60, and one run of near ones."""
    rng = np.random.default_rng(seed)
    bits = rng.integers(0, 2, (n, 64 * WORDS), np.uint8)
    for i in range(1, n // 2):
        bits[i] = bits[i // 8 * 8 if i < n // 4 else 0]
        bits[i, rng.choice(64 * WORDS, 60 if i % 3 else rng.integers(20, 40), replace=False)] ^= 1
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)


@pytest.mark.parametrize("most", [10, 60, 64])
@pytest.mark.parametrize("ring", [True, False])
def test_root_pairs_like_brute_force(ring, most):
    x = planted(600, 3)
    root = np.where(np.arange(600) % 7 == 0, 0, np.arange(600))
    near = [(int(i), int(j)) for i in range(600) for j in np.flatnonzero(distances(x[i + 1 :], x[i]) <= most) + i + 1]
    wanted = lambda pairs: {tuple(sorted((int(root[i]), int(root[j])))) for i, j in pairs if root[i] != root[j]}
    of = lambda pairs: {tuple(p) for p in pairs.tolist()}
    assert wanted(near) or most == 10
    parts = [of(root_pairs(x.T, root, None, None, most, k, 4, ring)) for k in range(4)]
    assert set().union(*parts) == wanted(near)
    got = of(root_pairs(x[::2].T, root[::2], x[1::2].T, root[1::2], most, ring=ring))
    assert got == wanted((i, j) for i, j in near if (i + j) % 2)


@pytest.mark.parametrize("group", [40, 150, 1000])
def test_missed_links_of_all_groups(spark, group):
    x = planted(300, 4)
    nodes = spark.createDataFrame([(i, *map(int, f)) for i, f in enumerate(x.view(np.int64))], "root bigint, " + ", ".join(f"f{k} bigint" for k in range(WORDS)))
    wanted = {(i, int(j)) for i in range(300) for j in np.flatnonzero(distances(x[i + 1 :], x[i]) <= MAX_DISTANCE) + i + 1}
    assert wanted and {(r["u"], r["v"]) for r in missed_links(nodes, 300, group=group).collect()} == wanted


@pytest.mark.parametrize("ring", [True, False])
def test_shares_whose_rows_come_in_different_orders(ring):
    """As executors read the outputs of a shuffle in different orders."""
    x, rng = planted(800, 5), np.random.default_rng(6)
    root = np.where(np.arange(800) % 4 > 0, 0, np.arange(800))
    near = [(int(i), int(j)) for i in range(800) for j in np.flatnonzero(distances(x[i + 1 :], x[i]) <= MAX_DISTANCE) + i + 1]
    wanted = {tuple(sorted((int(root[i]), int(root[j])))) for i, j in near if root[i] != root[j]}
    got, across = set(), set()
    for k in range(6):
        at = rng.permutation(800)
        own, other = at[at < 500], at[at >= 500]
        got |= {tuple(p) for p in root_pairs(x[at].T, root[at], None, None, MAX_DISTANCE, k, 6, ring).tolist()}
        across |= {tuple(p) for p in root_pairs(x[own].T, root[own], x[other].T, root[other], MAX_DISTANCE, k, 6, ring).tolist()}
    assert wanted and got == wanted
    assert across == {tuple(sorted((int(root[i]), int(root[j])))) for i, j in near if i < 500 <= j and root[i] != root[j]}
