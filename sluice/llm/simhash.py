"""SimHash near-dedup: fingerprints cut into blocks, a join on equal blocks, then the Hamming distance; pairs that share no block are found by
a ring of smaller blocks that differ in a bit at most."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, components, fresh, materialize, one_row_per_id, table

#: 384 bits as six 64-bit words.
WORDS = 6
#: Greatest distance of near copies.
MAX_DISTANCE = 60
#: Chance of a pair at the greatest distance to share a block, about.
RECALL = 0.9
#: Rows of a block from which its leader is met by a join of its own, which AQE may split.
HOT = 50_000
#: Rows of a block of which all pairs are compared.
SMALL = 32
#: Blocks of the ring by which pairs without a shared block are found, and those of them that are compared at once.
RING, CHAIN = 31, 5
#: Fingerprints of a group: a task compares two groups.
GROUP = 1 << 19
#: Tasks at least, where there are enough fingerprints.
SHARES = 12
#: Comparisons made at once.
_TILE = 1 << 15
_WORD = re.compile(r"\w+")
_FP = [f"f{i}" for i in range(WORDS)]
#: Word forms whose bits a worker keeps.
_KEPT = 150_000


class _Bits:
    """The bits of each word form, kept between documents."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.empty((4096, WORDS * 64), np.uint8)

    def ids(self, words: set[str]) -> np.ndarray:
        at = self.at
        if len(at) > _KEPT:
            self.__init__()
            at = self.at
        try:
            return np.fromiter(map(at.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = [w for w in words if w not in at]
        n = len(at)
        while n + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        digest = b"".join([xxhash.xxh3_128_digest(raw, seed) for raw in [w.encode("utf-8", "replace") for w in new] for seed in range(WORDS // 2)])
        self.rows[n : n + len(new)] = np.unpackbits(np.frombuffer(digest, np.uint8)).reshape(len(new), -1)
        at.update(zip(new, range(n, n + len(new))))
        return np.fromiter(map(at.__getitem__, words), np.int64, len(words))


def fingerprints(texts: list[str | None], bits: _Bits | None = None) -> list[np.ndarray | None]:
    """Six signed 64-bit words for each text: the bits that more than half of its distinct lower-case words have; None for a text without words."""
    bits = bits or _Bits()
    out: list[np.ndarray | None] = [None] * len(texts)
    for i, text in enumerate(texts):
        words = set(_WORD.findall(text.lower())) if text else set()
        if words:
            at = bits.ids(words)  # before rows is read: it may grow
            # one sum for each text: several times faster than reduceat over many
            sums = bits.rows[at].sum(axis=0, dtype=np.uint16 if len(words) < 1 << 16 else np.uint32)
            out[i] = np.packbits(sums > len(words) // 2).view(">i8").astype(np.int64)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = _Bits()
    for b in batches:
        ids, out = b.column(0), fingerprints(b.column(1).to_pylist(), bits)
        kept = [i for i, x in enumerate(out) if x is not None]
        if kept:
            found = np.stack([out[i] for i in kept])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept)), *[pa.array(found[:, k]) for k in range(WORDS)]], ["id", *_FP])


def fingerprint_table(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, f0..f5) for the rows with a key and at least one word."""
    rows = docs.where(col(key).isNotNull() & col(text).isNotNull()).select(col(key).cast("bigint").alias("id"), col(text).alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "id bigint, " + ", ".join(f"{c} bigint" for c in _FP))


def block_bits(n: int) -> int:
    """Bits of a block for n fingerprints: 16, and from half a million on more, so that few documents share one by chance."""
    return 4 * max(4, int((math.log2(max(n, 1)) - 2) // 4))


def blocks(width: int, max_distance: int = MAX_DISTANCE) -> np.ndarray:
    """The four-bit digits (96 in a fingerprint) of each block: the fingerprint split into blocks of width bits, and again in other orders of
    its digits, as often as it takes for RECALL of 4000 made pairs at max_distance to share one.

    Pairs of fewer bits apart than the first split has blocks share one for certain; the links of pairs that share none are found by missed_links.
    """
    bits, each = 64 * WORDS, width // 4
    rng, out = np.random.default_rng(0), []
    changed = np.zeros((4000, bits), bool)
    changed[:, :max_distance] = True
    changed = rng.permuted(changed, axis=1).reshape(4000, bits // 4, 4).any(axis=2)
    missed = np.ones(4000, bool)
    while True:
        order = rng.permutation(bits // 4) if out else np.arange(bits // 4)
        for block in order[: bits // width * each].reshape(-1, each):
            if len(out) >= bits // width and missed.mean() <= 1 - RECALL:
                return np.array(out)
            out.append(block)
            missed &= changed[:, block].any(axis=1)


def _entries(digits: np.ndarray):
    """(key, node, f0..f5) for each block of (node, f0..f5)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = np.stack([b.column(c).to_numpy() for c in _FP], axis=1)
            raw = words.astype(">i8").view(np.uint8)
            nibbles = np.stack([raw >> 4, raw & 15], axis=2).reshape(len(words), -1).astype(np.int64)
            key = np.zeros((len(words), len(digits)), np.int64)
            for k in range(digits.shape[1]):
                key = key << 4 | nibbles[:, digits[:, k]]
            key += np.arange(len(digits)) << 4 * digits.shape[1]
            at = np.repeat(np.arange(len(words)), len(digits))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(b.column("node").to_numpy()[at]), *[pa.array(words[at, k]) for k in range(WORDS)]], ["key", "node", *_FP])

    return run


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def links_of_block(nodes: np.ndarray, prints: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes at most most apart that link all nodes which such pairs link.

    Nodes near the first one are linked with it and not compared with each other; those that aren't are compared with those that are where
    distances to the first one don't rule it out, and among themselves in the same way.
    """
    while len(nodes) > SMALL:
        d = distances(prints, prints[0])
        near = d <= most
        at = np.flatnonzero(near)
        yield np.full(len(at) - 1, nodes[0]), nodes[at[1:]]
        for y in np.flatnonzero(~near & (d <= 2 * most)):
            x = at[d[at] >= d[y] - most]
            x = x[distances(prints[x], prints[y]) <= most]
            yield nodes[x], np.full(len(x), nodes[y])
        nodes, prints = nodes[~near], prints[~near]
    i, j = np.triu_indices(len(nodes), 1)
    ok = distances(prints[i], prints[j]) <= most
    yield nodes[i[ok]], nodes[j[ok]]


def _compare(most: int):
    """Links within the blocks of rows (key, node, f0..f5) in order of their keys."""

    def links(key: np.ndarray, node: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        left = np.repeat(size, size) - (np.arange(len(key)) - np.repeat(start, size))  # rows of the block from this one on
        us, vs = [], []
        rows = np.flatnonzero(np.repeat(size <= SMALL, size))
        for step in range(1, SMALL):
            rows = rows[left[rows] > step]
            if not len(rows):
                break
            ok = rows[distances(prints[rows], prints[rows + step]) <= most]
            us.append(node[ok])
            vs.append(node[ok + step])
        for k in np.flatnonzero(size > SMALL):
            for u, v in links_of_block(node[start[k] : start[k] + size[k]], prints[start[k] : start[k] + size[k]], most):
                us.append(u)
                vs.append(v)
        u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (us, vs))
        pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for b in batches:
            held.append(np.stack([c.to_numpy() for c in b.columns], axis=1))
            n += b.num_rows
            if n < 1 << 16:
                continue
            rows = np.concatenate(held)
            cut = np.searchsorted(rows[:, 0], rows[-1, 0])  # the last block may go on
            if cut:
                yield links(rows[:cut, 0], rows[:cut, 1], rows[:cut, 2:].view(np.uint64))
            held, n = [rows[cut:]], 0
        if held and sum(map(len, held)):
            rows = np.concatenate(held)
            yield links(rows[:, 0], rows[:, 1], rows[:, 2:].view(np.uint64))

    return run


def _distance(a: str, b: str) -> Column:
    """Of the fingerprints whose columns begin with a and b."""
    out = F.bit_count(F.col(f"{a}{_FP[0]}").bitwiseXOR(F.col(f"{b}{_FP[0]}")))
    for c in _FP[1:]:
        out = out + F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")))
    return out


def near_links(nodes: DataFrame, max_distance: int = MAX_DISTANCE, hot: int = HOT) -> DataFrame:
    """(u, v) with u < v: pairs of nodes (node, f0..f5) that are at most max_distance bits apart, so many that their connected components are
    those of all such pairs that share a block. Distances are checked; a pair may come more than once.

    A block of up to hot nodes is compared in the task of its key. Of a larger one the nodes near its least node are linked with that in a
    join, and met with the others only where the triangle inequality leaves a chance; so a group of near copies, however large, makes as many
    links as it has members, and no task gets it whole.
    """
    digits = blocks(block_bits(nodes.count()), max_distance)
    kind = "key bigint, node bigint, " + ", ".join(f"{c} bigint" for c in _FP)
    entries = nodes.select("node", *_FP).mapInArrow(_entries(digits), kind)
    # large blocks show in a part of the nodes; one that is missed, or taken for one, gives the same links
    part = max(1, min(64, hot // 500))
    often = entries.where(F.pmod(F.xxhash64("node"), F.lit(part)) == 0).groupBy("key").agg((F.count("*") * part).alias("n")).where(F.col("n") > hot).select("key")
    often = materialize(often)
    compare = lambda df: df.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_compare(max_distance), "u bigint, v bigint")
    if often.isEmpty():
        return compare(entries)
    light = compare(entries.join(often, "key", "left_anti").select("key", "node", *_FP))
    large = entries.join(often, "key")
    first = large.groupBy("key").agg(F.min("node").alias("leader"), *[F.min_by(c, "node").alias(f"l{c}") for c in _FP])
    met = materialize(large.join(first, "key").withColumn("d", _distance("", "l")))
    near, far = met.where(F.col("d") <= max_distance), met.where(F.col("d") > max_distance)
    others = far.where(F.col("d") <= 2 * max_distance).select("key", F.col("node").alias("y"), F.col("d").alias("dy"), *[F.col(c).alias(f"y{c}") for c in _FP])
    across = near.join(others, "key").where((F.col("d") >= F.col("dy") - max_distance) & (_distance("", "y") <= max_distance))
    links = near.where("node <> leader").select(F.col("leader").alias("u"), F.col("node").alias("v")).unionByName(across.select(F.col("node").alias("u"), F.col("y").alias("v")))
    links = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return light.unionByName(links).unionByName(compare(far.select("key", "node", *_FP)))


def _chain(prints: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The bits of block k of the ring, those of it and the CHAIN - 1 blocks after it, and the width of the block, of fingerprints (six rows of words)."""
    at, end, last = (i * 64 * WORDS // RING for i in (k, k + 1, k + CHAIN))
    word, shift = divmod(at, 64)
    bits = prints[word] << np.uint64(shift)
    if shift:
        bits |= prints[(word + 1) % WORDS] >> np.uint64(64 - shift)
    return (bits >> np.uint64(64 - end + at)).astype(np.int64), bits >> np.uint64(64 - last + at), end - at


def _masks(width: int, most: int) -> np.ndarray:
    """Words of width bits of which at most most are set."""
    return np.array([sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(width), n)], np.int64)


def _work(a: np.ndarray, b: np.ndarray, own: bool, most: int) -> float:
    """Nanoseconds that the ring takes, about."""
    out = 0.0
    for k in range(RING):
        (ka, _, width), (kb, _, _) = _chain(a, k), _chain(b, k)
        na, nb = np.bincount(ka, minlength=1 << width), np.bincount(kb, minlength=1 << width)
        met = sum((na * nb[np.arange(1 << width) ^ m]).sum(dtype=float) for m in _masks(width, most // RING))
        out += 3 * met / (1 + own) + 60_000 * np.count_nonzero(na)
    return out


def root_pairs(a: np.ndarray, ra: np.ndarray, b: np.ndarray | None, rb: np.ndarray | None, most: int, share: int = 0, shares: int = 1, ring: bool | None = None) -> np.ndarray:
    """Rows (u, v), u < v: all different roots of which fingerprints (six rows of words) are at most most bits apart, one of a and one of b, or
    both of a where b is None; of shares shares of the work the one of number share.

    Bits that differ are at most most over all RING blocks, so that going round from one of the blocks the first 1, 2, 3... blocks all hold at
    most their share of them: that block holds most // RING and its chain of CHAIN blocks CHAIN * most // RING. The first gives the buckets to
    compare, the second is tested before the whole distance. Where the buckets are so uneven that all pairs take less, all are compared.
    Fingerprints of one root aren't compared where they come in large runs. Shares are the same in whatever order the rows come, as executors
    read the outputs of a shuffle in different orders.
    """
    own = b is None
    order = np.lexsort((*a, ra))
    a, ra = np.ascontiguousarray(a[:, order]), ra[order]
    if own:
        b, rb = a, ra
    else:
        order = np.lexsort((*b, rb))
        b, rb = np.ascontiguousarray(b[:, order]), rb[order]
    found: list[np.ndarray] = [np.empty((0, 2), np.int64)]
    held = 0

    def compare(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> None:
        """Words x of the fingerprints i of a with words y of those j of b."""
        nonlocal held, found
        if not len(i) or not len(j):
            return
        large = len(i) * len(j) > 1 << 22
        step = 64 if large else max(1, _TILE // len(j))
        for lo in range(0, len(i), step):
            x0, i0, y0, j0 = x[:, lo : lo + step], i[lo : lo + step], y, j
            if large and ra[i0[0]] == ra[i0[-1]]:
                other = rb[j] != ra[i0[0]]
                y0, j0 = y[:, other], j[other]
            for at in range(0, len(j0), max(1, _TILE // len(i0))):
                y1 = y0[:, at : at + max(1, _TILE // len(i0))]
                d = np.bitwise_count(x0[0][:, None] ^ y1[0])
                for w in range(1, len(x)):
                    d += np.bitwise_count(x0[w][:, None] ^ y1[w])
                hit = np.flatnonzero(d.ravel() <= limit)
                if not len(hit):
                    continue
                p, q = i0[hit // y1.shape[1]], j0[at + hit % y1.shape[1]]
                other = ra[p] != rb[q]
                p, q = p[other], q[other]
                ok = np.bitwise_count(a[:, p] ^ b[:, q]).sum(axis=0, dtype=np.int32) <= most
                if not ok.any():
                    continue
                u, v = ra[p[ok]], rb[q[ok]]
                found.append(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1))
                held += len(u)
                if held > 1 << 20 or len(found) > 1 << 16:
                    found, held = [np.unique(np.concatenate(found), axis=0)], 0

    if ring is None:
        ring = most < 3 * RING and _work(a, b, own, most) < 7 * len(ra) * len(rb) / (1 + own)
    if not ring:
        j = np.arange(len(rb))
        for lo in range(64 * share, len(ra), 64 * shares):
            i = np.arange(lo, min(lo + 64, len(ra)))
            other = rb != ra[lo] if ra[lo] == ra[i[-1]] else rb == rb
            if own:
                other[:lo] = False
            compare(a[:3, i], b[:3, other], i, j[other], most)
    for k in range(share, RING, shares) if ring else ():
        (ka, xa, width), (kb, xb, _) = _chain(a, k), _chain(b, k)
        ia, ib = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
        keys, masks = np.arange((1 << width) + 1), _masks(width, most // RING)
        xa, xb, sa, sb = xa[ia], xb[ib], np.searchsorted(ka[ia], keys), np.searchsorted(kb[ib], keys)
        for key in np.flatnonzero(np.diff(sa)):
            near = key ^ masks
            near = near[(near >= key) & (sb[near] < sb[near + 1])] if own else near[sb[near] < sb[near + 1]]
            if len(near):
                parts = [slice(s, e) for s, e in zip(sb[near].tolist(), sb[near + 1].tolist())]
                at = slice(sa[key], sa[key + 1])
                compare(xa[None, at], np.concatenate([xb[s] for s in parts])[None], ia[at], np.concatenate([ib[s] for s in parts]), CHAIN * most // RING)
    return np.unique(np.concatenate(found), axis=0)


def _root_pairs(most: int, shares: int):
    """root_pairs of the groups and the share of a partition's rows (at, root, f0..f5)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.stack([c.to_numpy() for c in b.columns]) for b in batches if b.num_rows]
        if not rows:
            return
        at, root, *words = np.concatenate(rows, axis=1)
        del rows
        pair, share = divmod(int(at[0]) // 2, shares)
        later = (math.isqrt(8 * pair + 1) - 1) // 2
        prints, second = np.stack(words).view(np.uint64), at % 2 == 1
        del words
        b, rb = (None, None) if pair == later * (later + 1) // 2 + later else (prints[:, second], root[second])
        out = root_pairs(prints[:, ~second], root[~second], b, rb, most, share, shares)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["u", "v"])

    return run


def missed_links(nodes: DataFrame, n: int, max_distance: int = MAX_DISTANCE, group: int = GROUP) -> DataFrame:
    """(u, v) with u < v: all different roots of which any of the n nodes (root, f0..f5) are at most max_distance bits apart; a pair may come
    more than once.

    The nodes go to groups of about group, and each two groups, or each with itself, to a task that finds all their pairs (see root_pairs); of
    few groups several tasks do a share each.
    """
    many = max(1, -(-n // group))
    pairs = many * (many + 1) // 2
    shares = max(1, -(-SHARES // pairs)) if n > 1 << 14 else 1
    own, other = F.col("own"), F.floor(F.col("to") / shares)
    pair = F.expr("bigint(greatest(own, other) * (greatest(own, other) + 1) div 2 + least(own, other))")
    rows = nodes.select(F.pmod(F.xxhash64(*_FP), F.lit(many)).alias("own"), "root", *_FP)
    rows = rows.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(many * shares - 1)))).withColumn("other", other)
    at = (pair * shares + F.col("to") % shares) * 2 + (own > F.col("other")).cast("bigint")
    rows = rows.select(at.cast("bigint").alias("at"), "root", *_FP)
    rows = rows.repartitionById(pairs * shares, F.floor(F.col("at") / 2).cast("int"))
    return rows.mapInArrow(_root_pairs(max_distance, shares), "u bigint, v bigint")


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(id, root) for every document that has a near copy: root is the least id that chains of near pairs link it with.

    Documents with equal fingerprints count as one node, so that thousands of copies make no pairs among themselves.
    """
    prints = materialize(fingerprint_table(docs, text, key))
    nodes = materialize(prints.groupBy(*_FP).agg(F.min("id").alias("node"), F.count("*").alias("copies")))
    linked = materialize(components(materialize(near_links(nodes, max_distance))))
    rooted = nodes.join(linked, "node", "left").select(F.coalesce("root", "node").alias("root"), *_FP)
    missed = materialize(missed_links(rooted, nodes.count(), max_distance))
    if not missed.isEmpty():
        above = materialize(components(missed).select("node", F.col("root").alias("top")))
        alone = above.join(linked, "node", "left_anti").select("node", F.col("top").alias("root"))
        linked = linked.join(above.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(alone)
    copies = prints.join(nodes.where("copies > 1"), _FP).select("id", "node")
    of_copies = copies.join(linked, "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    return of_copies.unionByName(linked.select(F.col("node").alias("id"), "root")).distinct()


def simhash_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """docs with one document of each group of near copies: the one with the least key.

    Two documents are near copies if the fingerprints of their sets of lower-case words differ in at most max_distance of 384 bits; groups are
    the connected components of all near copies, whether or not they share a block of their fingerprints: blocks find most links, then all pairs
    of different groups are met by the ring (see root_pairs), which leaves out none. Null, empty and wordless texts have no fingerprint and stay, as do rows without a key. Rows that repeat a key
    count as one document, of which one row stays. Ties go to the least key. Texts may be of any length. An empty table gives an empty one.
    Other columns come through as they are, whatever their names.
    """
    docs = one_row_per_id(docs, key)
    (gone,) = fresh(docs, "dropped_id")
    drop = materialize(groups(docs, text, key, max_distance).where("id <> root").select(F.col("id").alias(gone)))
    return docs.join(drop, col(key) == col(gone), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))
