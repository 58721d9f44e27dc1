"""Embedding near-dedup: a pivot-permutation index, shared-pivot counts, then the cosine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, components, fresh, materialize, one_row_per_id, table

THRESHOLD = 0.95
#: Pivots of which vectors must share so many among their nearest to be compared.
SHARED = 3
#: Greatest footrule of two lists of nearest pivots, as a part of the greatest there is (that of lists without a common pivot).
FOOTRULE = 0.75


def index_size(n: int) -> tuple[int, int]:
    """Pivots, and nearest ones kept of each vector, for n vectors: the pivots grow with the cube root of n, so that the lists of three pivots
    don't get longer, and what is kept grows with them, so that at least 9 of 10 pairs at a cosine of 0.95 share SHARED."""
    pivots = max(256, int(256 * (n / 50_000) ** (1 / 3)))
    return pivots, 6 if pivots <= 400 else 7 if pivots <= 2000 else 8


def unit(vectors: list[list[float] | None], width: int) -> np.ndarray:
    """Vectors of length 1; zeros for null, zero, infinite and undefined ones and those of another width."""
    out = np.zeros((len(vectors), width), np.float32)
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width and None not in v:
            out[i] = v
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.linalg.norm(out.astype(np.float64), axis=1)
    good = np.isfinite(norm) & (norm > 0)
    out[~good] = 0
    return np.where(good[:, None], out / np.where(good, norm, 1)[:, None], 0).astype(np.float32)


def permutations(units: np.ndarray, pivots: np.ndarray, kept: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    near = units @ pivots.T
    top = np.argpartition(-near, min(kept, len(pivots)) - 1, axis=1)[:, :kept]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1).astype(np.int32)


def choose_pivots(vectors: DataFrame, n: int, width: int) -> np.ndarray:
    """n distinct vectors, the first by a hash of their components."""
    rows = vectors.select("v").distinct().orderBy(F.xxhash64("v")).limit(n).collect()
    units = unit([r["v"] for r in rows], width)
    return units[np.abs(units).sum(axis=1) > 0]


def shared_pivots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of two lists of nearest pivots: how many they share, and their footrule, the places by which these are moved, where a pivot that
    isn't in the other list counts as just behind its end; as a part of the greatest there is."""
    m = a.shape[1]
    same = a[:, :, None] == b[:, None, :]
    count = same.sum(axis=(1, 2))
    place = np.arange(m)
    moved = (same * np.abs(place[:, None] - place)).sum(axis=(1, 2))
    for axis in (1, 2):
        moved += ((~same.any(axis=3 - axis)) * (m - place)).sum(axis=1)
    return count, moved / (m * (m + 1))


def _candidates(kept: int, pivots: int, least: int, footrule: float):
    """Of pairs (key, u, v, a, b) that meet in a list those that share enough pivots in a like order, each in the list of its first shared pivots alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32).reshape(-1, kept) for c in ("a", "b"))
            shared, moved = shared_pivots(a, b)
            own = np.sort(np.where((a[:, :, None] == b[:, None, :]).any(axis=2), a, pivots), axis=1)[:, :least].astype(np.int64)
            key = np.zeros(len(own), np.int64)
            for k in range(own.shape[1]):
                key = key * pivots + own[:, k]
            ok = (shared >= least) & (moved <= footrule) & (key == batch.column("key").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("u", "v")], ["u", "v"])

    return run


def near_pairs(vectors: DataFrame, threshold: float = THRESHOLD, pivots: int | None = None, kept: int | None = None, footrule: float = FOOTRULE) -> DataFrame:
    """(u, v, cosine) with u < v for vectors (node, v array<float>) that share at least SHARED of their kept nearest pivots, in an order that is
    at most footrule apart, and have a cosine of at least threshold, each pair once. Vectors of each width have an index of their own.

    The inverted lists are kept by threes of pivots, so that a list holds only vectors that share three, and a pair is taken from the list of
    its first three shared pivots alone.
    """
    widths = vectors.select(F.size("v").alias("n")).groupBy("n").count().orderBy("n").collect()
    parts = [_near_pairs(vectors.where(F.size("v") == w["n"]), w["n"], w["count"], threshold, pivots, kept, footrule) for w in widths]
    return reduce(DataFrame.unionAll, parts) if parts else vectors.sparkSession.createDataFrame([], "u bigint, v bigint, cosine double")


def _near_pairs(vectors: DataFrame, width: int, n: int, threshold: float, pivots: int | None, kept: int | None, footrule: float) -> DataFrame:
    size = index_size(n)
    points = choose_pivots(vectors, pivots or size[0], width)
    if len(points) < SHARED:  # fewer different vectors than that: any others will do
        points = np.concatenate([points, unit(np.random.default_rng(0).normal(size=(SHARED, width)).tolist(), width)])
    n_points, m = len(points), min(kept or size[1], len(points))
    sent = vectors.sparkSession.sparkContext.broadcast(points)
    lists_of = np.array(list(combinations(range(m), SHARED)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = unit(b.column(1).to_pylist(), width)
            good = np.flatnonzero(np.abs(u).sum(axis=1) > 0)
            if len(good):
                near = permutations(u[good], sent.value, m)
                own = np.sort(near, axis=1).astype(np.int64)
                keys = np.zeros((len(own), len(lists_of)), np.int64)
                for k in range(SHARED):
                    keys = keys * n_points + own[:, lists_of[:, k]]
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(good) + 1) * width, pa.int32()), pa.array(u[good].ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(good) + 1) * len(lists_of), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(good)), rows, pa.array([r.tobytes() for r in near], pa.binary()), lists], ["node", "unit", "near", "keys"])

    described = materialize(vectors.select("node", "v").mapInArrow(describe, "node bigint, unit array<float>, near binary, keys array<bigint>"))
    entries = described.select(F.explode("keys").alias("key"), "node", "near")
    left = entries.select("key", F.col("node").alias("u"), F.col("near").alias("a"))
    right = entries.select("key", F.col("node").alias("v"), F.col("near").alias("b"))
    common = left.join(right, "key").where("u < v").mapInArrow(_candidates(m, n_points, SHARED, footrule), "u bigint, v bigint")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(c).flatten().to_numpy().reshape(-1, width).astype(np.float64) for c in ("x", "y"))
            cosine = np.einsum("ij,ij->i", x, y)
            near = pa.array(np.flatnonzero(cosine >= threshold))
            yield pa.RecordBatch.from_arrays([b.column("u").take(near), b.column("v").take(near), pa.array(cosine).take(near)], ["u", "v", "cosine"])

    x, y = described.select(F.col("node").alias("u"), F.col("unit").alias("x")), described.select(F.col("node").alias("v"), F.col("unit").alias("y"))
    return common.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(verify, "u bigint, v bigint, cosine double")


def groups(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """(id, root) for every vector with a near copy: root is the least id that chains of near pairs link it with. Equal vectors are one node."""
    rows = vectors.where(col(key).isNotNull() & col(vector).isNotNull()).select(col(key).cast("bigint").alias("id"), col(vector).cast("array<float>").alias("v"))
    rows = rows.where(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    nodes = materialize(rows.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("copies")))
    linked = components(materialize(near_pairs(nodes, **options).select("u", "v")))
    copies = rows.join(nodes.where("copies > 1"), "v").select("id", "node")
    return copies.join(linked, "node", "left").select("id", F.coalesce("root", "node").alias("root")).unionByName(linked.select(F.col("node").alias("id"), "root")).distinct()


def embedding_dedup(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """vectors with columns dup_root (the least key of the vector's group of near copies; its own if it is alone) and dup_kept (true for one
    row of each group).

    Near copies have a cosine of at least threshold (0.95); groups are the connected components. Candidates are pairs whose lists of nearest
    pivots share enough; the pivots are chosen by hash, so that results don't depend on partitions, and the recall of pairs is tested to be
    over 0.9. Null, empty, zero, infinite and undefined vectors have no near copies; vectors of different widths are none of one another. Rows
    with a null key have a null root and are kept. Rows that repeat a key count as one. Ties go to the least key. An empty table gives an empty one. Where other columns have
    these names, those of the new ones get longer.
    """
    vectors = one_row_per_id(vectors, key)
    root, kept, own = fresh(vectors, "dup_root", "dup_kept", "dup_id")
    found = materialize(groups(vectors, key, vector, **options).select(F.col("id").alias(own), F.col("root").alias(root)))
    out = vectors.join(found, col(key) == col(own), "left")
    out = out.withColumn(root, F.coalesce(col(root), col(key).cast("bigint")))
    return out.withColumn(kept, col(root).isNull() | (col(root) == col(key))).select(*[col(c) for c in vectors.columns], root, kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings")).select("vec_id", "label", "dup_root", "dup_kept")
