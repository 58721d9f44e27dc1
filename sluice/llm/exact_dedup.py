"""Exact dedup: a two-pass Bloom filter finds the texts that may repeat; only their rows shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, first_rows, fresh, is_scan, materialize, table

#: Bits of one shard of the filter.
SHARD = 1 << 20
#: Rows of a file whose bits are one piece.
PIECE = 1 << 20


def positions(h: np.ndarray, shards: int, n_hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each hash and its n_hashes bits there, by double hashing."""
    with np.errstate(over="ignore"):
        x = h.view(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        y = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        shard = (x >> np.uint64(33)) % np.uint64(shards)
        step = (y >> np.uint64(32)) | np.uint64(1)
        at = (y[:, None] + np.arange(n_hashes, dtype=np.uint64) * step[:, None]) % np.uint64(SHARD)
    return shard.astype(np.int64), at.astype(np.int64)


def _partial(shards: int, n_hashes: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy() for b in batches if b.num_rows]
        if not parts:
            return
        shard, at = positions(np.concatenate(parts), shards, n_hashes)
        key, count = np.unique((shard[:, None] * SHARD + at).ravel(), return_counts=True)
        of, start = np.unique(key // SHARD, return_index=True)
        for s, a, b in zip(of, start, [*start[1:], len(key)]):
            own, twice = (key[a:b] % SHARD).astype("<u4"), count[a:b] > 1
            yield pa.RecordBatch.from_pydict({"shard": [int(s)], "once": [own.tobytes()], "twice": [own[twice].tobytes()]})

    return build


def _merge(group: pa.Table) -> pa.Table:
    """Bits that two or more hashes set, whichever tasks they were in."""
    seen, again = np.zeros(SHARD, bool), np.zeros(SHARD, bool)
    for once, twice in zip(group.column("once"), group.column("twice")):
        at = np.frombuffer(once.as_py(), "<u4")
        again[at[seen[at]]] = True
        seen[at] = True
        again[np.frombuffer(twice.as_py(), "<u4")] = True
    return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(again).tobytes()], pa.binary())})


def _probe(bits: dict[int, np.ndarray], shard: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(shard), bool)
    for s in np.unique(shard):
        if s in bits:
            own = np.flatnonzero(shard == s)
            p = at[own]
            out[own] = ((bits[s][p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(axis=1)
    return out


def _pack_places(group: pa.Table) -> pa.Table:
    """One bit for each row of a piece of a file, set for the places given."""
    bits = np.zeros(PIECE, bool)
    bits[group.column("r").to_numpy()] = True
    return pa.table({"f": group.column("f")[:1], "piece": group.column("piece")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _flagged(sent):
    @F.pandas_udf("boolean")
    def look(f: pd.Series, at: pd.Series) -> pd.Series:
        of, place, out = f.to_numpy(), at.to_numpy(), np.zeros(len(f), bool)
        for file, piece in {*zip(of.tolist(), (place // PIECE).tolist())}:
            if (file, piece) in sent.value:
                own = np.flatnonzero((of == file) & (place // PIECE == piece))
                p = place[own] % PIECE
                out[own] = (sent.value[file, piece][p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1
        return pd.Series(out)

    return look


def _by_place(docs: DataFrame, text: str, maybe: str, filters: DataFrame, shards: int, n_hashes: int, most: int) -> DataFrame:
    """docs with the column maybe, where the filter is too large to be sent to every executor.

    The bare hashes go to the filter's shards; those that it can't rule out meet the rows' hashes and places again, which gives one bit for each
    row of a file. A group of files, whose bits take at most most bytes, is read with only its own bits broadcast. No text is shuffled.
    """
    spark = docs.sparkSession
    meta = docs.metadataColumn("_metadata")
    rows = docs.where(col(text).isNotNull()).select(F.xxhash64(col(text)).alias("h"), F.xxhash64(meta["file_path"]).alias("f"), meta["row_index"].alias("at"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.unique(b.column(0).to_numpy())
            yield pa.RecordBatch.from_pydict({"shard": positions(x, shards, n_hashes)[0], "h": x})

    def look_up(key: tuple, hashes: pa.Table, bits: pa.Table) -> pa.Table:
        x = np.unique(hashes.column("h").to_numpy())
        own = {key[0].as_py(): np.frombuffer(b.as_py(), np.uint8) for b in bits.column("bits")}
        return pa.table({"h": x[_probe(own, *positions(x, shards, n_hashes))]})

    found = rows.select("h").mapInArrow(place, "shard bigint, h bigint").groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(look_up, "h bigint")
    places = rows.join(found, "h").select("f", F.floor(F.col("at") / PIECE).cast("bigint").alias("piece"), (F.col("at") % PIECE).cast("int").alias("r"))
    bitmaps = materialize(places.groupBy("f", "piece").applyInArrow(_pack_places, "f bigint, piece bigint, bits binary"))
    groups: list[list] = []
    room = 0
    for f in docs.select(meta["file_path"].alias("path"), meta["row_index"].alias("at")).groupBy("path").agg(F.xxhash64("path").alias("f"), (F.floor(F.max("at") / PIECE) + 1).alias("pieces")).orderBy("path").collect():
        if not groups or f["pieces"] * PIECE // 8 > room:
            groups.append([])
            room = most
        groups[-1].append(f)
        room -= f["pieces"] * PIECE // 8
    parts = []
    f, at = fresh(docs, "file_hash", "file_place")
    for files in groups:
        sent = spark.sparkContext.broadcast({(r["f"], r["piece"]): np.frombuffer(r["bits"], np.uint8) for r in bitmaps.where(F.col("f").isin([x["f"] for x in files])).collect()})

        placed = docs.where(meta["file_path"].isin([x["path"] for x in files])).select("*", F.xxhash64(meta["file_path"]).alias(f), meta["row_index"].alias(at))
        parts.append(placed.withColumn(maybe, _flagged(sent)(col(f), col(at))).drop(f, at))
    return reduce(DataFrame.unionAll, parts) if parts else docs.withColumn(maybe, F.lit(False))


def maybe_repeated(docs: DataFrame, text: str, bits_per_row: int = 12, n_hashes: int = 4, max_filter_mb: int = 64) -> DataFrame:
    """docs with a last column that is true where the filter can't rule out that another row has the same text; false for null texts.

    Pass 1 sets n_hashes bits for the 64-bit hash of each text in a filter of bits_per_row bits a row, cut into shards; of it stay the bits
    that two rows set. What shuffles is the bits, 16 bytes a row before compression. Pass 2 looks the rows up. The filter is sent to every
    executor up to max_filter_mb. A larger one stays where it is: the bare hashes go to its shards, and what comes back is one bit for each row,
    by file and place in it, for one group of files at a time. Rows that don't lie in Parquet files are written to the shared folder first then.
    """
    spark = docs.sparkSession
    n = docs.count()
    shards, most = max(1, -(-n * bits_per_row // SHARD)), max_filter_mb << 20
    large = shards * SHARD // 8 > most
    if large and not is_scan(docs):
        docs = materialize(docs)
    h, maybe = fresh(docs, "text_hash", "maybe_repeated")
    hashes = docs.where(col(text).isNotNull()).select(F.xxhash64(col(text)).alias("h"))
    partial = hashes.mapInArrow(_partial(shards, n_hashes), "shard bigint, once binary, twice binary")
    filters = materialize(partial.groupBy("shard").applyInArrow(_merge, "shard bigint, bits binary"))
    if large:
        return _by_place(docs, text, maybe, filters, shards, n_hashes, most)
    sent = spark.sparkContext.broadcast({r["shard"]: np.frombuffer(r["bits"], np.uint8) for r in filters.collect()})

    @F.pandas_udf("boolean")
    def look(x: pd.Series) -> pd.Series:
        return pd.Series(_probe(sent.value, *positions(x.to_numpy(), shards, n_hashes)))

    return docs.withColumn(h, F.xxhash64(col(text))).withColumn(maybe, col(text).isNotNull() & look(col(h))).drop(h)


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", **filter_options) -> DataFrame:
    """docs with one row for each text: the one with the least key.

    Texts are compared byte for byte (by SHA-256), with case and white space as they are. Null texts are no copies of one another: all stay.
    Empty texts are equal: one stays. Among rows with the same text and key (repeated rows too) one stays; a null key comes after all others.
    Texts may be of any length. An empty table gives an empty one. Other columns come through as they are, whatever their names.
    """
    flagged = maybe_repeated(docs, text, **filter_options)
    maybe = flagged.columns[-1]
    once = flagged.where(~col(maybe)).select(*[col(c) for c in docs.columns])
    again = flagged.where(col(maybe)).select(*[col(c) for c in docs.columns])
    return once.unionByName(first_rows(again, [F.sha2(col(text), 256)], key))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, text, lang, source, n_chars FROM documents
QUALIFY text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1
"""
