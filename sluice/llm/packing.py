"""Best-fit packing of token windows by a grouping genetic algorithm on islands that pass on their elite."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import TOKENIZER, encoding
from .common import col, materialize, table


class Bins:
    """Open bins by free space; best fit is the lowest set bit of a mask of the spaces there are."""

    def __init__(self, capacity: int, free: list[int]) -> None:
        self.capacity, self.n = capacity, len(free)
        self.by: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        for b, r in enumerate(free):
            self.by[r].append(b)
            self.mask |= 1 << r

    def put(self, lengths: list[int]) -> list[int]:
        by, mask, n, out = self.by, self.mask, self.n, []
        for x in lengths:
            m = mask >> x
            if m:
                r = x + (m & -m).bit_length() - 1
                b = by[r].pop()
                if not by[r]:
                    mask ^= 1 << r
            else:
                r, b = self.capacity, n
                n += 1
            r -= x
            by[r].append(b)
            mask |= 1 << r
            out.append(b)
        self.mask, self.n = mask, n
        return out


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    out = np.empty(len(lengths), np.int32)
    out[order] = Bins(capacity, []).put(lengths[order].tolist())
    return out


def fitness(lengths: np.ndarray, of: np.ndarray, capacity: int) -> float:
    """Mean squared filling of the bins: it rewards well-filled bins, and so fewer."""
    return float(((np.bincount(of, lengths) / capacity) ** 2).mean()) if len(of) else 1.0


def crossover(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Whole well-filled bins of b go into a; a's bins that share documents with them are dissolved, and the displaced ones put in by best fit."""
    fill = np.bincount(b, lengths)
    well = fill >= np.quantile(fill, rng.uniform(0.2, 0.8))
    take = well & (rng.random(len(fill)) < rng.uniform(0.3, 0.9))
    injected = take[b]
    broken = np.zeros(a.max() + 1, bool)
    broken[a[injected]] = True
    displaced = broken[a] & ~injected
    kept = ~injected & ~displaced
    child = np.empty_like(a)
    _, child[kept] = np.unique(a[kept], return_inverse=True)
    n = int(child[kept].max()) + 1 if kept.any() else 0
    _, own = np.unique(b[injected], return_inverse=True)
    child[injected] = own + n
    there = kept | injected
    free = capacity - np.bincount(child[there], lengths[there]).astype(int) if there.any() else np.empty(0, int)
    at = np.flatnonzero(displaced)
    at = at[np.argsort(-lengths[at], kind="stable")]
    child[at] = Bins(capacity, free.tolist()).put(lengths[at].tolist())
    return child


def found(lengths: np.ndarray, capacity: int, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Best fit decreasing, and best fits of orders near it."""
    noise = [np.zeros(len(lengths))] + [rng.normal(0, lengths.std() * rng.uniform(0.02, 0.3) + 1e-9, len(lengths)) for _ in range(size - 1)]
    return [best_fit(lengths, np.argsort(-(lengths + x), kind="stable"), capacity) for x in noise]


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, generations: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The population, best first. A generation's child takes the worst one's place if it is better."""
    scored = sorted(((fitness(lengths, p, capacity), i, p) for i, p in enumerate(population)), key=lambda x: (-x[0], x[1]))
    for g in range(generations if len(lengths) > 1 else 0):
        i, j = rng.choice(len(scored), 2, replace=False) if len(scored) > 1 else (0, 0)
        child = crossover(lengths, scored[i][2], scored[j][2], capacity, rng)
        f = fitness(lengths, child, capacity)
        if f > scored[-1][0]:
            scored[-1] = (f, len(population) + g, child)
            scored.sort(key=lambda x: (-x[0], x[1]))
    return [p for _, _, p in scored]


_STATE = "shard string, island int, lengths binary, population binary, elite binary, fitness double"
_ARROW = pa.schema([("shard", pa.string()), ("island", pa.int32()), ("lengths", pa.binary()), ("population", pa.binary()), ("elite", pa.binary()), ("fitness", pa.float64())])


def _state(shard: str, island: int, lengths: np.ndarray, population: list[np.ndarray], capacity: int) -> pa.Table:
    row = {"shard": shard, "island": island, "lengths": lengths.tobytes(), "population": b"".join(p.tobytes() for p in population), "elite": population[0].tobytes(), "fitness": fitness(lengths, population[0], capacity)}
    return pa.Table.from_pylist([row], _ARROW)


def _random(shard: str, island: int, turn: int) -> np.random.Generator:
    return np.random.default_rng([xxhash.xxh32_intdigest(shard), island, turn])


def _settle(capacity: int, size: int, generations: int):
    def run(group: pa.Table) -> pa.Table:
        shard, island = group.column("shard")[0].as_py(), group.column("island")[0].as_py()
        lengths = group.column("n").to_numpy()
        lengths, rng = lengths[np.lexsort((lengths, group.column("id").to_numpy()))], _random(shard, island, 0)
        return _state(shard, island, lengths, evolve(lengths, found(lengths, capacity, size, rng), capacity, generations, rng), capacity)

    return run


def _go_on(capacity: int, size: int, generations: int, turn: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        own = next(r for r in rows if r["guest"] is None)
        lengths = np.frombuffer(own["lengths"], np.int32)
        population = list(np.frombuffer(own["population"], np.int32).reshape(size, len(lengths)))
        population[-1] = np.frombuffer(next(r["guest"] for r in rows if r["guest"] is not None), np.int32)
        rng = _random(own["shard"], own["island"], turn)
        return _state(own["shard"], own["island"], lengths, evolve(lengths, population, capacity, generations, rng), capacity)

    return run


_PIECES = "shard string, id bigint, start bigint, n int, ids binary"
_BINS = "shard string, bin int, doc_ids array<bigint>, starts array<bigint>, lengths array<int>, used int, input_ids array<int>"


def _encode(path: str, capacity: int):
    """The tokens of (shard, id, text) in pieces of capacity, and a rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoding(path)
        kind = np.dtype(_kind(enc.n_vocab))
        for b in batches:
            out: list[tuple] = []
            for shard, i, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                ids = np.array(enc.encode_ordinary(text), kind)
                out += [(shard, i, at, min(capacity, len(ids) - at), ids[at : at + capacity].tobytes()) for at in range(0, len(ids), capacity)]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["shard", "id", "start", "n", "ids"])

    return run


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<i4"


def _lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, kind))


def _whole(path: str):
    """Pieces that fill a bin, as bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _kind(encoding(path)[0].n_vocab)
        for b in batches:
            n, one = b.column("n").to_numpy(), np.ones(b.num_rows, np.int32)
            ids = np.frombuffer(b"".join(b.column("ids").to_pylist()), kind).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("shard"), pa.nulls(b.num_rows, pa.int32()), _lists(b.column("id").to_numpy(), one, pa.int64()), _lists(b.column("start").to_numpy(), one, pa.int64()), _lists(n, one, pa.int32()), b.column("n"), _lists(ids, n, pa.int32())], [c.split()[0] for c in _BINS.split(", ")])

    return run


def _bins(path: str):
    """The bins of a shard, from its best packing and its pieces."""

    def run(best: pa.Table, pieces: pa.Table) -> pa.Table:
        kind = _kind(encoding(path)[0].n_vocab)
        of = np.frombuffer(best.column("elite")[0].as_py(), np.int32)
        texts = pieces.column("ids").to_pylist()
        id_, start, n = (pieces.column(c).to_numpy() for c in ("id", "start", "n"))
        order = np.array(sorted(range(len(texts)), key=lambda k: (id_[k], n[k], start[k], texts[k])))
        order = order[np.argsort(of, kind="stable")]
        sizes, used = np.bincount(of), np.bincount(of, n[order[np.argsort(np.argsort(of, kind="stable"))]]).astype(np.int32)
        ids = np.frombuffer(b"".join([texts[k] for k in order]), kind).astype(np.int32)
        columns = [pa.array([best.column("shard")[0].as_py()] * len(sizes), pa.string()), pa.array(np.arange(len(sizes)), pa.int32()), _lists(id_[order], sizes, pa.int64()), _lists(start[order], sizes, pa.int64()), _lists(n[order], sizes, pa.int32()), pa.array(used), _lists(ids, used, pa.int32())]
        return pa.Table.from_arrays(columns, [c.split()[0] for c in _BINS.split(", ")])

    return run


def pack(docs: DataFrame, capacity: int = 2048, text: str = "text", key: str = "doc_id", tokenizer: str = TOKENIZER, shard: Column | None = None, shard_docs: int = 4096, islands: int = 4, rounds: int = 3, population: int = 8, generations: int = 16) -> DataFrame:
    """Training windows: (shard, bin, doc_ids, starts, lengths, used, input_ids), where the i-th piece is lengths[i] tokens of doc_ids[i] from
    starts[i], and input_ids are the used tokens, at most capacity, piece behind piece.

    Texts are encoded whole with tokenizer, a file of byte-pair ranks; what looks like a control string is encoded as text. A document of capacity
    tokens or more is cut into full bins of its own, which have no number in the shard (bin is null), and a rest; the rests and all other
    documents are packed within shards of about shard_docs documents: by shard if given (say, runs of consecutive documents, so that a mix is
    kept), else by a hash of key and text. On each of islands islands a shard has its own population, which starts from best fits and evolves by
    bin-injecting crossover; after each of rounds rounds the best goes to the next island in the ring, and at last the best of all islands is taken.

    Null and empty texts have no tokens and are in no bin; nor are rows with a null key, which can't be named. White space has tokens. Texts in
    scripts without spaces are cut like others, by tokens. Repeated rows are packed as often as they occur. Ties go by key, then by length, start
    and tokens. An empty table gives no bins. Other columns, whatever their names, aren't read.
    """
    by = F.pmod(F.xxhash64(col(key), col(text)), F.lit(max(1, -(-docs.count() // shard_docs)))).cast("string") if shard is None else shard.cast("string")
    items = docs.where(col(key).isNotNull() & (F.length(col(text)) > 0)).select(by.alias("shard"), col(key).cast("bigint").alias("id"), col(text).cast("string").alias("text"))
    pieces = materialize(items.mapInArrow(_encode(tokenizer, capacity), _PIECES))
    rests = pieces.where(F.col("n") < capacity)
    spread = rests.select("shard", "id", "n", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    state = spread.groupBy("shard", "island").applyInArrow(_settle(capacity, population, generations), _STATE)
    for turn in range(1, rounds):
        own = F.struct("island", "lengths", "population", F.lit(None).cast("binary").alias("guest"))
        nothing = F.lit(None).cast("binary")
        sent = F.struct(((F.col("island") + 1) % islands).alias("island"), nothing.alias("lengths"), nothing.alias("population"), F.col("elite").alias("guest"))
        moved = state.select("shard", F.explode(F.array(own, sent)).alias("r")).select("shard", "r.*")
        state = moved.groupBy("shard", "island").applyInArrow(_go_on(capacity, population, generations, turn), _STATE)
    best = state.groupBy("shard").agg(F.max_by("elite", F.struct("fitness", -F.col("island"))).alias("elite"))
    packed = best.groupBy("shard").cogroup(rests.groupBy("shard")).applyInArrow(_bins(tokenizer), _BINS)
    return pieces.where(F.col("n") == capacity).mapInArrow(_whole(tokenizer), _BINS).unionByName(packed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
