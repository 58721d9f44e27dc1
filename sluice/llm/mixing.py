"""Mixing sources to target weights: Pfair release times and deadlines for blocks of each source, run earliest deadline first."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, fresh, materialize, table

#: Documents that one window task ranks, about.
BUCKET_ROWS = 2_000
#: Numbers in a table of sources that is broadcast, at most.
BROADCAST_ITEMS = 1_000_000
#: Blocks of a source whose slots are one row of the table of slots.
CHUNK = 1024


def apportion(weights: Mapping[str, float], parts: int) -> dict[str, int]:
    """parts whole parts (more, if there are more sources) shared out by largest remainders; sources that would have less than one get one."""
    parts = max(parts, len(weights))
    small: set[str] = set()
    while True:
        free, total = parts - len(small), sum(w for s, w in weights.items() if s not in small)
        exact = {s: w / total * free for s, w in weights.items() if s not in small}
        less = {s for s, x in exact.items() if x < 1}
        if not less or len(less) == len(exact):
            break
        small |= less
    out = dict.fromkeys(weights, 1) | {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: parts - sum(out.values())]:
        out[s] += 1
    return out


def edf_period(shares: Mapping[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period of sum(shares) slots.

    Block i of a source with c of L parts is released at floor(i L / c) and due at ceil((i + 1) L / c). At each slot runs, of the blocks
    released, the one due first. As the shares fill the period, no block is late, all are done at its end, and the next one is alike.
    """
    length = sum(shares.values())
    waiting = sorted((i * length // c, -(-(i + 1) * length // c), s) for s, c in shares.items() for i in range(c))
    out: dict[str, list[int]] = {s: [] for s in shares}
    ready: list[tuple[int, str]] = []
    at = 0
    for slot in range(length):
        while at < len(waiting) and waiting[at][0] <= slot:
            heapq.heappush(ready, waiting[at][1:])
            at += 1
        due, s = heapq.heappop(ready)
        assert slot < due
        out[s].append(slot)
    return out


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float], resolution: int) -> list[tuple]:
    """Phases (source, first block, block after the last, first slot, shares, period, offsets); a new one begins when a source runs out.

    Sources of no or zero weight follow when all the others are used up, in proportion to their blocks.
    """
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    slot, out = 0, []
    while left:
        now = {s: weights[s] for s in left if weights.get(s, 0) > 0} or {s: float(blocks[s]) for s in left}
        shares = apportion(now, resolution)
        length, at = sum(shares.values()), edf_period(shares)
        ends = min(left[s] // c * length + at[s][left[s] % c] for s, c in shares.items())
        for s, c in shares.items():
            n = ends // length * c + bisect_left(at[s], ends % length)
            out.append((s, done[s], done[s] + n, slot, c, length, at[s]))
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        slot += ends
    return out


def whole_run(blocks: Mapping[str, int], weights: Mapping[str, float]) -> dict[str, list[int]]:
    """The slots of each source's blocks, in exact arithmetic, over the whole run.

    Were blocks divisible, source s would have min(w v, n) of its n blocks when sum of min(w v, n) over all sources slots are over, at some v.
    Block i is released in the slot where that share passes i and is due at the end of the one where it reaches i + 1. At each slot runs, of
    the blocks released, the one due first; as the shares fill every slot, none is late, so that each source is within one block of its
    share after every slot, also after others ran out. Sources of no or zero weight follow, in proportion to their blocks.
    """
    out: dict[str, list[int]] = {}
    begin = 0
    given = {s for s, n in blocks.items() if n and weights.get(s, 0) > 0}
    for group in (sorted(given), sorted(s for s, n in blocks.items() if n and s not in given)):
        if not group:
            continue
        ratio = {s: Fraction(weights[s] if s in given else blocks[s]) for s in group}
        unit = math.lcm(*(x.denominator for x in ratio.values()))
        w = {s: int(x * unit) for s, x in ratio.items()}
        # between the points at which sources run out, the slots over are used + rate v
        order = sorted(group, key=lambda s: Fraction(blocks[s], w[s]))
        points = [Fraction(blocks[s], w[s]) for s in order]
        used, rate = [0], [sum(w.values())]
        for s in order:
            used.append(used[-1] + blocks[s])
            rate.append(rate[-1] - w[s])
        out |= {s: [] for s in group}
        segment = dict.fromkeys(group, 0)
        waiting, ready = [(0, s) for s in group], []
        for slot in range(used[-1]):
            while waiting and waiting[0][0] <= slot:
                s = heapq.heappop(waiting)[1]
                i, k = len(out[s]) + 1, segment[s]
                if i * points[k].denominator > points[k].numerator * w[s]:
                    k = segment[s] = bisect_left(points, Fraction(i, w[s]), k)
                heapq.heappush(ready, (used[k] - (-rate[k] * i // w[s]), s))
            due, s = heapq.heappop(ready)
            assert slot < due
            out[s].append(begin + slot)
            i, k = len(out[s]), segment[s]
            if i < blocks[s]:
                heapq.heappush(waiting, (used[k] + rate[k] * i // w[s], s))
        begin += used[-1]
    return out


def block_slots(blocks: Mapping[str, int], weights: Mapping[str, float], resolution: int | None) -> dict[str, list[int]]:
    """The slots of each source's blocks: by exact weights, or by weights rounded to parts of resolution."""
    if resolution is None:
        return whole_run(blocks, weights)
    out: dict[str, list[int]] = {}
    for s, lo, hi, first, c, length, offsets in schedule(blocks, weights, resolution):
        out.setdefault(s, []).extend(first + k // c * length + offsets[k % c] for k in range(hi - lo))
    return out


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", weights: Mapping[str | None, float] | None = None, alpha: float = 0.5, block_docs: int = 16, resolution: int | None = None, seed: int = 7) -> DataFrame:
    """docs in mixed order, with columns mix_slot (the place of the document's block) and mix_rank (its place in its source) at the end.

    Each source is put in a pseudo-random order and cut into blocks of block_docs documents; slots go to the sources' blocks so that after
    any number of slots each source has had its weight's part of them to within one block. weights has the target weights by source, in
    any unit; None stands for sizes to the power of alpha. They are kept exactly, however many slots and sources there are; with a resolution
    they are first rounded to that many parts, at least one for each source. When a source runs out, the others go on in proportion; sources
    of no weight come last. So every document has its place.

    A null source is a source of its own. Null keys go by the hash of the other columns, ties and repeated rows too; equal rows may change
    places unseen. Texts aren't looked at. An empty table gives an empty one. Clashing names of other columns make the new names longer.

    Of the counts, one row for each source comes to the driver, which finds the slot of every block and sends them out. Ranks come from counts of hash buckets of about BUCKET_ROWS documents, so a
    hot source is ranked by many tasks.
    """
    spark = docs.sparkSession
    slot, rank, sk, bucket, h, n_buckets, at, start, block, chunk, slots_of = fresh(docs, "mix_slot", "mix_rank", "mix_source", "mix_bucket", "mix_hash", "mix_buckets", "mix_at", "mix_start", "mix_block", "mix_chunk", "mix_slots")
    name = F.coalesce(F.concat(F.lit("="), col(source).cast("string")), F.lit("null"))
    sizes = {r["s"]: r["n"] for r in docs.groupBy(name.alias("s")).agg(F.count("*").alias("n")).collect()}
    target = {s: n**alpha for s, n in sizes.items()} if weights is None else {"null" if s is None else f"={s}": float(w) for s, w in weights.items()}
    run = block_slots({s: -(-n // block_docs) for s, n in sizes.items()}, target, resolution)
    of_source = spark.createDataFrame([(s, -(-n // BUCKET_ROWS)) for s, n in sizes.items()], f"{sk} string, {n_buckets} bigint")
    pieces = [(s, k // CHUNK, x[k : k + CHUNK]) for s, x in run.items() for k in range(0, len(x), CHUNK)]
    of_chunk = spark.createDataFrame(pieces, f"{sk} string, {chunk} bigint, {slots_of} array<bigint>")

    def small(df: DataFrame, items: int) -> DataFrame:
        # a join by source would bring a hot source to one task; a broadcast is held to BROADCAST_ITEMS numbers
        return F.broadcast(df) if items <= BROADCAST_ITEMS else df

    def placed(df: DataFrame) -> DataFrame:
        keyed = df.withColumns({sk: name, h: F.xxhash64(F.lit(seed), col(key))})
        return keyed.join(small(of_source, len(sizes)), sk).withColumn(bucket, F.pmod(col(h), col(n_buckets))).drop(n_buckets)

    counts = placed(docs.select(col(source), col(key))).groupBy(sk, bucket).agg(F.count("*").alias("n"))
    before = Window.partitionBy(sk).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select(sk, bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start)))
    plain = [col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    inside = Window.partitionBy(sk, bucket).orderBy(col(h), col(key), F.xxhash64(*plain))
    ranked = placed(docs).withColumn(at, F.row_number().over(inside) - 1).join(starts, [sk, bucket]).withColumn(rank, F.col(start) + F.col(at))
    slots = sum(map(len, run.values()))
    numbered = ranked.withColumn(block, F.floor(col(rank) / block_docs).cast("bigint")).withColumn(chunk, F.floor(col(block) / CHUNK).cast("bigint"))
    timed = numbered.join(small(of_chunk, slots), [sk, chunk]).withColumn(slot, F.element_at(slots_of, (col(block) % CHUNK).cast("int") + 1))
    out = timed.select(*[col(c) for c in docs.columns], slot, rank)
    slots = max(1, slots)
    parts = max(1, min(slots, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return out.repartitionById(parts, F.floor(col(slot) * parts / slots).cast("int")).sortWithinPartitions(slot, rank)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
