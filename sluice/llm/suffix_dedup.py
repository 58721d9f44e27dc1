"""Suffix-array dedup: passages that documents share, from suffix arrays of shards built by induced sorting."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, materialize, one_row_per_id, table

#: Words of the shortest passage, and of the grams by whose least hash equal passages come to the same shard.
PASSAGE, GRAM = 50, 8
#: Words hashed at once; a position in them has _BITS bits.
_BITS = 20
_CHUNK = 1 << 19
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_KEPT = 500_000


# Suffix arrays


def suffix_array(s: Sequence[int]) -> list[int]:
    """Of integers from 0 on, of which the last is less than all others: by induced sorting."""
    a = np.asarray(s, np.int64)
    n = len(a)
    if n == 1:
        return [0]
    # Classify: S if less than the next suffix. Equal neighbours are as the next one that differs.
    step = np.sign(np.diff(a))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    small = np.append(np.where(nearest < n - 1, step[np.minimum(nearest, n - 2)] > 0, False), True)
    small[-1] = True
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ends = np.cumsum(np.bincount(a))
    heads = ends - np.bincount(a)
    text, is_small = a.tolist(), small.tolist()

    def induce(sorted_lms: np.ndarray) -> list[int]:
        """The suffix array, if sorted_lms has the leftmost-smaller suffixes in order."""
        sa = np.full(n, -1, np.int64)
        c = a[sorted_lms]
        back = np.arange(len(c))
        # their places at the ends of their buckets, in the order given
        first = np.searchsorted(c, c, "left")
        count = np.searchsorted(c, c, "right") - first
        sa[ends[c] - count + back - first] = sorted_lms
        out = sa.tolist()
        head, tail = heads.tolist(), ends.tolist()
        for j in out:  # the list grows ahead of the place read
            if j > 0:
                j -= 1
                if not is_small[j]:
                    x = text[j]
                    out[head[x]] = j
                    head[x] += 1
        for i in range(n - 1, -1, -1):
            j = out[i]
            if j > 0:
                j -= 1
                if is_small[j]:
                    x = text[j]
                    tail[x] -= 1
                    out[tail[x]] = j
        return out

    if not len(lms):
        return induce(lms)
    order = lms[np.argsort(a[lms], kind="stable")]
    first = np.array(induce(order))
    # Sort leftmost-smaller substrings: name them in the order found, and sort the names' suffixes where names repeat.
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by = first[is_lms[first]].tolist()
    stop = dict(zip(lms.tolist(), [*(lms[1:] + 1).tolist(), n]))
    name, names, before = -1, {}, None
    for i in by:
        now = text[i : stop[i]]
        if now != before:
            name += 1
            before = now
        names[i] = name
    if name + 1 < len(lms):
        deeper = suffix_array([names[i] for i in lms.tolist()])
        by = lms[deeper].tolist()
    return induce(np.array(by))


def common_prefixes(s: Sequence[int], sa: list[int]) -> np.ndarray:
    """For each place of sa the length of the prefix its suffix shares with the one before: computed in the order of the text (permuted)."""
    n = len(sa)
    before = [-1] * n
    for a, b in zip(sa, sa[1:]):
        before[b] = a
    out, k = [0] * n, 0
    for i in range(n):
        j = before[i]
        if j < 0:
            k = 0
            continue
        while s[i + k] == s[j + k]:  # the last item is like no other
            k += 1
        out[i] = k
        if k:
            k -= 1
    return np.array(out, np.int64)[sa]


# Anchors


def least_grams(words: np.ndarray, bounds: np.ndarray, passage: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of passage words that have the same least gram: (its hash, document, first start, last start, hash of the run's words).

    words has 64-bit hashes of fewer than 2**_BITS words, bounds the ends of the documents in them.
    """
    span = passage - GRAM + 1
    n = len(words)
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    if n < passage:
        return none
    with np.errstate(over="ignore"):
        gram = np.zeros(n - GRAM + 1, np.uint64)
        for k in range(GRAM):
            gram = gram * _BASE + words[k : k + len(gram)]
        gram ^= gram >> np.uint64(29)
        gram *= _MIX
        gram ^= gram >> np.uint64(32)
        at = np.arange(len(gram), dtype=np.uint64)
        low = np.uint64((1 << _BITS) - 1)
        key = (gram & ~low) | at
        pad = np.full(-len(key) % span, np.iinfo(np.uint64).max, np.uint64)
        blocks = np.concatenate([key, pad]).reshape(-1, span)
        up = np.minimum.accumulate(blocks, axis=1).ravel()
        down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - passage + 1
        best = (np.minimum(down[:starts], up[span - 1 : span - 1 + starts]) & low).astype(np.int64)
        doc = np.searchsorted(bounds, np.arange(starts), "right")
        valid = np.arange(starts) + passage <= bounds[doc]
        new = np.ones(starts, bool)
        new[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new & valid)
        if not len(first):
            return none
        edge = np.flatnonzero(np.append(new | ~valid, True)[1:]) if starts else first
        last = edge[np.searchsorted(edge, first)]
        # hash of words[first : last + passage]
        run = np.zeros(len(first), np.uint64)
        length = last - first + passage
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(n), dtype=np.uint64)])
        run = (prefix[first + length] - prefix[first]) * _powers(-n)[first] + length.astype(np.uint64) * _MIX
        return gram[best[first]].view(np.int64), doc[first], first, last, run.view(np.int64)


def _powers(n: int) -> np.ndarray:
    """Powers of the base modulo 2**64, of its inverse for a negative n."""
    key = n < 0
    if key not in _POWERS or len(_POWERS[key]) < abs(n):
        base = np.uint64(pow(int(_BASE), -1, 1 << 64)) if key else _BASE
        with np.errstate(over="ignore"):
            _POWERS[key] = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(max(abs(n), 1 << _BITS) - 1, base, np.uint64))])
    return _POWERS[key][: abs(n)]


_POWERS: dict[bool, np.ndarray] = {}


class _Hashes:
    def __init__(self) -> None:
        self.of: dict[str, int] = {}

    def words(self, text: str) -> np.ndarray:
        words = text.split()
        try:
            return np.fromiter(map(self.of.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(self.of) > _KEPT:
                self.of.clear()
            for w in words:
                if w not in self.of:
                    self.of[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
            return np.fromiter(map(self.of.__getitem__, words), np.uint64, len(words))


def _anchors(passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()

        def pieces() -> Iterator[tuple[int, int, np.ndarray]]:
            """(document, offset, words); a text longer than a chunk in pieces that share all but one word of a passage."""
            for b in batches:
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    words = hashes.words(text)
                    for at in range(0, max(1, len(words) - passage + 1), _CHUNK):
                        if len(words) - at >= passage:
                            yield i, at, words[at : at + _CHUNK + passage - 1]

        def emit(held: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            bounds = np.cumsum([len(w) for _, _, w in held])
            gram, doc, first, last, run = least_grams(np.concatenate([w for _, _, w in held]), bounds, passage)
            shift = np.array([at for _, at, _ in held]) - np.concatenate([[0], bounds[:-1]])
            ids = np.array([i for i, _, _ in held], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(run), pa.array(ids[doc]), pa.array(first + shift[doc]), pa.array(last + shift[doc])], ["h", "c", "doc", "s0", "s1"])

        held: list[tuple[int, int, np.ndarray]] = []
        n = 0
        for p in pieces():
            if n + len(p[2]) >= 1 << _BITS or n > 1 << 18:
                yield from emit(held)
                held, n = [], 0
            held.append(p)
            n += len(p[2])
        yield from emit(held)

    return run


def _segments(passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            for doc, text, wanted in zip(*(b.column(k).to_pylist() for k in range(3))):
                words = (hashes.words(text) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                yield pa.RecordBatch.from_pydict({"h": [w["h"] for w in wanted], "c": [w["c"] for w in wanted], "doc": [doc] * len(wanted), "s0": [w["s0"] for w in wanted], "many": [w["many"] for w in wanted], "words": [words[w["s0"] : w["s1"] + passage].tobytes() for w in wanted]})

    return run


def _shared(passage: int):
    """For the segments of a shard: their runs of windows that another document has too."""

    def run(group: pa.Table) -> pa.Table:
        segments = [np.frombuffer(w, np.uint32) for w in group.column("words").to_pylist()]
        n, lengths = len(segments), np.array([len(s) for s in segments])
        doc, s0, many = (group.column(c).to_numpy() for c in ("doc", "s0", "many"))
        _, ranks = np.unique(np.concatenate(segments), return_inverse=True)
        starts = np.cumsum(lengths + 1) - lengths - 1
        text = np.empty(lengths.sum() + n + 1, np.int64)
        of = np.repeat(np.arange(n), lengths + 1)
        inside = np.ones(len(text), bool)
        inside[starts + lengths], inside[-1] = False, False
        text[inside] = ranks + n + 1
        text[starts + lengths], text[-1] = np.arange(1, n + 1), 0  # each segment ends with an item of its own
        sa = suffix_array(text)
        lcp = common_prefixes(text.tolist(), sa)
        sa = np.array(sa)
        alike = np.cumsum(lcp < passage) - 1
        size = np.bincount(alike)
        sa, alike = sa[size[alike] > 1], alike[size[alike] > 1]
        empty = pa.table({"h": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "first": pa.array([], pa.int64())})
        if not len(sa):
            return empty
        seg = of[sa]
        least, most, any_many = np.full(len(size), np.iinfo(np.int64).max), np.full(len(size), np.iinfo(np.int64).min), np.zeros(len(size), bool)
        np.minimum.at(least, alike, doc[seg])
        np.maximum.at(most, alike, doc[seg])
        np.logical_or.at(any_many, alike, many[seg].astype(bool))
        kept = (least < most)[alike] | any_many[alike]
        sa, first = sa[kept], least[alike[kept]]
        if not len(sa):
            return empty
        order = np.argsort(sa)
        sa, first = sa[order], first[order]
        seg = of[sa]
        new = np.append(True, (np.diff(sa) > 1) | (np.diff(seg) != 0))
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(sa)) - 1
        h, c = group.column("h").to_numpy(), group.column("c").to_numpy()
        return pa.table({"h": h[seg[at]], "c": c[seg[at]], "a": sa[at] - starts[seg[at]], "b": sa[last] - starts[seg[at]], "first": np.minimum.reduceat(first, at)})

    return run


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", passage: int = PASSAGE, shard_words: int = 200_000) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc_id): every longest run of words of which each lies in a passage of at least passage words that
    another document has too. Words are what white space separates, counted from 0; end_word is behind the last. first_doc_id is the least
    doc_id with one of the run's passages (of those that meet with this run in a suffix array or are copies of its windows).

    Each window of passage words is represented by its gram of least hash, so equal windows have equal ones. Runs of windows with the same
    gram are hashed. Runs that are equal all over are settled by their hash; where a gram's runs differ, one run of each kind comes with its
    words to the gram's shard, whose suffix array and common prefixes tell which windows are equal. The result is that of comparing all
    windows of all documents.

    Null, empty and short texts have no passages. Rows with a null key are left out; of rows that repeat a key one counts. Repeats within one
    document alone don't count. Ties in hashes go to the left. Texts of any length are taken whole. An empty table gives no spans. Other
    columns, whatever their names, aren't read.
    """
    docs = one_row_per_id(docs.select(col(key), col(text)), key).select(col(key).cast("bigint").alias("doc"), col(text).alias("t")).where("doc IS NOT NULL AND t IS NOT NULL")
    runs = materialize(docs.mapInArrow(_anchors(passage), "h bigint, c bigint, doc bigint, s0 bigint, s1 bigint"))
    per_gram = runs.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("lo < hi")
    met = materialize(runs.join(per_gram.select("h", (F.col("c0") < F.col("c1")).alias("differ")), "h"))
    kinds = met.groupBy("h", "c", "differ").agg(F.min(F.struct("doc", "s0", "s1")).alias("r"), F.max("doc").alias("hi"))
    kinds = materialize(kinds.select("h", "c", "differ", "r.*", (F.col("hi") > F.col("r.doc")).alias("many")))
    alike = met.join(kinds.where("many").select("h", "c", F.col("doc").alias("first")), ["h", "c"]).select("doc", F.col("s0").alias("a"), (F.col("s1") + passage).alias("b"), "first")
    wanted = kinds.where("differ").groupBy("doc").agg(F.collect_list(F.struct("h", "c", "s0", "s1", "many")).alias("wanted"))
    segments = docs.join(wanted, "doc").select("doc", "t", "wanted").mapInArrow(_segments(passage), "h bigint, c bigint, doc bigint, s0 bigint, many boolean, words binary")
    words = kinds.where("differ").agg(F.sum(F.col("s1") - F.col("s0") + passage)).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    found = segments.groupBy(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard")).applyInArrow(_shared(passage), "h bigint, c bigint, a bigint, b bigint, first bigint")
    partial = met.where("differ").join(found, ["h", "c"]).select("doc", (F.col("s0") + F.col("a")).alias("a"), (F.col("s0") + F.col("b") + passage).alias("b"), "first")
    spans = alike.unionByName(partial)
    order = Window.partitionBy("doc").orderBy("a", F.desc("b"))
    behind = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", (F.coalesce(behind, F.lit(-1)) < F.col("a")).cast("int")).withColumn("n", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc", "n").agg(F.min("a").alias("start_word"), F.max("b").alias("end_word"), F.min("first").alias("first_doc_id")).select(F.col("doc").alias("doc_id"), "start_word", "end_word", "first_doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
