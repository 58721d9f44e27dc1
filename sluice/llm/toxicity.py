"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh, table

_WORD = re.compile(r"\w+")
#: Words of a window, and from one window's start to the next one's; half of each window lies in the next.
WINDOW, STRIDE = 32, 16
#: Rows of the hashed word and character tables, and widths of an embedding and of a direction's state.
ROWS, WIDTH, STATE = 1 << 15, 8, 8
_KEPT = 500_000
#: Characters of a word, at most, and of the pieces of longer runs; half of each piece lies in the next.
LONG, PIECE = 128, 12
#: Factors of the inputs of the update, reset and new gates.
_HALVED = np.repeat(np.array([0.5, 0.5, 1], np.float32), STATE)


def word_row(word: str) -> int:
    return xxhash.xxh32_intdigest(word.encode("utf-8", "replace")) % ROWS


def words_of(text: str) -> list[str]:
    """The words of a text. Those of over LONG characters are parted at underscores, and parts still longer are cut into overlapping pieces."""
    words = _WORD.findall(text.lower())
    if not words or max(map(len, words)) <= LONG:
        return words
    out: list[str] = []
    for w in words:
        for part in [w] if len(w) <= LONG else re.findall("[^_]+", w) or [w]:
            out += [part] if len(part) <= LONG else [part[i : i + PIECE] for i in range(0, len(part) - PIECE // 2, PIECE // 2)]
    return out


def gram_rows(word: str) -> list[int]:
    """Rows of the distinct character 3- to 5-grams of the word with its borders."""
    w = f"<{word}>"
    grams = {w[i : i + n] for n in (3, 4, 5) for i in range(max(1, len(w) - n + 1))}
    return sorted(xxhash.xxh32_intdigest(g.encode("utf-8", "replace"), 1) % ROWS for g in grams)


def starts(n: int) -> list[int]:
    """The starts of all windows over n words; the last window ends with the text."""
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW] if n > WINDOW else [0]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    words: np.ndarray
    grams: np.ndarray
    w: np.ndarray  # (2, 2 WIDTH, 3 STATE): input weights of the update, reset and new gates, for both directions
    u: np.ndarray  # (2, STATE, 3 STATE)
    b: np.ndarray  # (2, 3 STATE)
    attend: np.ndarray  # (2 STATE,)
    out: np.ndarray  # (2 STATE + 1,)
    threshold: float = 0.5
    kept: dict[str, int] = field(default_factory=dict)
    inputs: np.ndarray | None = None

    NAMES = ("words", "grams", "w", "u", "b", "attend", "out")

    @staticmethod
    def new(seed: int) -> Model:
        rng = np.random.default_rng(seed)
        n = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        return Model(n(0.1, ROWS, WIDTH), n(0.1, ROWS, WIDTH), n(0.3, 2, 2 * WIDTH, 3 * STATE), n(0.3, 2, STATE, 3 * STATE), np.zeros((2, 3 * STATE), np.float32), n(0.3, 2 * STATE), n(0.3, 2 * STATE + 1))

    def ids(self, words: list[str]) -> np.ndarray:
        """Numbers of words whose gate inputs are kept; new ones are computed. The inputs of the sigmoids are halved: sigmoid(x) = (1 + tanh(x / 2)) / 2."""
        kept = self.kept
        if self.inputs is None or len(kept) > _KEPT:
            kept.clear()
            self.inputs = np.empty((2, 1024, 3 * STATE), np.float32)
        try:
            return np.fromiter(map(kept.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = [w for w in dict.fromkeys(words) if w not in kept]
        while len(kept) + len(new) > self.inputs.shape[1]:
            self.inputs = np.concatenate([self.inputs, np.empty_like(self.inputs)], axis=1)
        x = np.empty((len(new), 2 * WIDTH), np.float32)
        x[:, :WIDTH] = self.words[[word_row(w) for w in new]]
        rows = [gram_rows(w) for w in new]
        ends = np.cumsum([0, *map(len, rows)])
        x[:, WIDTH:] = np.add.reduceat(self.grams[np.concatenate(rows)], ends[:-1], axis=0) / np.sqrt(np.diff(ends))[:, None]
        at = len(kept)
        for d in (0, 1):
            self.inputs[d, at : at + len(new)] = (x @ self.w[d] + self.b[d]) * _HALVED
        kept.update((w, at + i) for i, w in enumerate(new))
        return np.fromiter(map(kept.__getitem__, words), np.int64, len(words))

    def logits(self, ids: np.ndarray) -> np.ndarray:
        """Of windows (windows, words) of one length. Arrays have the windows last, so that every operation runs along them."""
        n, length = ids.shape
        steps, states = np.ascontiguousarray(ids.T), np.empty((length, 2 * STATE, n), np.float32)
        for d in (0, 1):
            inputs, u = self.inputs[d], np.ascontiguousarray((self.u[d] * _HALVED).T)
            h, y = np.zeros((STATE, n), np.float32), np.empty((3 * STATE, n), np.float32)
            for t in range(length) if d == 0 else range(length - 1, -1, -1):
                x = inputs.take(steps[t], axis=0).T
                np.matmul(u, h, out=y)
                gates, new = y[: 2 * STATE], y[2 * STATE :]
                gates += x[: 2 * STATE]
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                new *= gates[STATE:]
                new += x[2 * STATE :]
                np.tanh(new, out=new)
                new -= h
                new *= gates[:STATE]
                h += new
                states[t, d * STATE : (d + 1) * STATE] = h
        a = np.einsum("k,tkn->tn", self.attend, states)
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        return self.out[:-1] @ np.einsum("tn,tkn->kn", a, states) + self.out[-1]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The greatest probability of any window of each text; 0 for a text without words."""
        best = np.full(len(texts), -np.inf)
        pending: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        waiting: dict[int, int] = {}

        def flush(length: int) -> None:
            waiting[length] = 0
            windows, owners = (np.concatenate(x) for x in pending.pop(length))
            for k in range(0, len(owners), 1024):
                np.maximum.at(best, owners[k : k + 1024], self.logits(windows[k : k + 1024]))

        for i, text in enumerate(texts):
            words = words_of(text) if text else []
            if not words:
                continue
            if len(self.kept) > _KEPT:
                for length in list(pending):
                    flush(length)
            ids, length = self.ids(words), min(len(words), WINDOW)
            windows, owners = pending.setdefault(length, ([], []))
            s = np.array(starts(len(words)))
            windows.append(ids[s[:, None] + np.arange(length)])
            owners.append(np.full(len(s), i))
            waiting[length] = waiting.get(length, 0) + len(s)
            if waiting[length] >= 1024:
                flush(length)
        for length in list(pending):
            flush(length)
        return np.where(np.isneginf(best), 0.0, sigmoid(best))


def _forward_backward(m: Model, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Loss and gradients for inputs x (length, windows, 2 WIDTH) with windows of bag i labelled y[i]; a bag's logit is the log of its windows' summed exponentials."""
    length, n, _ = x.shape
    H, tape = np.empty((length, n, 2 * STATE), np.float32), []
    for d in (0, 1):
        h, steps = np.zeros((n, STATE), np.float32), []
        xs = x @ m.w[d] + m.b[d]
        for t in range(length) if d == 0 else range(length - 1, -1, -1):
            g = h @ m.u[d]
            gates = np.tanh((xs[t, :, : 2 * STATE] + g[:, : 2 * STATE]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            z, r, gc = gates[:, :STATE], gates[:, STATE:], g[:, 2 * STATE :]
            c = np.tanh(xs[t, :, 2 * STATE :] + r * gc)
            steps.append((t, h, z, r, c, gc))
            h = h + z * (c - h)
            H[t, :, d * STATE : (d + 1) * STATE] = h
        tape.append(steps)
    a = H @ m.attend
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tn,tnk->nk", a, H)
    logit = pooled @ m.out[:-1] + m.out[-1]
    top = np.full(len(y), -np.inf)
    np.maximum.at(top, bag, logit)
    e = np.exp(logit - top[bag])
    total = np.bincount(bag, e, len(y))
    p = sigmoid(top + np.log(total))
    loss = float(-np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))
    dlogit = (((p - y) / len(y))[bag] * e / total[bag]).astype(np.float32)
    grad = {k: np.zeros_like(getattr(m, k)) for k in ("w", "u", "b", "attend", "out")}
    grad["out"][:-1], grad["out"][-1] = pooled.T @ dlogit, dlogit.sum()
    dpooled = dlogit[:, None] * m.out[:-1]
    dH = a[:, :, None] * dpooled
    da = np.einsum("tnk,nk->tn", H, dpooled)
    da = a * (da - (a * da).sum(axis=0))
    grad["attend"] = np.einsum("tn,tnk->k", da, H)
    dH += da[:, :, None] * m.attend
    dx = np.zeros_like(x)
    for d in (0, 1):
        dh = np.zeros((n, STATE), np.float32)
        for t, h, z, r, c, gc in reversed(tape[d]):
            dh = dh + dH[t, :, d * STATE : (d + 1) * STATE]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - h) * z * (1 - z)
            dr = dc * gc * r * (1 - r)
            dxs, dg = np.concatenate([dz, dr, dc], axis=1), np.concatenate([dz, dr, dc * r], axis=1)
            grad["w"][d] += x[t].T @ dxs
            grad["b"][d] += dxs.sum(axis=0)
            grad["u"][d] += h.T @ dg
            dx[t] += dxs @ m.w[d].T
            dh = dh * (1 - z) + dg @ m.u[d].T
    return loss, grad, dx


class Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        """Moments of table rows that have no gradient rest."""
        m, v = self.m.setdefault(name, np.zeros_like(value)), self.v.setdefault(name, np.zeros_like(value))
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        v[rows] = 0.99 * v[rows] + 0.01 * grad * grad
        value[rows] -= self.rate * (m[rows] / (1 - 0.9**self.t)) / (np.sqrt(v[rows] / (1 - 0.99**self.t)) + 1e-8)


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, and the sum of the values of each."""
    order = np.argsort(rows, kind="stable")
    own = rows[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return own[first], np.add.reduceat(values[order], first, axis=0)


def train(texts: list[str], labels: list[int], epochs: int = 6, steps: int = 240, seed: int = 3, batch: int = 48, rate: float = 0.02) -> Model | None:
    """A model fitted on four fifths of the texts, its threshold on the other fifth; None unless both labels are there.

    There are epochs epochs, or as many as it takes to make steps steps where the texts are few. In each, texts of the rarer class come several
    times, so that the classes weigh alike. All windows of a text are read each time; it is taken to be toxic if one of them is.
    """
    rng = np.random.default_rng(seed)
    at = [(words_of(t), y) for t, y in zip(texts, labels) if t]
    at = [(w, y) for w, y in at if w]
    at = [at[i] for i in rng.permutation(len(at))]
    held, fit = at[: len(at) // 5], at[len(at) // 5 :]
    if len({y for _, y in fit}) < 2:
        return None
    m, adam = Model.new(seed), Adam(rate)
    vocabulary: dict[str, int] = {}
    numbered = [(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words]), y) for words, y in fit]
    word_of = np.array([word_row(w) for w in vocabulary])
    grams_of = [np.array(gram_rows(w)) for w in vocabulary]
    of = [[i for i, (_, y) in enumerate(numbered) if y == label] for label in (0, 1)]
    fewer, more = sorted(of, key=len)
    seen = np.array(more + fewer * max(1, len(more) // len(fewer)))
    epochs = max(epochs, -(-steps // -(-len(seen) // batch)))
    for epoch in range(epochs):
        adam.rate = rate * (1 - 0.8 * epoch / epochs)
        order = rng.permutation(seen)
        for i in range(0, len(order), batch):
            adam.t += 1
            chosen = [numbered[j] for j in order[i : i + batch]]
            windows, owners = [], []
            for k, (ids, _) in enumerate(chosen):
                s = np.array(starts(len(ids)))
                # a short text is repeated here; in scoring it has windows of its own length
                windows.append(np.resize(ids, WINDOW)[None] if len(ids) < WINDOW else ids[s[:, None] + np.arange(WINDOW)])
                owners.append(np.full(len(s), k))
            ids = np.concatenate(windows)
            unique, inverse = np.unique(ids, return_inverse=True)
            rows = [grams_of[j] for j in unique]
            sizes = np.array([len(r) for r in rows])
            flat, scale = np.concatenate(rows), np.sqrt(sizes)[:, None].astype(np.float32)
            ends = np.cumsum(sizes) - sizes
            x = np.concatenate([m.words[word_of[unique]], np.add.reduceat(m.grams[flat], ends, axis=0) / scale], axis=1)
            _, grad, dx = _forward_backward(m, x[inverse.reshape(ids.shape)].transpose(1, 0, 2), np.concatenate(owners), np.array([y for _, y in chosen], np.float32))
            _, du = _summed(inverse.reshape(ids.shape).T.ravel(), dx.reshape(-1, 2 * WIDTH))
            for name, g in grad.items():
                adam.step(name, getattr(m, name), g)
            for name, own, d in (("words", word_of[unique], du[:, :WIDTH]), ("grams", flat, np.repeat(du[:, WIDTH:] / scale, sizes, axis=0))):
                at_rows, total = _summed(own, d)
                adam.step(name, getattr(m, name), total, at_rows)
    m.threshold = pick_threshold(m.scores([" ".join(w) for w, _ in held]), np.array([y for _, y in held]))
    return m


def pick_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The cut of greatest F0.5, in which precision counts double; in the middle of the gap."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    hit, n = np.cumsum(y), np.arange(1, len(y) + 1)
    if not len(y) or not hit[-1]:
        return 0.5
    ok = np.append(s[:-1] > s[1:], True)
    f = np.where(ok, 1.25 * hit / (n + 0.25 * hit[-1]), -1)
    k = int(f.argmax())
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)


def sample(docs: DataFrame, labels: DataFrame, per_class: int, text: str, key: str) -> tuple[list[str], list[int]]:
    """Up to per_class labelled texts of each class, the first by a hash of the key."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    rows = docs.where(col(text).isNotNull()).select(col(key).alias("doc_id"), col(text).alias("t")).join(chosen[0].unionByName(chosen[1]), "doc_id").select("doc_id", "t", "toxic").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["t"]))
    return [r["t"] for r in rows], [r["toxic"] for r in rows]


def score(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", per_class: int = 1500, **training) -> DataFrame:
    """docs with columns toxic_score (of the worst of all overlapping windows, in [0, 1]) and toxic_flag (score over the fitted threshold).

    The model is fitted on up to per_class labelled texts of each class; labels has (doc_id, toxic). With no text of one of the classes there
    is no model: scores are null and no flag is set. Null, empty and wordless texts score 0. Texts are scored whole, whatever their length,
    and so are runs without spaces, in pieces.
    Rows with a null key are scored like others. Repeated rows and ties score alike. An empty table gives an empty one. Where other columns
    have these names, those of the new ones get longer.
    """
    value, flag = fresh(docs, "toxic_score", "toxic_flag")
    model = train(*sample(docs, labels, per_class, text, key), **training)
    if model is None:
        return docs.withColumns({value: F.lit(None).cast("double"), flag: F.lit(False)})
    model.kept, model.inputs = {}, None
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(sent.value.scores(batch.tolist()))

    return docs.withColumn(value, judge(col(text))).withColumn(flag, col(value) > model.threshold)


def keep_clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without those that score() flags, with the columns they had."""
    out = score(docs, labels, **options)
    return out.where(~col(out.columns[-1])).select(*[col(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "toxic_score", "toxic_flag")
