import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import toxicity as tox
from sluice.llm.toxicity import STRIDE, WINDOW, Model, keep_clean, pick_threshold, sample, score, starts, train

DOCS, LABELS = "doc_id bigint, text string", "doc_id bigint, toxic int"
BAD = "vile scum filth rot".split()


def corpus(rng, prose, n=240):
    """Half of the texts have a run of vile words somewhere."""
    out = []
    for i in range(n):
        words = prose(rng, rng.randint(5, 150), 300).split()
        if i % 2:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(BAD) for _ in range(6)]
        out.append((i, " ".join(words), i % 2))
    return out


@pytest.fixture(scope="module")
def model(prose):
    import random

    rows = corpus(random.Random(1), prose)
    return train([t for _, t, _ in rows], [y for _, _, y in rows])


@pytest.mark.parametrize("n", [1, 31, 32, 33, 48, 49, 1000])
def test_windows_cover_every_word_and_overlap(n):
    s = starts(n)
    covered = {w for a in s for w in range(a, min(n, a + WINDOW))}
    assert covered == set(range(n)) and all(b - a <= STRIDE for a, b in zip(s, s[1:]))


def test_gradients():
    rng = np.random.default_rng(0)
    m = Model.new(2)
    for k in ("w", "u", "b", "attend", "out"):
        setattr(m, k, getattr(m, k).astype(np.float64))
    x, bag, y = rng.normal(size=(5, 4, 2 * tox.WIDTH)), np.array([0, 0, 1, 1]), np.array([1.0, 0.0])
    _, grad, dx = tox._forward_backward(m, x, bag, y)
    def loss():
        return tox._forward_backward(m, x, bag, y)[0]

    for value, got in [(getattr(m, k), grad[k]) for k in grad] + [(x, dx)]:
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in value.shape)
            old, e = value[at], 1e-2
            value[at] = old + e
            up = loss()
            value[at] = old - e
            down = loss()
            value[at] = old
            assert (up - down) / (2 * e) == pytest.approx(got[at], abs=3e-3)


def plain_score(m, text):
    """Window by window and step by step."""
    words = text.lower().split()
    best = -np.inf
    for a in starts(len(words)):
        xs = [np.concatenate([m.words[tox.word_row(w)], m.grams[g].sum(axis=0) / np.sqrt(len(g))]) for w in words[a : a + WINDOW] for g in [tox.gram_rows(w)]]
        states = np.zeros((len(xs), 2 * tox.STATE))
        for d in (0, 1):
            h = np.zeros(tox.STATE)
            for t in range(len(xs)) if d == 0 else reversed(range(len(xs))):
                i, g = xs[t] @ m.w[d] + m.b[d], h @ m.u[d]
                z, r = (tox.sigmoid(i[k : k + tox.STATE] + g[k : k + tox.STATE]) for k in (0, tox.STATE))
                c = np.tanh(i[2 * tox.STATE :] + r * g[2 * tox.STATE :])
                h = h + z * (c - h)
                states[t, d * tox.STATE : (d + 1) * tox.STATE] = h
        a = np.exp(states @ m.attend)
        best = max(best, (a / a.sum()) @ states @ m.out[:-1] + m.out[-1])
    return tox.sigmoid(best)


def test_scores_are_of_the_worst_window(model, rng, prose):
    texts = [prose(rng, n, 300) for n in (1, 2, 7, 31, 32, 33, 200, 1500)]
    texts += [prose(rng, 500, 300) + " " + " ".join(BAD * 2) + " " + prose(rng, 700, 300)]
    got = model.scores(texts)
    assert got == pytest.approx([plain_score(model, t) for t in texts], abs=1e-4)
    assert got[-1] > max(got[:-1])


def test_held_out(model, prose):
    import random

    rows = corpus(random.Random(2), prose, 400)
    flag = model.scores([t for _, t, _ in rows]) > model.threshold
    y = np.array([y for _, _, y in rows], bool)
    assert (flag == y).mean() > 0.93


def test_held_out_on_the_tables(spark):
    """Fitted on half of the labelled documents, held against the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where(F.xxhash64("doc_id") % 2 == 0)
    rest = labels.join(half, "doc_id", "left_anti")
    m = train(*sample(docs, half, 1500, "text", "doc_id"))
    rows = docs.join(rest, "doc_id").collect()
    flag, y = m.scores([r["text"] for r in rows]) > m.threshold, np.array([r["toxic"] for r in rows], bool)
    assert y.sum() >= 50 and (flag & y).sum() >= 0.9 * y.sum() and (flag & ~y).sum() <= 0.02 * (~y).sum()


def test_threshold():
    s, y = np.array([0.9, 0.8, 0.4, 0.1]), np.array([1, 1, 0, 0])
    assert pick_threshold(s, y) == pytest.approx(0.6)
    assert pick_threshold(s, np.zeros(4, int)) == 0.5 == pick_threshold(s[:0], y[:0])


def test_nulls_ties_and_clashes(table, rng, prose):
    rows = corpus(rng, prose)
    labels = table([(i, y) for i, _, y in rows] + [(None, 1), (7, None), (3, 1), (3, 1)], LABELS)
    vile = " ".join(BAD * 3)
    extra = [(None, vile), (900, None), (901, ""), (902, "!?"), (903, vile), (903, vile), (904, prose(rng, 30_000, 300) + " " + vile)]
    df = table([(i, t) for i, t, _ in rows] + extra, DOCS, clash=True)
    out = score(df, labels)
    value, flag = out.columns[-2:]
    assert out.columns[:-2] == df.columns and value == "toxic_score_"
    got = [(r["doc_id"], r[value], r[flag]) for r in out.collect() if r["doc_id"] is None or r["doc_id"] >= 900]
    assert [(i, f) for i, _, f in got] == [(None, True), (900, False), (901, False), (902, False), (903, True), (903, True), (904, True)]
    assert [s for i, s, _ in got if i in (900, 901, 902)] == [0, 0, 0]
    kept = keep_clean(df, labels)
    assert kept.columns == df.columns and not {903, 904} & {r["doc_id"] for r in kept.collect()}


def test_without_one_of_the_classes_nothing_goes(table):
    docs = table([(1, "a b"), (2, None)], DOCS)
    for labels in ([], [(1, 0)], [(1, 1)]):
        assert keep_clean(docs, table(labels, LABELS)).count() == 2
    assert score(table([], DOCS), table([], LABELS)).collect() == []


@pytest.mark.parametrize("run", ["_".join, "".join])
def test_toxic_passage_inside_one_long_run(model, prose, rng, run):
    clean = [prose(rng, 120, 300).split() for _ in range(6)]
    toxic = [[*w[:60], *(rng.choice(BAD) for _ in range(8)), *w[60:]] for w in clean]
    low, high = model.scores([run(w) for w in clean]), model.scores([run(w) for w in toxic])
    assert (high > low).all() and (high > model.threshold).all()


def test_long_runs_are_read_whole():
    run = "".join(chr(0x4E00 + i) for i in range(1001))
    pieces = tox.words_of(f"a {run} b_c")
    assert pieces[0] == "a" and pieces[-1] == "b_c" and max(map(len, pieces)) <= tox.LONG
    assert all(any(run[i : i + 5] in p for p in pieces) for i in range(len(run) - 4))
    assert tox.words_of("_" * 300)
