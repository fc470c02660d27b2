"""Language model: counts and base scores against brute force, gradients, carried state, held-out gain, hostile rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from keystrata.llm import lm_scoring as lm

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(t):
    return [*WORD.findall((t or "").encode().lower()), None]


def corpus(n):
    rng = np.random.default_rng(2)
    langs = [[f"{p}{i}" for i in range(80)] for p in ("ab", "cd", "ef")]
    return [(i, " ".join(rng.choice(langs[i % 3], rng.integers(1, 90), p=np.arange(80, 0, -1) / 3240))) for i in range(n)]


def test_scores(spark):
    rows = [*corpus(700), (7000, None), (7001, ""), (7002, "AB1  ab1\tzzz\nunseen-word"), (None, "ab1"), (3, "another text of this id"), (7002, "AB1  ab1\tzzz\nunseen-word")]
    d = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, base string")
    got = sorted((tuple(r) for r in lm.score(d).collect()), key=str)
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        w = words(t)
        want.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    want.sort(key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in got], [x[5] for x in want], rtol=1e-9)
    model, base = (sum(x[k] for x in got if x[1]) for k in (6, 5))
    assert model > base  # held-out documents: better than the unigram model
    assert lm.score(spark.createDataFrame([], d.schema)).collect() == []
    alone = lm.score(d.where(F.col("doc_id") == next(i for i in range(99) if held(i)))).collect()
    assert [(r["train_tokens"], r["n_known"]) for r in alone] == [(0, 0)] and math.isfinite(alone[0]["score"])


def model():
    m = lm.start(np.random.default_rng(0).integers(1, 500, lm.SYMBOLS).astype(float))
    return m


def test_distribution_sums_to_one():
    m = model()
    h = np.random.default_rng(1).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    lp = lm.log_prob(m, np.repeat(h, lm.SYMBOLS, 0), np.arange(lm.SYMBOLS))
    assert abs(np.exp(lp).sum() - 1) < 1e-4


def test_state_is_carried_over_windows_and_lanes():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, lm.SYMBOLS, n).astype(np.int32) for n in (1, 200, 3, 70, 33)]
    m = model()
    one = np.array([lm.score_docs(m, [d], 1, len(d))[0] for d in docs])
    for most, size in ((1, 7), (2, 16), (8, 5)):
        assert np.allclose(lm.score_docs(m, docs, most, size), one, rtol=1e-5)


def test_gradient(monkeypatch):
    monkeypatch.setattr(lm, "STRIDE", 1)
    rng = np.random.default_rng(4)
    doc = rng.integers(0, lm.SYMBOLS, 6).astype(np.int32)
    base = model()
    t = lm.Trainer(lm.Model.unflat(base.flat()))
    grads = {}
    t._update = lambda name, g: grads.__setitem__(name, g)
    given = np.concatenate([[lm.SYMBOLS], doc[:-1]])
    t.window(doc[:, None], given[:, None], np.arange(6)[:, None] == 0, np.ones((6, 1), bool), np.zeros((1, lm.HIDDEN), np.float32), 1)
    for name in ("u", "c", "o"):
        g = grads[name]
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        loss = []
        for step in (1e-2, -1e-2):
            m = lm.Model.unflat(base.flat())
            getattr(m, name)[at] += step
            loss.append(-lm.score_docs(m, [doc])[0])
        assert abs((loss[0] - loss[1]) / 2e-2 - g[at]) < 2e-2 * max(1, abs(g[at])), name


def test_every_token_is_a_target():
    """With the production parameters, loss in each window is that of all its tokens."""
    rng = np.random.default_rng(5)
    doc = rng.integers(0, lm.SYMBOLS, lm.WINDOW).astype(np.int32)
    base = model()
    given = np.concatenate([[lm.SYMBOLS], doc[:-1]])
    for turn in range(3):
        t = lm.Trainer(lm.Model.unflat(base.flat()))
        t.turn, grads = turn, {}
        t._update = lambda name, g, grads=grads: grads.__setitem__(name, g)
        t.window(doc[:, None], given[:, None], np.arange(lm.WINDOW)[:, None] == 0, np.ones((lm.WINDOW, 1), bool), np.zeros((1, lm.HIDDEN), np.float32), 1)
        k = np.where(doc < lm.HEAD, doc // lm.OWN, lm.CLASSES + doc - lm.HEAD)
        taught = np.bincount(doc[doc < lm.HEAD], minlength=lm.HEAD).reshape(lm.CLASSES, lm.OWN) > 0
        assert (grads["ob"][taught] < 0).all() and (grads["cb"][np.unique(k)] < 0).all()


def test_updates_do_not_get_rarer():
    sizes = []
    t = lm.Trainer(model())
    t.window = lambda s, given, f, ok, h, most: sizes.append(most) or h
    docs = [np.zeros(50, np.int32)] * 2000
    t.learn(docs)
    t.seen = 1 << 21
    t.learn(docs)
    assert len(sizes) % 2 == 0 and len(set(sizes)) == 1 and lm.HIDDEN == 16
