"""LM scoring: a gated recurrent language model in numpy with a class-factored output softmax.

The model's own words are the HEAD most frequent training tokens, in classes of equal size by frequency; every other word
belongs to a class by its length in bytes. A token's probability is that of its class given the state, times that of
the word within its class: a softmax for the model's own words, smoothed counts over the whole training corpus for the others.

Training: each task runs truncated backpropagation over all of its training documents, in windows of WINDOW steps over
many documents side by side; the state is carried from window to window within a document, and loss is taken at every token (every
STRIDE-th one, at another in each window, for a STRIDE above 1). The tasks' parameters are averaged by tokens (a sum by parameter index in Spark).
Output biases start at the log frequencies, so the untrained model is the unigram model.

Scoring carries the state through a whole document of any length. Counts of all words stay in a table: the
COMMON most frequent ones are broadcast (a fixed number of rows), the others are joined by hash and summed by document.
Words are compared by 64-bit hashes.

Defined cases: null and empty texts hold the end token only; rows of equal id and text are scored alike; a null id is
in training or held out by the checksum of an empty text; no training documents give counts of 0 and the uniform start; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrata.llm.common import stored
from keystrata.llm.text_hash import CHUNK, give_back, hash_bytes, pieces

HEAD, CLASSES, HIDDEN, WINDOW, STRIDE, COMMON = 1024, 32, 16, 16, 1, 1 << 16
TAILS = 8
OWN = HEAD // CLASSES
SYMBOLS = HEAD + TAILS
END = np.uint64(0x0123456789ABCDEF)
ALPHA = 0.1
RATE = 0.15
LN10 = math.log(10)


@dataclass
class Model:
    """x: what each symbol adds to the gates (update, reset, candidate); u: the state's part; c, cb: class softmax; o, ob: own words."""

    x: np.ndarray
    u: np.ndarray
    c: np.ndarray
    cb: np.ndarray
    o: np.ndarray
    ob: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])

    @classmethod
    def unflat(cls, v: np.ndarray) -> Model:
        out, at = [], 0
        for shape in SHAPES:
            n = math.prod(shape)
            out.append(np.ascontiguousarray(v[at : at + n].reshape(shape), np.float32))
            at += n
        return cls(*out)


SHAPES = [(SYMBOLS + 1, 3 * HIDDEN), (HIDDEN, 3 * HIDDEN), (HIDDEN, CLASSES + TAILS), (CLASSES + TAILS,), (CLASSES, HIDDEN, OWN), (CLASSES, OWN)]


def start(counts: np.ndarray) -> Model:
    """Small fixed random weights and biases at the log frequencies of the symbols."""
    rng = np.random.Generator(np.random.PCG64(7))
    m = Model(*[rng.normal(0, 0.1, s) for s in SHAPES])
    c = counts + 0.5
    own = c[:HEAD].reshape(CLASSES, OWN)
    m.ob = np.log(own / own.sum(1, keepdims=True))
    m.cb = np.log(np.concatenate([own.sum(1), c[HEAD:]]) / c.sum())
    m.x[:, :HIDDEN] -= 1.0  # update gates start half open
    m.c *= 0.3
    m.o *= 0.3
    return Model(*[np.ascontiguousarray(getattr(m, f.name), np.float32) for f in fields(m)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _step(m: Model, px: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    g = h @ m.u
    zr = _sigmoid(px[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
    z, r, gn = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN :]
    n = np.tanh(px[:, 2 * HIDDEN :] + r * gn)
    return n + z * (h - n), z, r, gn, n


def _by_class(k: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each of the model's own classes in k."""
    order = np.argsort(k, kind="stable")
    cut = np.searchsorted(k[order], np.arange(CLASSES + 1))
    for i in range(CLASSES):
        if cut[i] < cut[i + 1]:
            yield i, order[cut[i] : cut[i + 1]]


def _softmax(weights: np.ndarray, x: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Probabilities with one column a row of x: sums over the long axis are the fast ones."""
    e = weights.T @ x.T
    e += bias[:, None]
    e -= e.max(0)
    np.exp(e, out=e)
    e /= e.sum(0)
    return e


def _log_of(weights: np.ndarray, x: np.ndarray, bias: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Natural log of the softmax's k-th value for each row of x."""
    e = weights.T @ x.T
    e += bias[:, None]
    e -= e.max(0)
    own = e[k, np.arange(len(k))]
    np.exp(e, out=e)
    return own - np.log(e.sum(0))


def log_prob(m: Model, h: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Natural log probability of symbol s in state h; a tail symbol stands for its whole class."""
    k = np.where(s < HEAD, s // OWN, CLASSES + s - HEAD)
    out = _log_of(m.c, h, m.cb, k).astype(np.float64)
    for i, at in _by_class(k):
        out[at] += _log_of(m.o[i], h[at], m.ob[i], s[at] - i * OWN)
    return out


def lanes(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Documents dealt out to at most `most` lanes, long ones first, to the lane with the least so far."""
    import heapq

    n = max(1, min(most, len(lengths)))
    heap, out = [(0, i) for i in range(n)], [[] for _ in range(n)]
    for d in np.argsort(-lengths, kind="stable"):
        load, i = heapq.heappop(heap)
        out[i].append(int(d))
        heapq.heappush(heap, (load + int(lengths[d]), i))
    return sorted((x for x in out if x), key=lambda x: -int(lengths[x].sum()))


def windows(docs: list[np.ndarray], most: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(symbols, document numbers, starts-here, active lanes) in steps by lanes; lanes are sorted so that active ones stand first."""
    lengths = np.array([len(d) for d in docs])
    ls = lanes(lengths, most)
    flow = [np.concatenate([docs[d] for d in x]) for x in ls]
    who = [np.repeat(x, lengths[x]) for x in ls]
    first = [np.concatenate([[1], np.diff(w) != 0]).astype(bool) for w in who]
    total = np.array([len(f) for f in flow])
    stretch = 32 * size  # laid out for many windows at once
    for begin in range(0, int(total[0]), stretch):
        live = int((total > begin).sum())
        rows = min(stretch, -(-(int(total[0]) - begin) // size) * size)
        s, d, f = np.zeros((live, rows), np.int32), np.full((live, rows), -1, np.int32), np.zeros((live, rows), bool)
        for i in range(live):
            n = min(rows, total[i] - begin)
            s[i, :n], d[i, :n], f[i, :n] = flow[i][begin : begin + n], who[i][begin : begin + n], first[i][begin : begin + n]
        s, d, f = (np.ascontiguousarray(x.T) for x in (s, d, f))
        for at in range(0, rows, size):
            k = int((total > begin + at).sum())
            yield s[at : at + size, :k], d[at : at + size, :k], f[at : at + size, :k], k


def score_docs(m: Model, docs: list[np.ndarray], most: int = 384, size: int = 32) -> np.ndarray:
    """Natural log probability of each document's symbols, its state carried from its first symbol to its last."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    h = prev = None
    for s, d, f, live in windows(docs, most, size):
        h = np.zeros((live, HIDDEN), np.float32) if h is None else h[:live]
        prev = np.full(live, SYMBOLS) if prev is None else prev[:live]
        states = np.empty((size, live, HIDDEN), np.float32)
        given = np.vstack([prev[None], s[:-1]])
        given[f] = SYMBOLS  # a document starts from its own symbol and an empty state
        px = m.x[given]
        for t in range(size):
            if f[t].any():
                h = np.where(f[t][:, None], np.float32(0), h)
            h = _step(m, px[t], h)[0]
            states[t] = h
        prev = s[-1]
        ok = (d >= 0).ravel()
        lp = log_prob(m, states.reshape(-1, HIDDEN)[ok], s.ravel()[ok])
        out += np.bincount(d.ravel()[ok], lp, len(docs))
    return out


class Trainer:
    """Truncated backpropagation with a learning rate by parameter (Adagrad)."""

    def __init__(self, m: Model):
        self.m, self.seen, self.turn = m, 0, 0
        self.sq = Model(*[np.full(s, 1e-2, np.float32) for s in SHAPES])

    def _update(self, name: str, g: np.ndarray) -> None:
        p, q = getattr(self.m, name), getattr(self.sq, name)
        q += g * g
        p -= RATE * g / np.sqrt(q)

    def window(self, s: np.ndarray, given: np.ndarray, f: np.ndarray, ok: np.ndarray, h: np.ndarray, most: int) -> np.ndarray:
        m, (size, n) = self.m, s.shape
        px, held = m.x[given], []
        hs = np.empty((size, n, HIDDEN), np.float32)
        for t in range(size):
            if f[t].any():
                h = np.where(f[t][:, None], np.float32(0), h)
            new, z, r, gn, c = _step(m, px[t], h)
            held.append((h, z, r, gn, c))
            h = hs[t] = new
        take = ok.copy()
        take[np.arange(size) % STRIDE != self.turn % STRIDE] = False
        self.turn += 1
        at = np.flatnonzero(take.ravel())
        y = s.ravel()[at]
        k = np.where(y < HEAD, y // OWN, CLASSES + y - HEAD)
        order = np.argsort(k.astype(np.int16), kind="stable")  # by class, so that a class's places are a stretch
        at, y, k = at[order], y[order], k[order]
        x = hs.reshape(-1, HIDDEN)[at]
        scale = np.float32(STRIDE / most)  # windows with few lanes left weigh less
        e = _softmax(m.c, x, m.cb)
        e[k, np.arange(len(y))] -= 1
        e *= scale
        dx = e.T @ m.c.T
        dc, dcb = x.T @ e.T, e.sum(1)
        do, dob = np.zeros_like(m.o), np.zeros_like(m.ob)
        cut = np.searchsorted(k, np.arange(CLASSES + 1))
        for i in range(CLASSES):
            if cut[i] < cut[i + 1]:
                p = slice(cut[i], cut[i + 1])
                w = _softmax(m.o[i], x[p], m.ob[i])
                w[y[p] - i * OWN, np.arange(cut[i + 1] - cut[i])] -= 1
                w *= scale
                dx[p] += w.T @ m.o[i].T
                do[i], dob[i] = x[p].T @ w.T, w.sum(1)
        dh_out = np.zeros((size * n, HIDDEN), np.float32)
        dh_out[at] = dx
        dh_out = dh_out.reshape(size, n, HIDDEN)
        before, z, r, gn, c = (np.stack(x) for x in zip(*held, strict=True))
        # what doesn't depend on later steps, for the whole window at once
        slope = (1 - z) * (1 - c * c)
        gate, reset = (before - c) * z * (1 - z), gn * r * (1 - r)
        dpx, dg = np.empty_like(px), np.empty_like(px)
        dh, ut, back = np.zeros((n, HIDDEN), np.float32), np.ascontiguousarray(m.u.T), f.any(1)
        for t in range(size - 1, -1, -1):
            dh += dh_out[t]
            p, q = dpx[t], dg[t]
            d = dh * slope[t]
            p[:, 2 * HIDDEN :] = d
            np.multiply(dh, gate[t], out=q[:, :HIDDEN])
            np.multiply(d, reset[t], out=q[:, HIDDEN : 2 * HIDDEN])
            np.multiply(d, r[t], out=q[:, 2 * HIDDEN :])
            dh *= z[t]
            dh += q @ ut
            if back[t]:
                dh[f[t]] = 0
        dpx[:, :, : 2 * HIDDEN] = dg[:, :, : 2 * HIDDEN]
        du = before.reshape(-1, HIDDEN).T @ dg.reshape(-1, 3 * HIDDEN)
        order = np.argsort(given.ravel(), kind="stable")
        sym = given.ravel()[order]
        cut = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
        rows, gx = sym[cut], np.add.reduceat(dpx.reshape(-1, 3 * HIDDEN)[order], cut)
        self.sq.x[rows] += gx * gx
        m.x[rows] -= RATE * gx / np.sqrt(self.sq.x[rows])
        for name, g in (("u", du), ("c", dc), ("cb", dcb), ("o", do), ("ob", dob)):
            self._update(name, g)
        self.seen += int(ok.sum())
        return h

    def learn(self, docs: list[np.ndarray]) -> None:
        """One pass over docs; the state is carried from window to window."""
        if not docs:
            return
        tokens = sum(map(len, docs))
        most = int(min(512, max(16, tokens // (WINDOW * 300))))
        h = prev = None
        for s, d, f, live in windows(docs, most, WINDOW):
            h = np.zeros((live, HIDDEN), np.float32) if h is None else h[:live]
            prev = np.full(live, SYMBOLS) if prev is None else prev[:live]
            given = np.vstack([prev[None], s[:-1]])
            given[f] = SYMBOLS
            h = self.window(s, given, f, d >= 0, h, most)
            prev = s[-1]


def tokens_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, tail class) of a text's words and of the end."""
    hs, ls = [], []
    for part in pieces((text or "").encode("utf-8", "surrogatepass")):
        h, s, e = hash_bytes(part)
        hs.append(h)
        ls.append(e - s)
    n = np.concatenate(ls)
    return np.append(np.concatenate(hs), END), np.append(np.minimum((n + 1) // 2, TAILS) - 1, 0)


def _texts(b: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers' token counts, hashes, tail classes) of runs of rows of about CHUNK bytes; covers all rows in order."""
    texts, i = b["text"].tolist(), 0
    while i < len(texts):
        parts, size = [], 0
        while i < len(texts) and size < CHUNK:
            t = (texts[i] or "").encode("utf-8", "surrogatepass")
            if parts and size + len(t) > 2 * CHUNK:
                break
            parts.append(t)
            size += len(t) + 1
            i += 1
        if len(parts) == 1:
            h, k = tokens_of(parts[0].decode("utf-8", "surrogatepass"))
            yield np.array([len(h)]), h, k
            continue
        h, s, e = hash_bytes(b"\n".join(parts))
        bounds = np.cumsum([len(t) + 1 for t in parts])
        counts = np.diff(np.searchsorted(s, bounds), prepend=0)
        k = np.minimum((e - s + 1) // 2, TAILS) - 1
        ends = np.cumsum(counts)
        yield counts + 1, np.insert(h, ends, END), np.insert(k, ends, 0)


def is_held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def count_words(train: DataFrame) -> DataFrame:
    """(h, k, c) of all tokens of the training texts, each task's counts summed before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, h, k in _texts(b):
                u, at, c = np.unique(h, return_index=True, return_counts=True)
                yield pd.DataFrame({"h": u.view(np.int64), "k": k[at].astype(np.int8), "c": c})

    return train.select("text").mapInPandas(run, "h long, k byte, c long").groupBy("h", "k").agg(F.sum("c").alias("c"))


def most_common(counts: DataFrame) -> list:
    """The most frequent tokens, at most COMMON: the cut is read off a histogram of the counts' logarithms, of 1,000 bins or fewer."""
    level = F.floor(F.log2("c") * 16).cast("int")
    bins = sorted(((r["b"], r["n"]) for r in counts.groupBy(level.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    cut, held = bins[0][0] if bins else 0, 0
    for b, n in bins:
        if held and held + n > COMMON:
            break
        cut, held = b, held + n
    return counts.where(level >= cut).orderBy(F.desc("c"), "h").limit(COMMON).collect() if held > COMMON else counts.where(level >= cut).collect()


class Vocabulary:
    """The COMMON most frequent tokens by hash, their counts, and the model's symbols."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (-r["c"], r["h"]))
        h = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
        rank = np.argsort(h)
        self.hashes, self.counts = h[rank], np.array([r["c"] for r in rows], np.int64)[rank]
        self.symbol = np.where(rank < HEAD, rank, -1).astype(np.int32)
        # a table by the hash's upper bits; slots with several tokens are looked up in order
        slot = (self.hashes >> np.uint64(44)).astype(np.int64)
        self.table, self.crowded = np.zeros(1 << 20, np.int32), np.zeros(1 << 20, bool)
        self.table[slot] = np.arange(len(slot))
        self.crowded[slot[1:][slot[1:] == slot[:-1]]] = True

    def look_up(self, h: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, count or -1 if not common)."""
        if not len(self.hashes):
            return HEAD + k.astype(np.int32), np.full(len(h), -1)
        slot = (h >> np.uint64(44)).astype(np.int64)
        at = self.table[slot]
        hit = self.hashes[at] == h
        again = np.flatnonzero(self.crowded[slot] & ~hit)
        at[again] = np.minimum(np.searchsorted(self.hashes, h[again]), len(self.hashes) - 1)
        hit[again] = self.hashes[at[again]] == h[again]
        s = np.where(hit, self.symbol[at], -1)
        return np.where(s >= 0, s, HEAD + k).astype(np.int32), np.where(hit, self.counts[at], -1)


def train(docs: DataFrame, words: Vocabulary, first: Model) -> Model:
    """The average of the tasks' models, weighted by their tokens."""
    begin = first.flat()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, held, size = Trainer(Model.unflat(begin)), [], 0
        for b in batches:
            for counts, h, k in _texts(b):
                s = words.look_up(h, k)[0]
                held += np.split(s, np.cumsum(counts)[:-1])
                size += len(s)
                if size >= 1 << 20:
                    t.learn(held)
                    held, size = [], 0
        t.learn(held)
        if t.seen:
            v = t.m.flat().astype(np.float64) * t.seen
            del held
            give_back()
            yield pd.DataFrame({"i": np.arange(len(v) + 1, dtype=np.int32), "v": np.append(v, t.seen)})

    sums = docs.select("text").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    if not sums:
        return first
    v = np.zeros(len(begin) + 1)
    for r in sums:
        v[r["i"]] = r["v"]
    return Model.unflat(v[:-1] / v[-1])


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text"))
    learn_from = d.where(~is_held_out())
    counts = stored(count_words(learn_from), "counts")
    top = most_common(counts)
    words = Vocabulary(top)
    sums = counts.groupBy("k").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    total, kinds = sum(r["c"] for r in sums), sum(r["v"] for r in sums)
    tail_c, tail_v = np.zeros(TAILS), np.zeros(TAILS)
    for r in sums:
        tail_c[r["k"]], tail_v[r["k"]] = r["c"], r["v"]
    symbol_counts = np.zeros(SYMBOLS)
    for i, r in enumerate(sorted(top, key=lambda r: (-r["c"], r["h"]))[:HEAD]):
        symbol_counts[i] = r["c"]
        tail_c[r["k"]] -= r["c"]
        tail_v[r["k"]] -= 1
    symbol_counts[HEAD:] = tail_c
    del top
    model = train(learn_from, words, start(symbol_counts)).flat()
    tail_log = np.log10(tail_c + ALPHA * (tail_v + 1))
    base_log = math.log10(total + ALPHA * (kinds + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, frames, held = Model.unflat(model), [], []
        for b in batches:
            held += _texts(b)
            frames.append(b[["doc_id", "th"]])
            if sum(len(x[1]) for x in held) >= 1 << 20:  # enough for full lanes
                yield part(pd.concat(frames), m, held)
                frames, held = [], []
        if held:
            yield part(pd.concat(frames), m, held)
        give_back()

    def part(b: pd.DataFrame, m: Model, held: list) -> pd.DataFrame:
        n = np.concatenate([x[0] for x in held])
        h, k = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
        s, c = words.look_up(h, k)
        doc = np.repeat(np.arange(len(n)), n)
        lp = score_docs(m, np.split(s, np.cumsum(n)[:-1])) / LN10
        known, tail = c >= 0, s >= HEAD
        logc = np.log10(np.maximum(c, 0) + ALPHA)
        add = lambda ok, v: np.bincount(doc[ok], v[ok], len(n))
        out = pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "th": b["th"].to_numpy(), "n_tokens": n, "n_known": np.bincount(doc[c > 0], minlength=len(n)), "base": add(known, logc) - n * base_log, "model": lp + add(known & tail, logc) - add(tail, tail_log[k])}).astype({"doc_id": "Int64"})
        rest = []
        ends = np.cumsum(n)
        for i in range(len(n)):
            x = h[ends[i] - n[i] : ends[i]][~known[ends[i] - n[i] : ends[i]]]
            u, times = np.unique(x, return_counts=True)
            rest.append((u.view(np.int64), times.astype(np.int32)))
        out["hs"], out["times"] = [x[0] for x in rest], [x[1] for x in rest]
        return out

    local = d.mapInPandas(run, "doc_id long, th long, n_tokens long, n_known long, base double, model double, hs array<long>, times array<int>")
    local = stored(local, "scored")
    rare = counts.select(F.col("h").alias("_h"), "c")
    e = local.select("doc_id", "th", F.explode(F.arrays_zip("hs", "times")).alias("x")).select("doc_id", "th", F.col("x.hs").alias("h"), F.col("x.times").alias("times"))
    j = e.join(rare, F.col("h") == F.col("_h"), "left").withColumn("c", F.coalesce("c", F.lit(0)))
    more = j.groupBy("doc_id", "th").agg(F.sum(F.col("times") * F.log10(F.col("c") + ALPHA)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"))
    copies = F.count(F.lit(1)).over(W.partitionBy("doc_id", "th"))
    more = more.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "logs", "known")
    out = local.drop("hs", "times").withColumn("copies", copies).join(more, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    logs, known = F.coalesce(F.col("logs") / F.col("copies"), F.lit(0.0)), F.coalesce(F.expr("known div copies"), F.lit(0))
    return out.select("doc_id", is_held_out().alias("held_out"), "n_tokens", (F.col("n_known") + known).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("model") + logs).alias("score"))
