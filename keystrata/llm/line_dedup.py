"""Line dedup by a segment-partition edit join.

A line goes if an equal line, or a line within `threshold` edits (insert, delete, replace a character), stands before it in
(doc_id, line) order. Lines of fewer than `least` characters take no part in the edit join: two edits turn one heading or
list mark into another. Their equal copies go all the same, from `exact` characters on, if they hold a word; `exact` is
`least` where it isn't given.

Each distinct line is split into threshold + 1 even segments; two lines within the threshold share one of them, at a place
that differs by few characters. Index entries are (length, segment number, segment hash). A line probes, for its own and each
shorter length in reach, just those substrings that the multi-match-aware bound admits. Around a key with more than HOT index
entries, all lines meet the earliest one first, and those within reach of it ask no further: one line before it makes a line go.
For lines that still ask, the key is split by 15 more keys: six groups of characters are counted, two edits change four
counts at most, so some two groups of counts agree (for other thresholds, one of 2 * threshold + 1 groups); a pair is
taken under the first two that do. Lines that meet must be near in their counts of 16 groups of characters, and are then verified
by a banded bit-parallel edit distance.

Keys and lines are compared by 64-bit hashes; every near pair is verified on the lines themselves.

Defined cases: null texts have no lines; rows of equal id and text are one document, so their lines stay together; a null id
stands before all others; ties in place are rows of one document; an empty table gives no rows; other columns are kept by
deduped and ignored by removals.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrata.llm.common import BITS, as_rows, bit_set, drop_stored, let, of_rows, release, spread, stored
from keystrata.llm.text_hash import fmix, give_back, powers

#: Production parameters: characters a line needs to take part in the edit join, and edits allowed.
LEAST, THRESHOLD = 24, 2
#: Characters that a line with a word needs for its equal copies to go.
EXACT = 1
#: Parts that the places of a repeated line are spread over.
SPREAD = 16
#: Index entries from which on a key is hot, how often its lines meet the earliest of them, and keys known to be very common at most.
HOT, LEADERS, COMMON = 16, 3, 1000
_ODD = 0xD6E8FEB86659FD93
_INV = pow(_ODD, -1, 1 << 64)
_CHUNK = 1 << 19
_U = np.uint64


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """(start, length) of threshold + 1 even segments; the later ones take what is over."""
    parts = threshold + 1
    short, over = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = short + (i >= parts - over)
        out.append((at, n))
        at += n
    return out


def edit_within(a: str, b: str, k: int) -> bool:
    """Whether a and b are within k edits: bit-parallel over a diagonal band of 2k + 1 cells."""
    if abs(len(a) - len(b)) > k:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    p, t = a[i : len(a) - j], b[i : len(b) - j]
    m, mask, top = len(p), (1 << (2 * k + 1)) - 1, 1 << (2 * k)
    rows: dict[str, int] = {}  # a bit for each row that holds the character
    for row, x in enumerate(p):
        rows[x] = rows.get(x, 0) | 1 << row
    vp, vn, score = (mask >> k) << k, 0, min(m, k)
    for c in range(1, len(t) + 1):
        held, low = rows.get(t[c - 1], 0), c - k - 1  # bit b of the band stands for row low + b
        eq = (held >> low if low >= 0 else held << -low) & mask
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp, hn = (vn | ~(d0 | vp)) & mask, d0 & vp
        if c + k <= m:
            score += not d0 & top
            if score > 2 * k:
                return False
        else:
            bit = m - c + k
            if bit < 0:
                return False
            score += (hp >> bit & 1) - (hn >> bit & 1)
        vp, vn = (hn | ~((d0 >> 1) | hp)) & mask, (d0 >> 1) & hp
    return score <= k


def _prefix(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial hash over code points; starts and lengths of the lines."""
    n = np.array([len(x) for x in lines], np.int64)
    s = np.concatenate([[0], np.cumsum(n[:-1])]) if len(n) else n
    cp = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(fmix(cp.astype(np.uint64) + _U(77)) * powers(_ODD, len(cp)), out=c[1:])
    return c, powers(_INV, len(cp) + 1), s, n


def line_hashes(lines: list[str]) -> np.ndarray:
    c, inv, s, n = _prefix(lines)
    return fmix((c[s + n] - c[s]) * inv[s] + n.astype(np.uint64))


def keys_of(lines: list[str], threshold: int, least: int, own: bool = True) -> tuple[np.ndarray, ...]:
    """(line number, key, probes) arrays of all index and probe entries of lines; own: with the probes that find a line's own index entries."""
    c, inv, s, n = _prefix(lines)
    who = np.arange(len(lines))
    rows, keys, probes = [], [], []

    def emit(at: np.ndarray, length: np.ndarray, ok: np.ndarray, target: np.ndarray, i: int, probe: bool) -> None:
        a, ln = s[ok] + at[ok], length[ok]
        h = (c[a + ln] - c[a]) * inv[a]
        keys.append(fmix(h + target[ok].astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(i * 0x632BE59BD9B4E019 & (1 << 64) - 1)).view(np.int64))
        rows.append(who[ok])
        probes.append(np.full(len(ln), probe))

    for delta in range(threshold + 1):
        target = n - delta
        short, over = np.divmod(target, threshold + 1)
        at = np.zeros(len(n), np.int64)
        for i in range(threshold + 1):
            length = short + (i >= threshold + 1 - over)
            if delta == 0:
                emit(at, length, n >= least, target, i, False)
            low = np.maximum(np.maximum(at - i, at + delta - (threshold - i)), 0)
            high = np.minimum(np.minimum(at + i, at + delta + (threshold - i)), n - length)
            for shift in range(-threshold, 2 * threshold + 1):
                if not (own or delta or shift):
                    continue
                start = at + shift
                emit(start, length, (target >= least) & (start >= low) & (start <= high), target, i, True)
            at = at + length
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(probes)


def _lines(text: str, least: int, exact: int) -> Iterator[tuple[int, str]]:
    for i, x in enumerate(text.split("\n")):
        if len(x) >= least or len(x) >= exact and x.strip(" \t\n\x0b\f\r"):
            yield i, x


def _batches(b: pd.DataFrame, least: int, exact: int | None = None) -> Iterator[tuple[list[tuple], list[str]]]:
    """Lines of a batch with their places, about _CHUNK characters at a time."""
    place, lines, size = [], [], 0
    for d, th, text in zip(b["doc_id"], b["th"], b["text"], strict=True):
        for i, x in _lines(text or "", least, least if exact is None else exact):
            place.append((d, th, i))
            lines.append(x)
            size += len(x)
            if size >= _CHUNK:
                yield place, lines
                place, lines, size = [], [], 0
    if lines:
        yield place, lines


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"), F.col("text").cast("string").alias("text"))


def _entries(src: DataFrame, threshold: int, least: int) -> DataFrame:
    """(key, h, probe, n) of the lines; copies within a task's last stretch of lines are left out. An index entry probes as well."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            for _, lines in _batches(b, least):
                h = line_hashes(lines)
                fresh = []
                for i, x in enumerate(h.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh.append(i)
                if len(seen) > 200_000:
                    seen.clear()
                if fresh:
                    own = [lines[i] for i in fresh]
                    row, key, probe = keys_of(own, threshold, least, own=False)
                    yield pd.DataFrame({"key": key, "h": h[fresh].view(np.int64)[row], "probe": probe, "n": np.array([len(x) for x in own], np.int32)[row]})
        give_back()

    return src.mapInPandas(run, "key long, h long, probe boolean, n int")


def _places(src: DataFrame, least: int, exact: int | None) -> DataFrame:
    """(doc_id, th, line, h) of every line that takes part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for place, lines in _batches(b, least, exact):
                yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(p[0]) else int(p[0]) for p in place], "Int64"), "th": [p[1] for p in place], "line": np.array([p[2] for p in place], np.int32), "h": line_hashes(lines).view(np.int64)})
        give_back()

    return src.mapInPandas(run, "doc_id long, th long, line int, h long")


def _wanted(src: DataFrame, least: int, bits: bytes) -> DataFrame:
    """(h, x, c0, c1) of the lines whose hash may be in bits, once a task; c0 and c1 count their characters in 16 groups, a byte each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, seen = np.frombuffer(bits, np.uint8), set()
        for b in batches:
            for _, lines in _batches(b, least):
                h = line_hashes(lines).view(np.int64)
                at = h & (BITS - 1)
                hit = np.flatnonzero((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                hit = [i for i in hit if h[i] not in seen]
                seen.update(h[hit].tolist())
                if len(seen) > 200_000:
                    seen.clear()
                if hit:
                    own = [lines[i] for i in hit]
                    c = _counts(own)
                    yield pd.DataFrame({"h": h[hit], "x": own, "c0": c[:, 0], "c1": c[:, 1]}).drop_duplicates("h")
        give_back()

    return src.mapInPandas(run, "h long, x string, c0 long, c1 long")


def _counts(lines: list[str]) -> np.ndarray:
    """The characters of each line in 16 groups, counted in a byte each, as two longs."""
    n = np.array([len(x) for x in lines], np.int64)
    cp = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    at = np.repeat(np.arange(len(n)), n) * 16 + (fmix(cp + _U(313)) & _U(15)).astype(np.int64)
    return np.bincount(at, minlength=16 * len(n)).astype(np.uint8).reshape(-1, 16).view(np.int64)


def _may_be_near(threshold: int) -> Column:
    """An edit changes the counts of the groups by 2 in all at most."""
    apart = F.lit(0)
    for c in ("c0", "c1"):
        for i in range(0, 64, 8):
            byte = lambda k: F.shiftrightunsigned(F.col(c + k), i).bitwiseAND(F.lit(255))  # noqa: B023, E731
            d = F.abs(byte("a") - byte("b"))
            apart = apart + F.least(d, 256 - d)
    return apart <= 2 * threshold


def _choices(threshold: int) -> tuple[int, int, list[tuple[int, ...]]]:
    """Groups of characters, bits for the digest of a group's counts, and the sets of groups that get a key."""
    groups = 6 if threshold == 2 else 2 * threshold + 1
    return groups, min(10, 60 // groups), list(combinations(range(groups), 2 if threshold == 2 else 1))


def _split_keys(hot: DataFrame, threshold: int) -> DataFrame:
    """hot (key, x, ...) with key replaced by a key for each set j of groups, without x; g holds all groups' digests."""
    groups, bits, sets = _choices(threshold)

    @F.pandas_udf("g long, keys array<long>")
    def split(keys: pd.Series, lines: pd.Series) -> pd.DataFrame:
        # A group's counts as the sum of a random number a character: equal counts give equal sums.
        n = np.array([len(x) for x in lines], np.int64)
        cp = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        at = np.repeat(np.arange(len(n)), n) * groups + (cp % _U(groups)).astype(np.int64)
        sums = np.zeros(len(n) * groups, np.uint64)
        np.add.at(sums, at, fmix(cp + _U(991)))
        sums = fmix(sums.reshape(-1, groups)) >> _U(64 - bits)
        packed = np.bitwise_or.reduce(sums << (np.arange(groups, dtype=np.uint64) * _U(bits)), axis=1).view(np.int64)
        out = np.empty((len(n), len(sets)), np.int64)
        for j, s in enumerate(sets):
            new = keys.to_numpy().view(np.uint64) + _U(j + 1)
            for k in s:
                new = fmix(new ^ sums[:, k])
            out[:, j] = new.view(np.int64)
        return pd.DataFrame({"g": packed, "keys": list(out)})

    d = hot.withColumn("s", split("key", "x")).drop("key", "x")
    return d.select("*", F.col("s.g").alias("g"), F.posexplode("s.keys").alias("j", "key")).drop("s")


def _first_choice(threshold: int) -> Column:
    """The first set of groups whose digests agree in ga and gb."""
    _, bits, sets = _choices(threshold)
    differ = F.col("ga").bitwiseXOR(F.col("gb"))
    masks = [sum((1 << bits) - 1 << bits * k for k in s) for s in sets]
    return F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(j)) for j, m in enumerate(masks)])


def _common_keys(e: DataFrame) -> DataFrame:
    """(key, common) of the COMMON keys at most that the most lines have, going by one line in 64.

    Each has 8 of those at least. Which ones are found decides on how work is dealt out, not on results."""
    some = e.where(F.pmod("h", F.lit(64)) == 0).groupBy("key", "h").agg(F.lit(1)).groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    return stored(some.where("c >= 8").orderBy(F.desc("c"), "key").limit(COMMON).select("key", F.lit(True).alias("common")), "common-keys")


def _shared(e: DataFrame) -> DataFrame:
    """The distinct entries whose key several lines have. One exchange by key; entries of common keys are spread over the tasks."""
    d = e.join(F.broadcast(_common_keys(e)), "key", "left").withColumn("part", F.when(F.col("common"), F.pmod("h", F.lit(1024))))
    w = W.partitionBy("key", "part")
    d = d.withColumn("lo", F.min("h").over(w)).withColumn("hi", F.max("h").over(w)).where(F.col("part").isNotNull() | (F.col("lo") != F.col("hi")))
    return d.select("key", "h", "probe", "n").distinct()


def _sides(index: DataFrame, probe: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    cols = lambda d, k: d.select("key", F.col("h").alias(k), F.col("n").alias("n" + k), *[F.col(x).alias(x + k) for x in more])
    return cols(index, "a"), cols(probe, "b")


def _once() -> Column:
    """Of two lines that probe each other, the one of lesser hash counts as index."""
    return (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))


def _ordered(d: DataFrame) -> DataFrame:
    """(h, w): of a line pair (a, pa, b, pb) the later and the earlier one."""
    late = F.col("pa") > F.col("pb")
    return d.select(F.when(late, F.col("a")).otherwise(F.col("b")).alias("h"), F.when(late, F.col("b")).otherwise(F.col("a")).alias("w")).distinct()


def _verified(pairs: DataFrame, text: DataFrame, threshold: int) -> DataFrame:
    """The pairs (h, w) of lines within threshold edits."""
    j = pairs.join(text.select("h", F.col("x").alias("xh")), "h").join(text.select(F.col("h").alias("w"), F.col("x").alias("xw")), "w")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [edit_within(x, y, threshold) for x, y in zip(b["xh"], b["xw"], strict=True)]
            yield b.loc[ok, ["h", "w"]]

    return stored(j.mapInPandas(check, "h long, w long"), "verified")


def witnesses(src: DataFrame, first: DataFrame, threshold: int = THRESHOLD, least: int = LEAST) -> DataFrame:
    """(h, w) for every line h that some line within threshold edits stands before, w being one of these or several.

    first: (h, first) of all lines. A line needs one witness only: in groups around a hot key all lines meet the earliest one of the
    other side first, LEADERS times, and lines that have a witness by then ask no more; they stay in the index for the others."""
    entries = stored(_entries(src, threshold, least), "entries")
    shared = stored(_shared(entries), "shared")
    drop_stored(entries)
    hot = stored(shared.where("not probe").groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT).select("key"), "hot")
    own = shared.select("h").distinct()
    text = stored(_wanted(src, least, bit_set(own, "h")).dropDuplicates(["h"]).join(own, "h"), "lines")
    place = first.join(text.select("h", "c0", "c1"), "h").select("h", F.col("first").alias("p"), "c0", "c1")
    placed = stored(shared.join(place, "h"), "placed")
    cold = placed.join(hot, "key", "left_anti")
    near = _once() & _may_be_near(threshold)
    a, b = _sides(cold.where("not probe"), cold, "p", "c0", "c1")
    plain = stored(_ordered(a.join(b, "key").where(near)), "pairs")
    in_hot = stored(placed.join(hot, "key", "left_semi"), "in-hot")
    found = _verified(plain, text, threshold)
    drop_stored(shared, placed, plain)
    release(src.sparkSession)

    leader = None
    for _ in range(LEADERS):
        asks = in_hot.join(found.select("h").distinct(), "h", "left_anti")
        # The earliest line of index and of probes that still asks and hasn't led yet; the first time, the earliest of all.
        lead = in_hot if leader is None else asks.join(leader.select("key", F.col("led_by_probe").alias("probe"), F.col("q").alias("led")), ["key", "probe"], "left").where(F.col("led").isNull() | (F.col("p") > F.col("led")))
        m = F.min(F.struct("p", "h", "c0", "c1")).alias("m")
        leader = stored(lead.groupBy("key", F.col("probe").alias("led_by_probe")).agg(m).select("key", "led_by_probe", F.col("m.p").alias("q"), F.col("m.h").alias("w"), F.col("m.c0").alias("c0b"), F.col("m.c1").alias("c1b")), "leaders")
        met = asks.withColumnsRenamed({"c0": "c0a", "c1": "c1a"}).join(leader, "key")
        met = met.where(~(F.col("probe") & F.col("led_by_probe")) & (F.col("q") < F.col("p")) & (F.col("h") != F.col("w")) & _may_be_near(threshold)).select("h", "w").distinct()
        new = _verified(met, text, threshold)
        if new.isEmpty():
            break
        found = found.unionByName(new)

    asks = in_hot.join(found.select("h").distinct().withColumn("done", F.lit(True)), "h", "left").withColumn("asks", F.col("done").isNull()).drop("done")
    asks = stored(asks.join(asks.where("asks").select("key").distinct(), "key", "left_semi"), "asks")
    split = stored(_split_keys(asks.join(text.select("h", "x"), "h"), threshold), "split")
    same = (F.col("ja") == F.col("jb")) & (F.col("ja") == _first_choice(threshold))
    later = F.when(F.col("pa") > F.col("pb"), F.col("asksa")).otherwise(F.col("asksb"))
    rest = None
    for one, other in (("asks", "true"), ("not asks", "asks")):
        a, b = _sides(split.where("not probe").where(one), split.where(other), "j", "g", "p", "asks", "c0", "c1")
        met = _ordered(a.join(b, "key").where(near & same & later))
        rest = met if rest is None else rest.unionByName(met)
    return found.unionByName(_verified(rest.distinct(), text, threshold))


def removals(docs: DataFrame, threshold: int = THRESHOLD, least: int = LEAST, exact: int | None = None) -> DataFrame:
    """(doc_id, th, removed, earlier): numbers of the lines that go, and for each the document of a line before it."""
    src = spread(_source(docs))
    at = stored(_places(src, least, exact), "places")
    place = F.struct("doc_id", "th", "line")
    first = stored(at.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")), "first")
    near = witnesses(src, first.select("h", "first"), threshold, least)
    release(docs.sparkSession)
    gone = near.join(first.select(F.col("h").alias("w"), F.col("first").alias("p")), "w").groupBy("h").agg(F.min("p").alias("before"))
    # Only lines that are repeated or have a near one before them lose a place; short ones may be very common.
    part = F.pmod(F.xxhash64("doc_id", "line"), F.lit(SPREAD)).cast("int")
    some = first.join(gone, "h", "left").where((F.col("copies") > 1) | F.col("before").isNotNull()).select("h", "first", "before", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    same = (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("th") == F.col("first.th")) & (F.col("line") == F.col("first.line"))
    lines = at.withColumn("part", part).join(some, ["h", "part"])
    out = lines.where(F.col("before").isNotNull() | ~same).select("doc_id", "th", F.struct(F.col("line"), F.coalesce(F.col("before.doc_id"), F.col("first.doc_id")).alias("of")).alias("r"))
    out = out.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("r")).alias("r"))
    return out.select("doc_id", "th", F.col("r.line").alias("removed"), F.col("r.of").alias("earlier"))


def report(docs: DataFrame, threshold: int = THRESHOLD, least: int = LEAST, exact: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed, earlier) of every document."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    r = removals(docs, threshold, least, exact).withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    j = d.join(r, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    return j.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), F.coalesce("earlier", F.array().cast("array<bigint>")).alias("earlier"))


def deduped(docs: DataFrame, threshold: int = THRESHOLD, least: int = LEAST, exact: int | None = None) -> DataFrame:
    """docs with docs' columns, the text without the lines that go; a document that loses its last line goes."""
    r = removals(docs, threshold, least, exact).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("removed").alias("_gone"))
    text = F.col("_row.text").cast("string")
    d = as_rows(docs).select("_row", F.col("_row.doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_th"))
    j = d.join(r, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(F.split(text, "\n")) - 1), "_gone")
    left = let(F.split(text, "\n"), lambda x: F.array_join(F.transform(stay, lambda i: F.get(x, i)), "\n"))
    out = j.withColumn("_y", F.when(F.col("_gone").isNull(), text).otherwise(left))
    out = out.where(F.col("_gone").isNull() | (F.length(F.btrim("_y", F.lit(" \t\n\x0b\f\r"))) > 0))
    return out.select(*[F.col("_y").alias(c) if c == "text" else c_ for c, c_ in zip(docs.columns, of_rows(docs), strict=True)])
