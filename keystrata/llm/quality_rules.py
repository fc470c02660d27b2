"""Quality rules: text statistics in SQL functions and a learned decision list.

Sequential covering learns the list from labelled statistics: a rule grows by the condition with the greatest
information gain on two thirds of the sample until it covers no good document, is pruned on the other third, and
what it covers is taken out before the next rule. The list becomes ordered conditional expressions in Spark. Only
the statistics of a bounded sample of labelled rows (SAMPLE) come to the driver.

Defined cases: a null text has no words and fails the base rule; a null or empty label table, or one of a single class, gives an empty
list, which keeps what the base rule passes; repeated rows are judged each; other columns are ignored or kept.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import WORD, as_rows, let, of_rows, spread, stored

#: At most this many labelled rows, those of least hash, are used to learn.
SAMPLE = 4_000
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "line_words"]


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more, the first included."""

    def grams(w: Column) -> Column:
        return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    def starts(g: Column) -> Column:
        placed = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(F.transform(s, lambda x, j: F.when((x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"])), lambda i: i.isNotNull())
        return F.sort_array(let(placed, twice))

    def covered(q: Column) -> Column:
        # each start covers three words or as many as there are up to the next start
        gaps = F.transform(q, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(q, j + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(grams(words), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(let(starts(g), covered)))


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """df with STATS and n_lines (lines with a word) under the prefix "_s_"."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(t, F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    both = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    rows = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    d = df.withColumn("_w", both).withColumn("_l", rows)
    d = d.withColumns({
        "_s_n_words": F.col("_w.n"), "_s_n_repeat_words": F.col("_w.r"), "_s_n_dup_lines": F.col("_l.d"), "_s_n_lines": F.col("_l.n"),
        "_s_word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "_s_n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
    })
    return d.drop("_w", "_l")


def base_failed(prefix: str = "_s_") -> Column:
    n, r = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def features(prefix: str = "_s_") -> dict[str, Column]:
    c = lambda x: F.col(prefix + x).cast("double")
    words, lines = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("n_lines"), F.lit(1.0))
    return {"n_words": c("n_words"), "mean_word": c("word_chars") / words, "symbol_rate": c("n_symbols") / words, "dup_line_rate": c("n_dup_lines") / lines, "repeat_rate": c("n_repeat_words") / words, "line_words": c("n_words") / lines}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self, cols: dict[str, Column]) -> Column:
        return cols[self.feature] > self.threshold if self.above else cols[self.feature] <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction of thresholds; what meets it is rejected."""

    conditions: tuple[Condition, ...]

    def holds(self, row: dict) -> bool:
        return all(c.holds(row) for c in self.conditions)


def _cuts(rows: list[dict], n: int = 32) -> list[Condition]:
    out = []
    for f in FEATURES:
        v = sorted({r[f] for r in rows})
        mids = [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)]
        picked = mids if len(mids) <= n else [mids[i * (len(mids) - 1) // (n - 1)] for i in range(n)]
        out += [Condition(f, above, x) for x in dict.fromkeys(picked) for above in (True, False)]
    return out


def _parts(rows: list[dict]) -> tuple[list[dict], list[dict]]:
    """Two thirds to grow rules on and a third to prune them, of either class alike and by a hash, so that no order of the rows matters."""
    parts: tuple[list[dict], list[dict]] = ([], [])
    for good in (True, False):
        own = sorted((r for r in rows if bool(r["good"]) == good), key=lambda r: (zlib.crc32(repr([r[f] for f in FEATURES]).encode()), [r[f] for f in FEATURES]))
        for i, r in enumerate(own):
            parts[i % 3 == 1].append(r)
    return parts


def learn(rows: list[dict], max_rules: int = 8, max_conditions: int = 3, precision: float = 0.9, least: int = 5) -> list[Rule]:
    """Ordered rules for bad rows (label 0) from dicts of FEATURES and "good".

    A rule of too little precision is dropped, and the bad rows that it covers are sought no more; the others still are."""
    left, rules, dropped = list(rows), [], 0
    while len(rules) < max_rules and dropped < max_rules and any(not r["good"] for r in left):
        grow, prune = _parts(left)
        covered, conditions = grow, []
        cuts = _cuts(grow)
        while len(conditions) < max_conditions and any(r["good"] for r in covered):
            bad = sum(not r["good"] for r in covered)
            now = math.log2(max(bad, 1e-9) / len(covered)) if covered else 0.0
            best, gain = None, 1e-9
            for c in cuts:
                inside = [r["good"] for r in covered if c.holds(r)]
                p = len(inside) - sum(inside)
                if p >= least and (g := p * (math.log2(p / len(inside)) - now)) > gain:
                    best, gain = c, g
            if best is None:
                break
            conditions.append(best)
            covered = [r for r in covered if best.holds(r)]
        if not conditions:
            break

        def worth(cs: tuple[Condition, ...], rows: list[dict] = prune) -> tuple[float, int]:
            inside = [r["good"] for r in rows if all(c.holds(r) for c in cs)]
            return ((len(inside) - 2 * sum(inside)) / len(inside), len(inside) - sum(inside)) if inside else (-1.0, 0)

        best_cut = max(range(len(conditions), 0, -1), key=lambda k: worth(tuple(conditions[:k])))
        rule = Rule(tuple(conditions[:best_cut]))
        inside = [r["good"] for r in left if rule.holds(r)]
        if len(inside) < least or 1 - sum(inside) / len(inside) < precision:
            dropped += 1
            left = [r for r in left if r["good"] or not rule.holds(r)]
            continue
        rules.append(rule)
        left = [r for r in left if not rule.holds(r)]
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Learn from the statistics of at most `sample` labelled documents that pass the base rule."""
    ids = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").alias("_q"))
    ids = ids.orderBy(F.xxhash64("_id"), "_id", "_q").limit(sample)
    known = docs.select(F.col("doc_id").cast("long").alias("_d"), F.col("text").alias("_t")).join(F.broadcast(ids), F.col("_d") == F.col("_id"))
    known = stored(known, "sample")  # else the filter on statistics would be computed below the join, for all rows
    stats = with_stats(known, "_t").where(~base_failed())
    rows = stats.select("_id", (F.col("_q") > 0).alias("good"), *[c.alias(k) for k, c in features().items()]).collect()
    return learn([r.asDict() for r in sorted(rows, key=lambda r: tuple(r))])


def verdict(rules: list[Rule], prefix: str = "_s_") -> Column:
    """kept: the rules asked in order, as one conditional expression."""
    cols, out = features(prefix), F.lit(True)
    for rule in reversed(rules):
        met = F.lit(True)
        for c in rule.conditions:
            met = met & c.column(cols)
        out = F.when(met, False).otherwise(out)
    return F.when(base_failed(prefix), False).otherwise(out)


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, STATS, base_failed, kept) of every document."""
    rules = fit(docs, labels, sample)
    d = with_stats(spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_t"))), "_t")
    return d.select("doc_id", *[F.col("_s_" + c).alias(c) for c in STATS], base_failed().alias("base_failed"), verdict(rules).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without the rejected rows, with docs' columns."""
    rules = fit(docs, labels, sample)
    return with_stats(as_rows(spread(docs)), "_row.text").where(verdict(rules)).select(*of_rows(docs))
