"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents stand in a shuffled order that is fixed by a hash, and their words are cut into blocks of equal
length. Slot k of the schedule has the k-th point of the golden-ratio sequence; the point falls into one source's part
of the cumulative weights. A source's slots are ranked, and the r-th slot takes its block r modulo its number of blocks.

Targets are the weights' share of all words. A target stops at max_repeats times its source's words and the excess is shared
again by weight. Slots that would take a block more than max_repeats times are left out.

Defined cases: null sources are one source, last in order; null texts and texts without words have size 0 and are never taken;
repeated rows are rows of their own; ties in the shuffled order are settled by id, size and text checksum; an empty table
gives no rows; other columns are kept by mix_documents and ignored by mix. One row a source comes to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrata.llm.common import WORD, as_rows, global_rank, of_rows, release, spread, stored

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Blocks have at most this many words; a small source is cut finer, into MIN_BLOCKS blocks at least.
BLOCK_WORDS, MIN_BLOCKS = 4096, 1024


def targets(sizes: list[int], weights: list[float], max_repeats: int = 3) -> list[float]:
    """Shares of sum(sizes) by weight, none above max_repeats times its size."""
    left, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        lam = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if max_repeats * sizes[i] <= weights[i] * lam]
        for i in full or open_:
            out[i] = float(max_repeats * sizes[i]) if full else weights[i] * lam
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= set(full)
    return out


def sources_of(sized: DataFrame, weights: tuple[float, ...], max_repeats: int, block: int) -> pd.DataFrame:
    """A row a source, in code-point order with null last: size, target, words a block, blocks, slots wanted."""
    rows = sorted(sized.groupBy("source").agg(F.sum("size").alias("size")).collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    size = [int(r["size"]) for r in rows]
    t = targets(size, [weights[i % len(weights)] for i in range(len(rows))], max_repeats)
    length = [max(1, math.ceil(s / max(math.ceil(s / block), min(s, MIN_BLOCKS), 1))) for s in size]
    blocks = [math.ceil(s / n) for s, n in zip(size, length, strict=True)]
    slots = [x * b / s if s else 0.0 for x, b, s in zip(t, blocks, size, strict=True)]
    return pd.DataFrame({"s": np.arange(len(rows), dtype=np.int32), "source": [r["source"] for r in rows], "size": size, "target": t, "length": length, "blocks": blocks, "slots": slots})


def schedule(sized: DataFrame, sources: pd.DataFrame, max_repeats: int) -> DataFrame:
    """(slot, s, rank, block): which source, and which of its blocks, each slot takes."""
    spark = sized.sparkSession
    bounds = np.cumsum(sources["slots"].to_numpy(float))
    total = math.ceil(bounds[-1]) if len(bounds) else 0
    ends = bounds / bounds[-1] if total else bounds

    @F.pandas_udf("int")
    def source_at(slot: pd.Series) -> pd.Series:
        point = ((slot.to_numpy().astype(np.uint64) * GOLDEN + (GOLDEN >> np.uint64(1))) >> np.uint64(11)) / float(1 << 53)
        return pd.Series(np.minimum(np.searchsorted(ends, point, "right"), len(ends) - 1).astype(np.int32))

    d = spark.range(total).select(F.col("id").alias("slot"), source_at("id").alias("s"))
    d = global_rank(d, ["s"], [F.col("slot")], F.shiftright("slot", 12), "rank")
    info = spark.createDataFrame(sources[["s", "blocks"]], "s int, blocks long") if len(sources) else spark.createDataFrame([], "s int, blocks long")
    return d.join(F.broadcast(info), "s").where(F.col("rank") < F.col("blocks") * max_repeats).withColumn("block", F.col("rank") % F.col("blocks")).drop("blocks")


def _placed(sized: DataFrame, sources: pd.DataFrame) -> DataFrame:
    """Adds s, source_size, target, length and at: the words of its source before the document in the shuffled order."""
    spark = sized.sparkSession
    info = spark.createDataFrame(sources[["s", "source", "size", "target", "length"]].rename(columns={"size": "source_size"}), "s int, _src string, source_size long, target double, length long") if len(sources) else spark.createDataFrame([], "s int, _src string, source_size long, target double, length long")
    d = sized.join(F.broadcast(info), F.col("source").eqNullSafe(F.col("_src"))).drop("_src").withColumn("_key", F.xxhash64(F.lit(17), "doc_id", "size", "crc"))
    d = d.withColumn("_b", F.shiftright("_key", 52))
    w = W.partitionBy("s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    before = d.groupBy("s", "_b").agg(F.sum("size").alias("_n")).select("s", "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inside = W.partitionBy("s", "_b").orderBy("_key", F.col("doc_id"), "size", "crc").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return d.join(before, ["s", "_b"]).withColumn("at", F.col("_before") + F.col("_in")).drop("_before", "_in", "_b", "_key")


def sized_documents(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return spread(docs.select("doc_id", "source", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeats: int = 3, block: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) of every document.

    taken: its words in all slots that take them. copies: how often the block with its first word is taken."""
    sized = stored(sized_documents(docs), "sizes")
    sources = sources_of(sized, weights, max_repeats, block)
    d = stored(_placed(sized, sources), "placed")
    release(docs.sparkSession)
    times = stored(schedule(sized, sources, max_repeats).groupBy("s", "block").agg(F.count(F.lit(1)).alias("times")), "times")

    first, last = F.expr("at div length"), F.expr("(at + size - 1) div length")
    e = d.where("size > 0").select("*", F.explode(F.sequence(first, last)).alias("block"))
    e = e.withColumn("words", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("length")) - F.greatest(F.col("at"), F.col("block") * F.col("length")))
    e = e.join(times, ["s", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    keys = ["s", "at", "doc_id", "source", "size", "source_size", "target", "length"]
    took = e.groupBy(*keys).agg(F.sum(F.col("words") * F.col("times")).cast("long").alias("taken"), F.max(F.when(F.expr("block = at div length"), F.col("times"))).alias("copies"))
    none = d.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("copies"))
    return took.unionByName(none).select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeats: int = 3) -> DataFrame:
    """The mix as documents, with docs' columns: each row as often as the block with its first word is taken."""
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    m = mix(docs, weights, max_repeats).where("copies > 0")
    # Equal rows (same id, source, size) may differ in their copies: their sum is dealt out evenly by row number.
    key = [F.col("_row.doc_id").cast("long").alias("_id"), F.col("_row.source").cast("string").alias("_s"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("_n")]
    order = W.partitionBy("_id", "_s", "_n").orderBy("_x")
    left = spread(as_rows(docs)).select("_row", *key, F.xxhash64(text).alias("_x")).withColumn("_r", F.row_number().over(order))
    right = m.select(F.col("doc_id").alias("_id2"), F.col("source").alias("_s2"), F.col("size").alias("_n2"), F.col("copies").alias("_copies")).withColumn("_r2", F.row_number().over(W.partitionBy("_id2", "_s2", "_n2").orderBy("_copies")))
    j = left.join(right, F.col("_id").eqNullSafe(F.col("_id2")) & F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_n") == F.col("_n2")) & (F.col("_r") == F.col("_r2")))
    return j.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*of_rows(docs))
