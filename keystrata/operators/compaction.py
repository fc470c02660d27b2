"""Runs, levels and compaction over a log (key, seq, is_put, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrata.plans.ordering import with_running_sum

#: Files of level 0 that make its score 1; bytes of level 1; growth of the levels after it.
L0_TRIGGER, L1_BYTES, GROWTH = 4, 10 << 20, 10


def entry_bytes() -> Column:
    """8 bytes for sequence and kind, the key and the value."""
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    return (F.lit(8) + size(F.col("key")) + size(F.col("value"))).cast("long")


def merge(*runs: DataFrame) -> DataFrame:
    """K-way merge: one ordered view of all runs."""
    return reduce(DataFrame.unionByName, runs).orderBy("key", F.desc("seq"))


def batches(log: DataFrame, batch: Column) -> DataFrame:
    return log.groupBy(batch.alias("batch_id")).agg(F.min("seq").alias("base_seq"), F.count(F.lit(1)).alias("cnt"), F.count_if("is_put").alias("puts"), F.count_if(~F.col("is_put")).alias("dels"))


def run_metadata(log: DataFrame, run: Column) -> DataFrame:
    """(run_id, smallest, largest, n, bytes, min_seq, max_seq), one map-side aggregation."""
    return log.groupBy(run.alias("run_id")).agg(F.min("key").alias("smallest"), F.max("key").alias("largest"), F.count(F.lit(1)).alias("n"), F.sum(entry_bytes()).alias("bytes"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


def flush_groups(log: DataFrame, limit: int, bucket_rows: int = 1 << 16) -> DataFrame:
    """The log with g: the write buffer each entry falls into when a buffer is frozen each `limit` bytes of the log."""
    d = with_running_sum(log.withColumn("_bytes", entry_bytes()), "_bytes", F.floor(F.col("seq") / bucket_rows), "seq", "_sum")
    return d.withColumn("g", F.floor(F.col("_sum") / limit).cast("long")).drop("_sum")


def minor(log: DataFrame, run: Column) -> DataFrame:
    """Each run with the newest version of each key."""
    w = W.partitionBy("run_id", "key").orderBy(F.desc("seq"))
    return log.withColumn("run_id", run).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def compact(log: DataFrame, floor: int, drop_tombstone: Column | None = None) -> DataFrame:
    """Drop what no snapshot at or above floor can see.

    A version goes when a newer one is visible at floor; a tombstone at or below floor goes too where drop_tombstone (default: everywhere)
    says that nothing outside the input holds its key. Both rules look at the input rows: the window reads them
    before anything is dropped."""
    newer = F.lead("seq").over(W.partitionBy("key").orderBy("seq"))
    gone = (F.coalesce(F.col("_newer") <= floor, F.lit(False))) | (~F.col("is_put") & (F.col("seq") <= floor) & (F.lit(True) if drop_tombstone is None else drop_tombstone))
    return log.withColumn("_newer", newer).where(~gone).drop("_newer")


def overlaps(runs: DataFrame) -> DataFrame:
    """Pairs of runs (a_id < b_id) whose key ranges meet. Run metadata is a row a file."""
    side = lambda p: runs.select(*[F.col(c).alias(f"{p}_{c}") for c in ("run_id", "smallest", "largest")])
    on = (F.col("a_run_id") < F.col("b_run_id")) & (F.col("a_smallest") <= F.col("b_largest")) & (F.col("b_smallest") <= F.col("a_largest"))
    return side("a").join(side("b"), on).select(F.col("a_run_id").alias("a_id"), F.col("b_run_id").alias("b_id"))


def level_scores(runs: DataFrame, level: Column, l0_trigger: int = L0_TRIGGER, l1_bytes: int = L1_BYTES, growth: int = GROWTH) -> DataFrame:
    """(lvl, files, bytes, score): level 0 by files, deeper ones by bytes. The highest score is compacted next."""
    d = runs.groupBy(level.alias("lvl")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    limit = F.lit(float(l1_bytes)) * F.pow(F.lit(float(growth)), F.greatest(F.col("lvl") - 1, F.lit(0)))
    return d.withColumn("score", F.when(F.col("lvl") == 0, F.col("files").cast("double") / l0_trigger).otherwise(F.col("bytes").cast("double") / limit))


def next_runs(runs: DataFrame, level: Column, pointer: Column) -> DataFrame:
    """(lvl, run_id, smallest, largest, pointer): the run that each level compacts next, going round its key space.

    pointer is the largest key that the level's last compaction took, null before the first: the run with the smallest key among those that reach beyond
    it is next, or the level's first run where none does. The new pointer is that run's largest key."""
    d = runs.withColumn("lvl", level).withColumn("_at", pointer)
    behind = F.coalesce(F.col("largest") <= F.col("_at"), F.lit(False))
    first = d.groupBy("lvl").agg(F.min(F.struct(behind.alias("behind"), "smallest", "run_id", "largest")).alias("m"))
    return first.select("lvl", "m.run_id", "m.smallest", "m.largest", F.col("m.largest").alias("pointer"))
