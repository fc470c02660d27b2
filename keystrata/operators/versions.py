"""Version resolution over a log (key, seq, is_put, value): what a snapshot sees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The part of the log that a snapshot sees. It stands below version resolution, so it reaches the scan."""
    return log if snapshot is None else log.where(F.col("seq") <= snapshot)


def newest(log: DataFrame) -> DataFrame:
    """The newest version of each key, tombstones included. Spark limits each task to one row a key before the shuffle."""
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("seq")))
    return log.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def visible(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """K(S): the newest version of each key at the snapshot, without deleted keys."""
    return newest(as_of(log, snapshot)).where("is_put")


def get(log: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    """The visible row of one key, or none. The key predicate is pushed to the scan."""
    return visible(log.where(F.col("key") == F.lit(key)), snapshot)


def multi_get(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The visible rows of many keys: the keys thin out the log before versions are resolved."""
    return visible(log.join(keys.select("key").distinct(), "key", "left_semi"), snapshot)


def deleted_keys(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Keys whose newest version is a tombstone, with its sequence."""
    return newest(as_of(log, snapshot)).where("not is_put").select("key", F.col("seq").alias("last_seq"))


def diff(log: DataFrame, old: int, new: int | None = None) -> DataFrame:
    """(key, change): inserted, deleted or updated from one snapshot to the other.

    One aggregation by key instead of a join of two resolved states."""
    seen = F.col("seq") <= old
    d = as_of(log, new).groupBy("key").agg(
        F.max(F.when(seen, F.struct("seq", "is_put"))).alias("o"), F.max(F.struct("seq", "is_put")).alias("n")
    )
    was, now = F.coalesce(F.col("o.is_put"), F.lit(False)), F.col("n.is_put")
    change = F.when(~was & now, "inserted").when(was & ~now, "deleted").when(was & now & (F.col("o.seq") != F.col("n.seq")), "updated")
    return d.select("key", change.alias("change")).where("change is not null")


def history(log: DataFrame) -> DataFrame:
    """All versions with their rank, newest first."""
    return log.withColumn("version_rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("seq"))).cast("long"))
