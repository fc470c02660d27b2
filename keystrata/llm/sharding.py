"""Sharding by jump consistent hashing.

A row's stable key and the number of shards decide its shard; no ring table is kept. When one shard is appended, a
row either stays or moves into the new shard, and just the needed fraction moves.

Defined cases: a null key is a key of its own; repeated rows share a shard and have slots of their own; a null
text weighs one byte and has the checksum of no bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import global_rank
from keystrata.llm.text_hash import fmix

_LCG = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key: each key jumps forward through shard counts until it would leave the table."""
    state = keys.astype(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    target = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = target[live]
        state[live] = state[live] * _LCG + np.uint64(1)
        step = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        target[live] = np.floor((shard[live] + 1) * ((1 << 31) / step)).astype(np.int64)
        live = live[target[live] < shards]
    return shard.astype(np.int32)


def stable_key(ids: pd.Series) -> np.ndarray:
    """Mixed 64-bit key of a long column; null has a fixed key."""
    raw = ids.fillna(0).astype("int64").to_numpy().view(np.uint64)
    return np.where(ids.isna().to_numpy(), np.uint64(0x5851F42D4C957F2D), fmix(raw + np.uint64(0x9E3779B97F4A7C15)))


def shard_rows(df: DataFrame, key: str, text: str, shards: int = 16) -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard, slot): slot numbers a shard's rows from 0 in a fixed order."""

    @F.pandas_udf("shard int, grown_shard int, mix long")
    def place(ids: pd.Series) -> pd.DataFrame:
        k = stable_key(ids)
        return pd.DataFrame({"shard": jump(k, shards), "grown_shard": jump(k, shards + 1), "mix": fmix(k).view(np.int64)})

    d = df.select(F.col(key).cast("long").alias("_key"), (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    d = d.withColumn("_p", place("_key")).select("*", "_p.*").drop("_p")
    d = global_rank(d, ["shard"], [F.col("mix"), F.col("_key"), F.col("size"), F.col("text_crc32")], F.shiftright("mix", 52), "slot")
    return d.select(F.col("_key").alias(key), "size", "text_crc32", "shard", "grown_shard", "slot")
