"""Ordered cursors over visible rows (key, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.plans.ordering import range_bounds, with_neighbours


def in_range(rows: DataFrame, begin=None, end=None) -> DataFrame:
    """begin <= key < end; a bound that is None is open."""
    if begin is not None:
        rows = rows.where(F.col("key") >= F.lit(begin))
    return rows if end is None else rows.where(F.col("key") < F.lit(end))


def scan(rows: DataFrame, begin=None, end=None, reverse: bool = False) -> DataFrame:
    return in_range(rows, begin, end).orderBy(F.desc("key") if reverse else F.asc("key"))


def seek(rows: DataFrame, target) -> DataFrame:
    """The first row at or after target."""
    return rows.where(F.col("key") >= F.lit(target)).orderBy("key").limit(1)


def seek_for_prev(rows: DataFrame, target) -> DataFrame:
    """The last row at or before target."""
    return rows.where(F.col("key") <= F.lit(target)).orderBy(F.desc("key")).limit(1)


def first(rows: DataFrame) -> DataFrame:
    return rows.orderBy("key").limit(1)


def last(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("key")).limit(1)


def next_row(rows: DataFrame, key) -> DataFrame:
    return rows.where(F.col("key") > F.lit(key)).orderBy("key").limit(1)


def prev_row(rows: DataFrame, key) -> DataFrame:
    return rows.where(F.col("key") < F.lit(key)).orderBy(F.desc("key")).limit(1)


def neighbours(rows: DataFrame) -> DataFrame:
    """rows with prev_key, next_key and position, over range buckets."""
    return with_neighbours(rows, "key", range_bounds(rows, "key"))


def empty(spark: SparkSession, schema) -> DataFrame:
    """A cursor that is never valid."""
    return spark.createDataFrame([], schema)


def failed(spark: SparkSession, schema, message: str) -> DataFrame:
    """A cursor that holds nothing and raises message when it is read."""
    return spark.range(1).where(F.raise_error(F.lit(message)).cast("boolean")).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in empty(spark, schema).schema])
