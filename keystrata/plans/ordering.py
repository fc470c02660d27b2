"""Global order without a one-task window: deterministic range buckets, ranks, running sums and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fewest range buckets, and sampled keys for each.
BUCKETS, SAMPLES = 64, 32
#: Buckets whose sums are added up in one task at a time.
SPAN = 1024


def range_bounds(df: DataFrame, key: str, buckets: int | None = None) -> list:
    """Split points for range buckets, as many as the session has shuffle partitions (BUCKETS at least), from the keys of least
    hash: SAMPLES a bucket come to the driver, the same in each run. Each task keeps only its own least ones."""
    n = buckets or max(BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.where(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(key), key).limit(n * SAMPLES).collect()
    keys = sorted({bytes(r[0]) if isinstance(r[0], bytearray) else r[0] for r in rows}, key=lambda x: x.encode() if isinstance(x, str) else x)
    step = max(1, len(keys) // n)
    return keys[step::step][: n - 1]


def bucket_of(key: str, bounds: list) -> Column:
    """How many bounds are at or below the key."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x <= F.col(key)))


def sums_before(sums: DataFrame, bucket: str, value: str, out: str) -> DataFrame:
    """(bucket, out): the sum of value in all buckets before. sums has a row a bucket, numbered from 0.

    Buckets are added up by SPAN of them first; only a row for each span meets in one task."""
    d = sums.withColumn("_span", F.floor(F.col(bucket) / SPAN))
    inside = W.partitionBy("_span").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    over = W.orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    spans = d.groupBy("_span").agg(F.sum(value).alias("_v")).select("_span", F.coalesce(F.sum("_v").over(over), F.lit(0)).alias("_spans"))
    d = d.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return d.join(spans, "_span").select(bucket, (F.col("_in") + F.col("_spans")).alias(out))


def with_running_sum(df: DataFrame, value: str, bucket: Column, order: str, out: str) -> DataFrame:
    """Adds the sum of value over all earlier rows in order (this row left out). bucket must follow the order."""
    d = df.withColumn("_b", bucket)
    before = sums_before(d.groupBy("_b").agg(F.sum(value).alias("_s")), "_b", "_s", "_before")
    inside = F.coalesce(F.sum(value).over(W.partitionBy("_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn(out, inside).join(before, "_b").withColumn(out, F.col(out) + F.col("_before")).drop("_b", "_before")


def with_neighbours(df: DataFrame, key: str, bounds: list, prev: str = "prev_key", after: str = "next_key", pos: str = "pos") -> DataFrame:
    """Adds the keys before and after and the 0-based position in key order. Edges of buckets are stitched from one row a bucket:
    there are as many buckets as bounds, which the driver holds, so they don't grow with the rows."""
    d = df.withColumn("_b", bucket_of(key, bounds))
    w, o = W.partitionBy("_b").orderBy(key), W.orderBy("_b")
    edges = d.groupBy("_b").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    edges = edges.select("_b", F.lag("_hi").over(o).alias("_before"), F.lead("_lo").over(o).alias("_after"), F.coalesce(F.sum("_n").over(o.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_at"))
    d = d.withColumn(prev, F.lag(key).over(w)).withColumn(after, F.lead(key).over(w)).withColumn(pos, F.row_number().over(w) - 1)
    d = d.join(edges, "_b")
    return d.withColumn(prev, F.coalesce(prev, "_before")).withColumn(after, F.coalesce(after, "_after")).withColumn(pos, (F.col(pos) + F.col("_at")).cast("long")).drop("_b", "_before", "_after", "_at")
