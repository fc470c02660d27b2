"""Shared helpers of the training-data operators: scratch tables, table reads, ranks without one-task windows."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Where set, Spark deletes an execution's shuffle files as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset a session on one machine (tests) gets a folder of
    its own, and one on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="keystrata-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(_drop, spark, found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and 8 MB: rows are whole texts, and two workers share an executor's memory."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(key).rstrip("bB")  # the default where it is unset
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _drop(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is deleted when the driver ends."""
    folder = f"{shared_dir(spark)}/keystrata-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_drop, spark, folder)
    return folder


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors. The shuffles that made
    it are deleted at once."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    with _setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage: only then does Spark drop the broadcast tables of finished plans from the executors' memory."""
    gc.collect()
    spark._jvm.System.gc()


def drop_stored(*dfs: DataFrame) -> None:
    """Delete the files of tables made by stored(), when nothing will read them again."""
    for df in dfs:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if os.path.basename(os.path.dirname(folder)).startswith("keystrata-"):
                _drop(df.sparkSession, folder)


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as the cluster has cores, where a scan has fewer (a table of one row group is read by one task)."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():  # no plain scan; counting its tasks would run it
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_rows(docs: DataFrame) -> DataFrame:
    """docs as one struct column _row: whatever docs' columns are called, they don't clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def of_rows(docs: DataFrame) -> list[Column]:
    """docs' columns out of _row."""
    return [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]


def global_rank(df: DataFrame, group: list[str], order: list[Column], bucket: Column, out: str) -> DataFrame:
    """0-based gapless rank of each row in its group by (bucket, *order).

    bucket must be a long that splits every group into many parts, in the wanted order. Row numbers are taken inside
    (group, bucket); how many rows stand before a bucket comes from the small table of counts, so that no
    window holds a whole hot group."""
    d = df.withColumn("_b", bucket)
    counts = d.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_b2"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_b") == F.col("_b2")]
    numbered = d.withColumn("_r", F.row_number().over(W.partitionBy(*group, "_b").orderBy(*order)))
    return numbered.join(before, on, "inner").withColumn(out, (F.col("_before") + F.col("_r") - 1).cast("long")).drop("_b", "_b2", "_r", "_before", *[f"_g{i}" for i in range(len(group))])


BITS = 1 << 24


def bit_set(df: DataFrame, value: str) -> bytes:
    """A set of BITS bits in which those of every value of a long column are set (value modulo BITS): 2 MB, whatever the input.

    It thins out rows before an exact join; false positives only cost work."""
    at = F.pmod(F.col(value), F.lit(BITS))
    rows = df.select(F.shiftright(at, 15).cast("int").alias("part"), at.bitwiseAND(32767).alias("bit")).groupBy("part").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).collect()
    out = bytearray(BITS // 8)
    for r in rows:
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = r["bits"]
    return bytes(out)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
