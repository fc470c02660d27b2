"""The store, the log files and the file names as queries over the events table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions import wal
from keystrata.operators import cursor, versions
from keystrata.plans import log_queries
from keystrata.sources import files
from keystrata.sources.scratch import folder
from keystrata.sources.store import Options, Store, repair

LOG_FILE = 512


def _ops(log: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """The log's entries with low <= seq < high as a batch."""
    d = log if low is None else log.where(F.col("seq") >= low)
    d = d if high is None else d.where(F.col("seq") < high)
    return d.select((F.col("seq") - (low or 0)).alias("ordinal"), F.col("key").cast("binary").alias("key"), "is_put", F.col("value").cast("binary").alias("value"))


def _text(d: DataFrame, **more) -> DataFrame:
    return d.select(*[F.lit(v).alias(k) for k, v in more.items()], F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


def _loaded(spark: SparkSession, sf_dir: str, tag: str) -> tuple[str, str, Options]:
    """A store with the events in four batches, a snapshot after the second: (path, snapshot, options). The sequence of event e is e + 1."""
    log, path, options = log_queries.log(spark, sf_dir), folder(spark, tag), Options(grace_ms=0)
    half = log_queries.SNAPSHOT
    with Store(spark, path, options) as db:
        cuts = [0, half // 2, half, half + half // 2, None]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low == half:
                name = db.snapshot()
            db.write_frame(_ops(log, low, high))
    return path, name, options


def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, compact while a snapshot is held, delete what is left over, open again and scan, now and at the snapshot."""
    path, name, options = _loaded(spark, sf_dir, "scan")
    with Store(spark, path, options) as db:
        db.compact_range()
        db.vacuum()
    db = Store(spark, path, Options(read_only=True))
    return _text(db.scan("000010", "000050"), at="now").unionByName(_text(db.scan("000010", "000050", snapshot=name), at="snapshot"))


def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store still holds after its snapshot was released and all runs were merged: the newest versions, no tombstones."""
    path, name, options = _loaded(spark, sf_dir, "compacted")
    with Store(spark, path, options) as db:
        db.release_snapshot(name)
        db.compact_range()
    return Store(spark, path, Options(read_only=True)).log().select(F.col("key").cast("string").alias("k"), (F.col("seq") - 1).alias("seq"), F.col("is_put").cast("int").alias("is_put"), F.col("value").cast("string").alias("v"))


def store_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live keys of a store whose CURRENT was lost and that was repaired, after a write and a delete."""
    path, _, options = _loaded(spark, sf_dir, "repaired")
    files.Files(spark, path).delete("CURRENT")
    with repair(spark, path, options) as db:
        db.put("zzz", "new")
        db.delete("000042")
    return _text(Store(spark, path, Options(read_only=True)).rows())


def store_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many keys at once, some of which aren't there."""
    path, _, _ = _loaded(spark, sf_dir, "multi-get")
    keys = spark.range(0, 400, 3).select(F.lpad(F.col("id").cast("string"), 6, "0").cast("binary").alias("key"))
    return _text(Store(spark, path, Options(read_only=True)).multi_get(keys))


def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(level, files, rows) before and after all runs were merged into level 1 with the snapshot held."""
    path, _, options = _loaded(spark, sf_dir, "stats")
    with Store(spark, path, options) as db:
        before = db.stats().select(F.lit("loaded").alias("state"), "level", "files", "rows")
        db.compact_range()
        return before.unionByName(db.stats().select(F.lit("compacted").alias("state"), "level", "files", "rows"))


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as log files of LOG_FILE records each, read back."""
    log = log_queries.log(spark, sf_dir).where("is_put").withColumn("file", F.floor(F.col("seq") / LOG_FILE))
    back = wal.read_logs(wal.write_logs(log, "file", "seq", "value"))
    return back.select(F.col("path").cast("long").alias("file"), "ordinal", F.col("record").cast("string").alias("record"), F.col("error").isNotNull().alias("damaged"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("seq").cast("string")
    n = F.lpad(n, F.greatest(F.lit(6), F.length(n)), "0")  # lpad cuts what is longer
    kinds = [F.concat(n, F.lit(x)) for x in (".wal", ".sst", ".dbtmp", ".txt")] + [F.concat(F.lit("MANIFEST-"), n), F.lit("CURRENT"), F.lit("LOCK"), F.lit("LOG")]
    name = reduce(lambda out, i: F.when(F.col("seq") % 8 == i, kinds[i]).otherwise(out), range(8), F.lit(None).cast("string"))
    return files.parse_names(log_queries.log(spark, sf_dir).select("seq", name.alias("name"))).select("seq", "name", F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("number", F.lit(-1)).cast("long").alias("number"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of four keys three inserts left behind, through a store."""
    path = folder(spark, "members")
    with Store(spark, path) as db:
        for k in ("abc", "def", "ghi"):
            db.put(k, "")
    asked = spark.createDataFrame([(k,) for k in ("abc", "def", "ghi", "adc")], "k string")
    held = Store(spark, path, Options(read_only=True)).multi_get(asked.select(F.col("k").cast("binary").alias("key"))).select(F.col("key").cast("string").alias("held"))
    return asked.join(held, F.col("k") == F.col("held"), "left").select("k", F.col("held").isNotNull().alias("member"))


def cursor_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a cursor over the visible keys comes to stand by each of its moves."""
    d = versions.visible(log_queries.log(spark, sf_dir)).select("key", "value")
    moves = {
        "first": cursor.first(d), "last": cursor.last(d), "next": cursor.next_row(d, "000042"), "prev": cursor.prev_row(d, "000042"), "seek": cursor.seek(d, "0000425"),
        "seek_for_prev": cursor.seek_for_prev(d, "0000425"), "seek_past_end": cursor.seek(d, "z"), "empty": cursor.empty(spark, d.schema),
    }
    return reduce(DataFrame.unionByName, [_text(x, move=m) for m, x in moves.items()])


_ALL: tuple[Callable[[SparkSession, str], DataFrame], ...] = (store_scan, store_compacted, store_repaired, store_multi_get, store_stats, log_files, file_names, members, cursor_moves)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_HALF = log_queries.SNAPSHOT
_KIND = "case when seq%8 in (0,1,2) then case seq%8 when 0 then 'wal' when 1 then 'sst' else 'temp' end when seq%8=3 then 'none' when seq%8=4 then 'manifest' when seq%8=5 then 'current' when seq%8=6 then 'lock' else 'log' end"
_NAME = "case seq%8 when 0 then n||'.wal' when 1 then n||'.sst' when 2 then n||'.dbtmp' when 3 then n||'.txt' when 4 then 'MANIFEST-'||n when 5 then 'CURRENT' when 6 then 'LOCK' else 'LOG' end"

_SQL = {
    # the store's sequences start at 1: the snapshot was taken after the events below _HALF
    "store_scan": f"select 'now' as at, k, v from vis where k>='000010' and k<'000050' union all select 'snapshot', k, v from (select *, row_number() over(partition by k order by seq desc) rn from log where seq<{_HALF}) t where rn=1 and is_put=1 and k>='000010' and k<'000050'",
    "store_compacted": "select k, seq, 1 as is_put, v from vis",
    "store_repaired": "select k, v from vis where k<>'000042' union all select 'zzz', 'new'",
    "store_multi_get": "select k, v from vis where cast(k as int)<400 and cast(k as int)%3=0",
    "store_stats": f"""select 'loaded' state, 0 as level, cast(4 as bigint) files, count(*) as rows from log union all
        select 'compacted', 1, cast(1 as bigint), count(*) from (select *, lead(seq) over(partition by k order by seq) newer from log) x where not (newer is not null and newer<{_HALF}) and not (is_put=0 and seq<{_HALF})""",
    "log_files": f"select cast(floor(seq/{LOG_FILE}) as bigint) as file, cast(row_number() over(partition by cast(floor(seq/{LOG_FILE}) as bigint) order by seq)-1 as bigint) ordinal, v as record, false as damaged from log where is_put=1",
    "file_names": f"select seq, {_NAME} as name, {_KIND} as kind, cast(case when seq%8=3 then -1 when seq%8>4 then 0 else seq end as bigint) as number from (select seq, lpad(cast(seq as varchar),6,'0') n from log) x",
    "members": "select * from (values ('abc',true),('def',true),('ghi',true),('adc',false)) t(k,member)",
    "cursor_moves": """select 'first' as move,k,v from vis where k=(select min(k) from vis) union all select 'last',k,v from vis where k=(select max(k) from vis)
        union all select 'next',k,v from vis where k=(select min(k) from vis where k>'000042') union all select 'prev',k,v from vis where k=(select max(k) from vis where k<'000042')
        union all select 'seek',k,v from vis where k=(select min(k) from vis where k>='0000425') union all select 'seek_for_prev',k,v from vis where k=(select max(k) from vis where k<='0000425')""",
}


def oracle_sql() -> dict[str, str]:
    return log_queries.with_log(_SQL)
