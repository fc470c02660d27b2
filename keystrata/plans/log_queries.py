"""The key-value operators as queries over the events table, which is a log: event_id is the sequence, user_id the key,
an 'error' event a tombstone and props the value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions import coding
from keystrata.operators import compaction, cursor, versions

SNAPSHOT, RUN, BATCH, FLUSH = 5000, 1000, 64, 16384


def log(spark: SparkSession, sf_dir: str, user: int | None = None) -> DataFrame:
    """The whole log, or that of one user: the key is computed from the id, so the id itself has to be asked for where the scan shall skip others."""
    put = F.col("event_type") != "error"
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e if user is None else e.where(F.col("user_id") == user)
    return e.select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("key"), F.col("event_id").alias("seq"), put.alias("is_put"), F.when(put, F.col("props")).alias("value"))


def _kv(d: DataFrame, *more: str) -> DataFrame:
    return d.select(F.col("key").alias("k"), F.col("value").alias("v"), *more)


def _full(d: DataFrame, *more: str) -> DataFrame:
    return d.select(*more, F.col("key").alias("k"), "seq", F.col("is_put").cast("int").alias("is_put"), F.col("value").alias("v"))


def _every(n: int):
    return F.floor(F.col("seq") / n).cast("long")


def _runs(d: DataFrame) -> DataFrame:
    return compaction.run_metadata(d, _every(RUN))


def _prefix_shared(d: DataFrame) -> DataFrame:
    n = cursor.neighbours(versions.visible(d).select("key"))
    return n.select(F.col("key").alias("k"), "pos", F.when(F.col("pos") % 16 == 0, F.lit(0)).otherwise(coding.shared_prefix(F.col("key"), F.col("prev_key"))).alias("shared"))


#: Values of more than four and of up to four varint bytes.
_WIDE, _NARROW = 1_000_003, 20_011


def _varint_decode(d: DataFrame) -> DataFrame:
    wide, narrow = coding.varint(F.col("seq") * _WIDE), coding.varint(F.col("seq") * _NARROW)
    cut = coding.read_varint(F.substring(wide, F.lit(1), F.octet_length(wide) - 1))
    return d.select("seq", F.hex(wide).alias("encoded"), coding.read_varint(wide)["value"].alias("decoded"), coding.read_varint(narrow, bits=32)["value"].alias("decoded32"), cut["value"].isNull().alias("short_is_refused"))


def _length_prefixed_read(d: DataFrame) -> DataFrame:
    """Two strings, one behind the other, read one after the other; a third isn't there."""
    key, value = F.col("key").cast("binary"), F.repeat("value", 12).cast("binary")
    d = d.where("is_put").withColumn("b", F.concat(coding.length_prefixed(key), coding.length_prefixed(value)))
    d = d.withColumn("one", coding.read_length_prefixed(F.col("b"))).withColumn("two", coding.read_length_prefixed(F.col("b"), F.col("one.next")))
    return d.select("seq", F.col("one.value").cast("string").alias("one"), F.col("two.value").cast("string").alias("two"), F.col("two.next").alias("n"), coding.read_length_prefixed(F.col("b"), F.col("two.next"))["next"].isNull().alias("at_end"))


_ON_LOG: dict[str, Callable[[DataFrame], DataFrame]] = {
    "kv_deleted_keys": lambda d: versions.deleted_keys(d).withColumnRenamed("key", "k"),
    "kv_visible": lambda d: _kv(versions.visible(d), "seq"),
    "kv_snapshot_get": lambda d: _kv(versions.visible(d, SNAPSHOT), "seq"),
    "kv_snapshot_diff": lambda d: versions.diff(d, SNAPSHOT).withColumnRenamed("key", "k"),
    "kv_scan_range": lambda d: _kv(cursor.scan(versions.visible(d), "000010", "000050")),
    "kv_scan_reverse": lambda d: _kv(cursor.scan(versions.visible(d), "000010", "000050", reverse=True)),
    "it_seek": lambda d: _kv(cursor.seek(versions.visible(d), "0000425")),
    "it_first_last": lambda d: versions.visible(d).agg(F.min("key").alias("first_k"), F.max("key").alias("last_k")),
    "it_next_prev": lambda d: cursor.neighbours(versions.visible(d).select("key")).select(F.col("key").alias("k"), F.col("prev_key").alias("prev_k"), F.col("next_key").alias("next_k")),
    "version_history": lambda d: versions.history(d).select(F.col("key").alias("k"), "seq", F.col("is_put").cast("int").alias("is_put"), F.col("value").alias("v"), "version_rank"),
    "flush_runs": lambda d: _runs(d).select("run_id", "smallest", "largest", "n", "bytes"),
    "flush_bytes": lambda d: compaction.flush_groups(d, FLUSH).groupBy("g").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n"), F.sum("_bytes").alias("bytes")),
    "minor_compact": lambda d: _full(compaction.minor(d, _every(RUN)), "run_id"),
    "major_compact": lambda d: _full(compaction.compact(d, SNAPSHOT)),
    "overlap_files": lambda d: compaction.overlaps(_runs(d)),
    "level_score": lambda d: compaction.level_scores(_runs(d), F.when(F.col("run_id") < 4, 1).otherwise(0)),
    "compaction_pointer": lambda d: compaction.next_runs(_runs(d), F.col("run_id") % 3, F.when(F.col("run_id") % 3 == 1, "000050").when(F.col("run_id") % 3 == 2, "zzz")),
    "batch_summary": lambda d: compaction.batches(d, _every(BATCH)),
    "varint_len": lambda d: d.select("seq", coding.varint_length(F.col("seq")).alias("n")),
    "prefix_shared": _prefix_shared,
    "varint_codec": lambda d: d.select("seq", F.hex(coding.varint(F.col("seq"))).alias("encoded"), coding.read_varint(coding.varint(F.col("seq")))["value"].alias("decoded")),
    "fixed_codec": lambda d: d.select("seq", F.hex(coding.fixed32(F.col("seq"))).alias("f32"), F.hex(coding.fixed64(F.col("seq"))).alias("f64"), coding.read_fixed64(coding.fixed64(F.col("seq"))).alias("decoded")),
    "length_prefixed": lambda d: d.where("is_put").select("seq", F.hex(coding.length_prefixed(F.col("value").cast("binary"))).alias("encoded")),
    "varint_decode": _varint_decode,
    "length_prefixed_read": _length_prefixed_read,
    "merge_runs": lambda d: _full(compaction.merge(*[d.where(F.col("seq") % 4 == i) for i in range(4)])),
    "key_hash": lambda d: d.select("seq", coding.key_hash(F.col("seq").cast("long")).alias("h")),
    "crc32c": lambda d: d.select("seq", coding.crc32c(F.coalesce(F.col("value"), F.lit("")).cast("binary")).alias("crc")),
}


def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kv(versions.get(log(spark, sf_dir, 42), "000042"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"kv_get": kv_get} | {name: (lambda spark, sf_dir, f=f: f(log(spark, sf_dir))) for name, f in _ON_LOG.items()}


_LOG = "log as (select event_id as seq, lpad(cast(user_id as varchar),6,'0') as k, case when event_type='error' then 0 else 1 end as is_put, case when event_type='error' then null else props end as v from events)"
_VIS = "vis as (select k,v,seq from (select *, row_number() over(partition by k order by seq desc) rn from log) t where rn=1 and is_put=1)"
_AT = f"(select k,v,seq from (select *, row_number() over(partition by k order by seq desc) rn from log where seq<={SNAPSHOT}) t where rn=1 and is_put=1)"
_RUNS = f"(select cast(floor(seq/{RUN}) as bigint) run_id, min(k) smallest, max(k) largest, count(*) n, cast(sum(8+length(k)+coalesce(length(v),0)) as bigint) bytes from log group by 1)"
_BYTES = "8+length(k)+coalesce(length(v),0)"
_HEX = "right('0000000000000000'||upper(to_hex({x})),{n})"


def _little(x: str, n: int) -> str:
    return "||".join(f"substr({_HEX.format(x=x, n=n)},{i},2)" for i in range(n - 1, 0, -2))


_VARINT = """case when seq<128 then {a} when seq<16384 then {b} else {c} end""".format(
    a="right('0'||upper(to_hex(seq)),2)",
    b="right('0'||upper(to_hex((seq & 127) | 128)),2)||right('0'||upper(to_hex(seq >> 7)),2)",
    c="right('0'||upper(to_hex((seq & 127) | 128)),2)||right('0'||upper(to_hex(((seq >> 7) & 127) | 128)),2)||right('0'||upper(to_hex(seq >> 14)),2)",
)

_BITS = "length(bin(x))"


def _times(x: str, n: int) -> str:
    return f"(({x})::hugeint*{n}%4294967296)::bigint"


def _turned(x: str, n: int) -> str:
    return f"(((({x})<<{n})|(({x})>>{32 - n}))&4294967295)"


# Murmur3 over the two halves of a long; the numbers are those of the published function, and may not differ.
_WORD = _times(_turned(_times("w", 3432918353), 15), 461845907)
_MURMUR = f"list_reduce([42, seq&4294967295, seq>>32], lambda h,w: ({_times(_turned(f'xor(h,{_WORD})', 13), 5)}+3864292196)&4294967295)"
_CASTAGNOLI = "list_transform(range(256), lambda x: list_reduce(list_prepend(x::bigint, range(8)), lambda a,b: case when a&1=1 then xor(a>>1, 2197175160) else a>>1 end))"

_SQL = {
    "varint_decode": f"select seq, array_to_string(list_transform(range(cast(ceil({_BITS}/7.0) as bigint)), lambda i: right('0'||upper(to_hex(((x >> (7*i)::int) & 127) | case when i<ceil({_BITS}/7.0)-1 then 128 else 0 end)),2)), '') encoded, x decoded, seq*{_NARROW} decoded32, true short_is_refused from (select seq, seq*{_WIDE} x from log) w",
    "length_prefixed_read": "select seq, k one, repeat(v,12) two, cast(1+strlen(k)+case when strlen(v)*12<128 then 1 else 2 end+strlen(v)*12 as int) n, true at_end from log where is_put=1",
    "merge_runs": "select k,seq,is_put,v from log",
    "crc32c": f"select seq, case when length(b)=0 then 0 else xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(b,''), lambda ch: ascii(ch)::bigint)), lambda c,x: xor(tab[(xor(c,x)&255)+1], c>>8)), 4294967295) end crc from (select seq, coalesce(v,'') b from log) w, (select {_CASTAGNOLI} tab) t",
    "key_hash": f"select seq, cast(case when h>=2147483648 then h-4294967296 else h end as int) h from (select seq, xor(h,h>>16) h from (select seq, {_times('xor(h,h>>13)', 3266489909)} h from (select seq, {_times('xor(h,h>>16)', 2246822507)} h from (select seq, xor({_MURMUR},8) h from (select seq::bigint seq from log) l) a) b) c) d",
    "compaction_pointer": f"select lvl,run_id,smallest,largest,largest pointer from (select *, row_number() over(partition by lvl order by case when largest>reached then 0 else 1 end, smallest, run_id) rn from (select *, run_id%3 lvl, case run_id%3 when 0 then '' when 1 then '000050' else 'zzz' end reached from {_RUNS} r) l) t where rn=1",
    "kv_get": "select k,v from vis where k='000042'",
    "kv_deleted_keys": "select k,max(seq) last_seq from log where k not in (select k from vis) group by k",
    "kv_visible": "select k,v,seq from vis",
    "kv_snapshot_get": f"select k,v,seq from {_AT}",
    "kv_snapshot_diff": f"select coalesce(a.k,b.k) k, case when a.k is null then 'inserted' when b.k is null then 'deleted' else 'updated' end change from {_AT} a full join vis b on a.k=b.k where a.k is null or b.k is null or a.seq<>b.seq",
    "kv_scan_range": "select k,v from vis where k>='000010' and k<'000050' order by k",
    "kv_scan_reverse": "select k,v from vis where k>='000010' and k<'000050' order by k desc",
    "it_seek": "select k,v from vis where k>='0000425' order by k limit 1",
    "it_first_last": "select min(k) first_k,max(k) last_k from vis",
    "it_next_prev": "select k,lag(k) over(order by k) prev_k,lead(k) over(order by k) next_k from vis",
    "version_history": "select k,seq,is_put,v,cast(row_number() over(partition by k order by seq desc) as bigint) version_rank from log",
    "flush_runs": f"select * from {_RUNS}",
    "flush_bytes": f"select g,min(seq) first_seq,max(seq) last_seq,count(*) n,cast(sum(b) as bigint) bytes from (select *, cast(floor((sum(b) over(order by seq rows between unbounded preceding and current row)-b)/{FLUSH}) as bigint) g from (select *, {_BYTES} b from log) s) gen group by g",
    "minor_compact": f"select run_id,k,seq,is_put,v from (select *,row_number() over(partition by run_id,k order by seq desc) rn from (select *, cast(floor(seq/{RUN}) as bigint) run_id from log) r) t where rn=1",
    "major_compact": f"select k,seq,is_put,v from (select *, lead(seq) over(partition by k order by seq) newer from log) x where not (newer is not null and newer<={SNAPSHOT}) and not (is_put=0 and seq<={SNAPSHOT})",
    "overlap_files": f"select a.run_id a_id,b.run_id b_id from {_RUNS} a join {_RUNS} b on a.run_id<b.run_id and a.smallest<=b.largest and b.smallest<=a.largest",
    "level_score": f"select lvl,count(*) files,cast(sum(bytes) as bigint) bytes,case when lvl=0 then cast(count(*) as double)/4 else cast(sum(bytes) as double)/10485760 end score from (select case when run_id<4 then 1 else 0 end lvl, bytes from {_RUNS} r) l group by lvl",
    "batch_summary": f"select batch_id, min(seq) base_seq, count(*) cnt, cast(sum(is_put) as bigint) puts, cast(count(*)-sum(is_put) as bigint) dels from (select *, cast(floor(seq/{BATCH}) as bigint) batch_id from log) b group by batch_id",
    "varint_len": "select seq, cast(ceil(length(bin(seq))/7.0) as int) n from log",
    "prefix_shared": "select k,pos,case when pos%16=0 then 0 else cast(coalesce(list_max(list_filter(range(0,length(k)+1), lambda i: substring(k,1,i::int)=substring(pk,1,i::int))),0) as int) end shared from (select k, cast(row_number() over(order by k)-1 as bigint) pos, lag(k) over(order by k) pk from vis) o",
    "varint_codec": f"select seq, {_VARINT} encoded, seq decoded from log",
    "fixed_codec": f"select seq, {_little('seq', 8)} f32, {_little('seq', 16)} f64, seq decoded from log",
    "length_prefixed": "select seq, right('0'||upper(to_hex(strlen(v))),2)||hex(encode(v)) encoded from log where is_put=1",
}


def with_log(sql: dict[str, str]) -> dict[str, str]:
    return {name: f"with {_LOG}, {_VIS} {x}" for name, x in sql.items()}


def oracle_sql() -> dict[str, str]:
    return with_log(_SQL)
