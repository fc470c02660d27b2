"""Every key-value query against its SQL form, and properties that the SQL comparison can't see."""

import duckdb
import pytest
from pyspark.sql import functions as F

from keystrata.operators import compaction, cursor, versions
from keystrata.plans import log_queries, ordering, store_queries

SF = "/root/testdata/sf0.01"


def rows(df):
    cols = sorted(df.columns)
    return sorted([tuple(str(x) for x in r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False)])


QUERIES, SQL = log_queries.queries() | store_queries.queries(), log_queries.oracle_sql() | store_queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    ours, theirs = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_scan_order(spark):
    log = log_queries.log(spark, SF)
    up = [r["key"] for r in cursor.scan(versions.visible(log)).collect()]
    down = [r["key"] for r in cursor.scan(versions.visible(log), reverse=True).collect()]
    assert up == sorted(up) and down == up[::-1]


@pytest.mark.parametrize("floor", [5000])
@pytest.mark.parametrize("at", [5000, 7500, 9999])
def test_compaction_keeps_what_snapshots_see(spark, floor, at):
    log = log_queries.log(spark, SF)
    small = compaction.compact(log, floor)
    assert small.count() < log.count()
    assert sorted(versions.visible(small, at).collect()) == sorted(versions.visible(log, at).collect())


def test_snapshot_filter_stands_below_version_resolution(spark):
    log = log_queries.log(spark, SF)
    wrong = versions.visible(log).where(F.col("seq") <= 5000)
    assert sorted(wrong.collect()) != sorted(versions.visible(log, 5000).collect())


def test_plans(spark):
    log = log_queries.log(spark, SF)
    plan = versions.get(log, "000042")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    assert "PushedFilters: [IsNotNull(event_id), LessThanOrEqual(event_id" in versions.visible(log, 10)._jdf.queryExecution().toString()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_get_reaches_the_scan(spark):
    assert "EqualTo(user_id,42)" in log_queries.kv_get(spark, SF)._jdf.queryExecution().toString()


def test_ordered_plans_force_no_broadcast_and_no_growing_window(spark):
    """Sums before buckets are taken by spans; however many buckets there are, one task sees a row a span."""
    d = spark.range(100_000).select(F.col("id").alias("seq"), (F.col("id") % 7).alias("v"))
    out = ordering.with_running_sum(d, "v", F.floor(F.col("seq") / 16), "seq", "s")
    assert "BroadcastHint" not in out._jdf.queryExecution().toString() and "strategy=broadcast" not in out._jdf.queryExecution().toString()
    got = {r["seq"]: r["s"] for r in out.where("seq % 9999 = 0").collect()}
    assert got == {n: sum(i % 7 for i in range(n)) for n in got} and len(got) == 11
    rows = spark.range(1000).select(F.format_string("%05d", "id").alias("key"))
    n = cursor.neighbours(rows)
    assert sorted((r["key"], r["prev_key"], r["next_key"], r["pos"]) for r in n.where("pos in (0, 500)").collect()) == [("00000", None, "00001", 0), ("00500", "00499", "00501", 500)]
    assert "strategy=broadcast" not in n._jdf.queryExecution().toString()


def test_broken_cursor_raises(spark):
    d = cursor.failed(spark, "key string, value string", "no such run")
    assert d.columns == ["key", "value"]
    with pytest.raises(Exception, match="no such run"):
        d.collect()


def test_compaction_goes_round(spark):
    """Each turn takes the next run of the level, and the first one again after the last."""
    runs = spark.createDataFrame([(3, "g", "k"), (1, "a", "c"), (2, "d", "f")], "run_id long, smallest string, largest string")
    pointer, taken = None, []
    for _ in range(4):
        (r,) = compaction.next_runs(runs, F.lit(1), F.lit(pointer).cast("string")).collect()
        taken.append(r["run_id"])
        pointer = r["pointer"]
    assert taken == [1, 2, 3, 1]
    assert compaction.next_runs(runs.where("false"), F.lit(1), F.lit("a")).count() == 0
