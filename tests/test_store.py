"""The store on disk: against a dictionary, crash points, snapshots, compaction, repair, streaming, the command line."""

import os
import random

import pytest
from pyspark.sql import functions as F

from keystrata import cli
from keystrata.functions import coding, wal
from keystrata.operators import cursor
from keystrata.plans import store_queries
from keystrata.sources import store as S
from keystrata.sources.files import kind_of, parse_names
from keystrata.streaming.ingest import ingest


def state(store, snapshot=None):
    return list(store.iterate(snapshot=snapshot))


def test_random_operations_match_a_dictionary(spark, tmp_path):
    rng = random.Random(1)
    keys = [b"", b"a", b"ab", b"b", b"\x7f", b"\x80", b"\xff", b"\xff\x00"]
    want, seen = {}, {}
    with S.Store(spark, f"file://{tmp_path}/db", S.Options(l0_stop=50)) as db:
        for step in range(5):
            batch = S.WriteBatch()
            for _ in range(rng.randrange(1, 7)):
                k = rng.choice(keys)
                if rng.random() < 0.35:
                    batch.delete(k)
                    want.pop(k, None)
                else:
                    v = rng.choice([b"", b"x%d" % step])
                    batch.put(k, v)
                    want[k] = v
            db.write(batch)
            if step in (1, 3):
                seen[db.snapshot()] = dict(want)
            if step == 2:
                assert db.compact_level(0)
        for how in (lambda: None, lambda: db.compact_range(b"a", b"b"), lambda: db.compact_range()):
            how()
            assert state(db) == sorted(want.items())
            for s, was in seen.items():
                assert state(db, s) == sorted(was.items())
        assert state(db) == list(reversed(list(db.iterate(reverse=True))))
        for s in seen:
            db.release_snapshot(s)
        db.compact_range()
        assert int(db.get_property("total-entries")) == len(want) == db.log().count()
        assert [r["key"] for r in cursor.neighbours(db.rows()).orderBy("pos").collect()] == sorted(want)


def test_partial_compaction_keeps_tombstones(spark, tmp_path):
    with S.Store(spark, f"file://{tmp_path}/db") as db:
        db.write(S.WriteBatch().put("a", "1").put("z", "1"))
        db.compact_level(0)  # to level 1
        db.compact_level(1)  # to level 2
        db.delete("a")
        db.compact_level(0)  # the put is still below
        assert [(k, v) for k, v in state(db)] == [(b"z", b"1")]
        with pytest.raises(S.NotFound):
            db.get("a")
        db.compact_range()
        assert db.log().where("not is_put").count() == 0 and db.get("z") == b"1"


def test_crash_lock_reader_vacuum_repair_destroy(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    with pytest.raises(S.NotFound):
        S.Store(spark, path, S.Options(read_only=True))
    db = S.Store(spark, path)
    db.put("k", "old")
    with pytest.raises(S.Busy):
        S.Store(spark, path)
    reader = S.Store(spark, path, S.Options(read_only=True))
    db._write_run(db._next(), spark.createDataFrame([(bytearray(b"k"), 9, True, bytearray(b"lost"))], S.LOG_SCHEMA), 0)  # crash before the manifest
    db.close()
    with S.Store(spark, path, S.Options(grace_ms=0)) as db:
        assert db.get("k") == b"old"
        db.put("k", "new")
        assert reader.get("k") == b"old" and reader.refresh().get("k") == b"new"
        assert db.get("k", snapshot=1) == b"old"
        assert [n for n in db.vacuum() if n.startswith("runs")] == [] or db.get("k") == b"new"
    (tmp_path / "db" / "CURRENT").write_text("999999.json")
    with pytest.raises(S.Corruption):
        S.Store(spark, path)
    with S.repair(spark, path) as db:
        assert db.get("k") == b"new" and db.put("k", "newer") == 3
    with pytest.raises(S.InvalidArgument):
        S.destroy(spark, f"file://{tmp_path}")
    S.destroy(spark, path)
    assert not (tmp_path / "db").exists()


def test_write_pressure(spark, tmp_path):
    with S.Store(spark, f"file://{tmp_path}/db", S.Options(l0_slow=1, l0_stop=2)) as db:
        db.put("a", "1")
        db.put("b", "2")
        with pytest.raises(S.Busy):
            db.put("c", "3")
        assert db.scores()[0] == (0, 0.5) and not db.compact_level()
        db.compact_level(0)
        db.put("c", "3")
        assert len(state(db)) == 3


def test_stream_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", True, "1"), (2, "a", False, None), (3, "a", True, "2"), (4, "b", True, "")], "n long, key string, is_put boolean, value string")
    rows.write.parquet(str(tmp_path / "in"))
    with S.Store(spark, f"file://{tmp_path}/db") as db:
        src = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        for point in ("c1", "c2"):  # another checkpoint replays batch 0
            q = ingest(src, db, "feed", str(tmp_path / point), "n", availableNow=True)
            q.awaitTermination()
        assert state(db) == [(b"a", b"2"), (b"b", b"")] and db.log().count() == 4


def test_command_line(spark, tmp_path):
    with S.Store(spark, f"file://{tmp_path}/db") as db:
        say = [cli.run(db, x) for x in ("put abc 1", "put def 2", "put ghi 3", "get adc", "get def", "del def", "scan abc ghi", "scan", "compact", "stats", "dbdir", "help", "put x", "quit")]
    assert say[:8] == ["OK", "OK", "OK", "not found", "2", "OK", "abc 1", "abc 1\nghi 3"]
    assert say[8] == "OK" and "level 1: 1 runs, 2 entries" in say[9] and say[10].endswith("/db") and say[-1] is None


U64 = [0, 127, 128, 300, 16383, 16384, 2**32 - 1, 2**63, 2**64 - 1]


def test_codecs(spark):
    signed = [x - 2**64 if x >= 2**63 else x for x in U64]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "i int, x long")
    v = coding.varint(F.col("x"))
    got = d.select("x", F.hex(v).alias("h"), coding.varint_length(F.col("x")).alias("n"), coding.read_varint(v).alias("r"), coding.read_fixed64(coding.fixed64(F.col("x"))).alias("f"), coding.read_fixed32(coding.fixed32(F.col("x"))).alias("f32"), coding.read_length_prefixed(coding.length_prefixed(v)).alias("l"), v.alias("v")).orderBy("i").collect()
    for u, s, r in zip(U64, signed, got, strict=True):
        out, x = bytearray(), u
        while x >= 128:
            out.append(x & 127 | 128)
            x >>= 7
        out.append(x)
        assert (r["h"], r["n"]) == (out.hex().upper(), len(out)) and tuple(r["r"]) == (s, len(out)) and r["f"] == s and r["f32"] == u & 0xFFFFFFFF
        assert bytes(r["l"]["value"]) == bytes(r["v"])
    bad = spark.createDataFrame([(bytearray(x),) for x in (b"\x80", b"\x80\x00", b"\x80" * 6 + b"\x01", b"", b"\x05ab")], "b binary")
    got = bad.select(coding.read_varint(F.col("b"), bits=32).alias("r"), coding.read_length_prefixed(F.col("b")).alias("l")).collect()
    assert [tuple(r["r"]) for r in got] == [(None, None), (0, 2), (None, None), (None, None), (5, 1)] and got[4]["l"]["value"] is None
    assert coding.crc32c_of(b"123456789") == 0xE3069283


def test_log_framing(spark):
    rng = random.Random(2)
    records = [b"", b"x" * 5, rng.randbytes(70_000), rng.randbytes(wal.BLOCK - 2 * wal.HEADER - 3), b"tail", b""]
    data = wal.frame(records)
    assert list(wal.unframe(data)) == records
    bad, seen = bytearray(data), []
    bad[8] ^= 1
    assert len(list(wal.unframe(bytes(bad), lambda at, why: seen.append(why)))) < len(records) and "checksum" in seen
    assert list(wal.unframe(data[:-3])) == records[:-1] or list(wal.unframe(data[:-3])) == records[:-2]
    d = spark.createDataFrame([("f", bytearray(data))], "path string, content binary")
    assert [bytes(r["record"]) for r in wal.read_logs(d).orderBy("ordinal").collect()] == records


def test_file_names(spark):
    names = {"000012.wal": ("wal", 12), "7.sst": ("sst", 7), "1.dbtmp": ("temp", 1), "MANIFEST-000003": ("manifest", 3), "CURRENT": ("current", 0), "LOCK": ("lock", 0), "LOG": ("log", 0), "x.sst": None, "CURRENT.dbtmp": None}
    assert {n: kind_of(n) for n in names} == names
    got = parse_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert {r["name"]: (r["kind"], r["number"]) if r["kind"] else None for r in got} == names


def test_file_names_keep_all_digits(spark, tmp_path):
    seqs = [n for start in (0, 999_992, 1_000_000, 2**63 - 8) for n in range(start, start + 8)]
    spark.createDataFrame([(n, 1, "view", "x") for n in seqs], "event_id long, user_id long, event_type string, props string").write.parquet(str(tmp_path / "events.parquet"))
    kinds = ["wal", "sst", "temp", "none", "manifest", "current", "lock", "log"]
    names = ["{:06d}.wal", "{:06d}.sst", "{:06d}.dbtmp", "{:06d}.txt", "MANIFEST-{:06d}", "CURRENT", "LOCK", "LOG"]
    got = store_queries.file_names(spark, str(tmp_path)).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [(n, names[n % 8].format(n), kinds[n % 8], -1 if n % 8 == 3 else 0 if n % 8 > 4 else n) for n in seqs]


def test_vacuum_waits_from_the_removal(spark, tmp_path):
    """A run that was written long ago and compacted just now stays for its grace under readers of the older manifest."""
    path = f"file://{tmp_path}/db"
    with S.Store(spark, path, S.Options(grace_ms=60_000)) as db:
        db.put("a", "1")
        db.put("b", "2")
        reader = S.Store(spark, path, S.Options(read_only=True))
        db.compact_range()
        now = max(db.manifest.removed.values())
        for n in (tmp_path / "db" / "runs").iterdir():
            os.utime(n, (0, 0))  # written in 1970
        assert [x for x in db.vacuum(now + 59_000) if x.startswith("runs")] == [] and reader.get("a") == b"1"
        assert sum(x.startswith("runs") for x in db.vacuum(now + 61_000)) == 2
        assert db.get("a") == b"1" and not any(x.startswith("runs") for x in db.manifest.removed)


def test_repair_takes_the_newest_manifest(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    lost = spark.createDataFrame([(bytearray(b"k"), 99, True, bytearray(b"never committed"))], S.LOG_SCHEMA)
    with S.Store(spark, path) as db:
        db.put("k", "old")
        db.put("k", "new")
        db.compact_range()
        db.delete("gone")
        db._write_run(db._next(), lost, 0)
        seq, name = db.manifest.last_seq, f"{db.manifest.number:06d}.json"
    (tmp_path / "db" / "CURRENT").write_text("no such manifest")
    with S.repair(spark, path) as db:
        assert db.repaired_from == name and db.get("k") == b"new" and db.manifest.last_seq == seq and len(db.manifest.runs) == 2
        assert db.put("x", "1") == seq + 1
    for n in (tmp_path / "db" / "manifest").glob("*.json"):
        n.write_text("{")
    (tmp_path / "db" / "CURRENT").unlink()
    with S.repair(spark, path) as db:  # the last resort
        assert db.repaired_from is None and db.manifest.last_seq == 99


def test_open_checks_the_comparator(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    S.Store(spark, path).close()
    with pytest.raises(S.InvalidArgument):
        S.Store(spark, path, S.Options(comparator="reverse"))
    S.Store(spark, path).close()  # the failed one left no lock


def test_ordinals_are_checked(spark, tmp_path):
    with S.Store(spark, f"file://{tmp_path}/db") as db:
        for bad in ([0, 0], [0, 2], [1, 2], [0, 3, 3, 3], [-1, 0]):
            with pytest.raises(S.InvalidArgument):
                db.write_frame(spark.createDataFrame([(i, "k", True, "v") for i in bad], "ordinal long, key string, is_put boolean, value string"))
        assert db.manifest.last_seq == 0 and db.log().count() == 0
        assert db.write_frame(spark.createDataFrame([(1, "b", True, "v"), (0, "a", True, "v")], "ordinal long, key string, is_put boolean, value string")) == 2


def test_deep_levels_are_compacted_in_turn(spark, tmp_path):
    with S.Store(spark, f"file://{tmp_path}/db") as db:
        for k in "cab":
            db.put(k, k)
            db.compact_level(0)
        assert [r["level"] for r in db.manifest.runs] == [1, 1, 1]
        seen = []
        for _ in range(3):
            db.compact_level(1)
            seen.append(db.manifest.pointers["1"])
        assert seen == ["61", "62", "63"] and {r["level"] for r in db.manifest.runs} == {2}
        assert [(k, v) for k, v in state(db)] == [(b"a", b"a"), (b"b", b"b"), (b"c", b"c")]


def test_ranges_that_hold_a_key(spark):
    ranges = [("10", "20"), ("15", "30"), ("40", "40"), ("61", "6162"), ("80", "FF")]
    keys = [b"", b"\x10", b"\x2f", b"\x30", b"\x30\x00", b"\x3f", b"\x40", b"\x40\x00", b"a", b"ab", b"abc", b"\x7f", b"\x80", b"\xff", b"\xff\x00"]
    got = [r[0] for r in spark.createDataFrame([(bytearray(k),) for k in keys], "key binary").select(S._covered("key", ranges)).collect()]
    assert got == [any(bytes.fromhex(a) <= k <= bytes.fromhex(b) for a, b in ranges) for k in keys]


def test_checksums_of_all_lengths():
    def slow(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    rng = random.Random(4)
    values = [rng.randbytes(n) for n in (0, 1, 9, 1023, 1024, 1025, 5000, 0, 3 * 1024, 2)]
    assert coding.crc32c_many(values).tolist() == [slow(v) for v in values] and coding.crc32c_many([]).tolist() == []
    assert coding.crc32c_of(b"123456789") == 0xE3069283
