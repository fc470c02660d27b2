"""python -m keystrata.cli [--db PATH]: put, get, del, scan, compact, stats, dbdir, help, quit."""

from __future__ import annotations

import argparse
import shlex
import sys

from pyspark.sql import SparkSession

from keystrata.sources.store import NotFound, Store, StoreError

HELP = """put <key> <value>    write a pair
get <key>            read a value
del <key>            delete a key
scan [begin] [end]   live pairs with begin <= key < end, in key order
compact [begin] [end]  merge the runs that meet the range
stats                runs, entries and bytes by level
dbdir                the store's folder
help                 this text
quit                 leave"""


def run(store: Store, line: str) -> str | None:
    """The answer to one command; None to leave."""
    name, *args = shlex.split(line) or [""]
    text = lambda b: b.decode("utf-8", "backslashreplace")
    try:
        match name, len(args):
            case "", 0:
                return ""
            case "put", 2:
                store.put(*args)
                return "OK"
            case "get", 1:
                return text(store.get(args[0]))
            case "del", 1:
                store.delete(args[0])
                return "OK"
            case "scan", 0 | 1 | 2:
                return "\n".join(f"{text(k)} {text(v)}" for k, v in store.iterate(*args))
            case "compact", 0 | 1 | 2:
                return "OK" if store.compact_range(*args) else "nothing to compact"
            case "stats", 0:
                return store.get_property("stats") + f"\nlast sequence {store.manifest.last_seq}, {len(store.manifest.snapshots)} snapshots"
            case "dbdir", 0:
                return store.path
            case "help", 0:
                return HELP
            case "quit", 0:
                return None
        return f"unknown command or wrong number of arguments: {line}\n{HELP}"
    except NotFound:
        return "not found"
    except StoreError as e:
        return f"error: {e}"


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--db", default="./output/store")
    path = parser.parse_args().db
    spark = SparkSession.builder.appName("keystrata").getOrCreate()
    with Store(spark, path) as store:
        for line in sys.stdin:
            if (answer := run(store, line)) is None:
                break
            print(answer, flush=True)


if __name__ == "__main__":
    main()
