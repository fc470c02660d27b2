"""Log framing: records in 32 KB blocks, each fragment with checksum, length and type.

A fragment's header is four bytes of CRC32C (over type and data, low byte first), two bytes of length and one of type. A record
that doesn't fit into its block is cut; fewer than seven bytes at a block's end are zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.functions.coding import crc32c_of

#: Fixed values of the format.
BLOCK, HEADER = 32 * 1024, 7
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4


def frame(records: Iterable[bytes]) -> bytes:
    """The records as a log file's content."""
    out = bytearray()
    for record in records:
        at, first = 0, True
        while first or at < len(record):
            room = BLOCK - len(out) % BLOCK
            if room < HEADER:
                out += bytes(room)
                room = BLOCK
            part = record[at : at + room - HEADER]
            at += len(part)
            end = at == len(record)
            kind = (FULL if end else FIRST) if first else (LAST if end else MIDDLE)
            body = bytes([kind]) + part
            out += crc32c_of(body).to_bytes(4, "little") + len(part).to_bytes(2, "little") + body
            first = False
            if not record:
                break
    return bytes(out)


def unframe(data: bytes, report: Callable[[int, str], None] = lambda at, why: None) -> Iterator[bytes]:
    """The whole records of a log. What is damaged is left out and reported with its place; a cut tail ends the log quietly."""
    at, parts = 0, None
    while at + HEADER <= len(data):
        room = BLOCK - at % BLOCK
        if room < HEADER:
            at += room
            continue
        crc, n, kind = int.from_bytes(data[at : at + 4], "little"), int.from_bytes(data[at + 4 : at + 6], "little"), data[at + 6]
        if kind == 0 and n == 0 and crc == 0:  # padding
            at += room
            continue
        if HEADER + n > room:
            report(at, "bad length")
            at, parts = at + room, None
            continue
        if at + HEADER + n > len(data):
            return
        body = data[at + 6 : at + HEADER + n]
        if crc32c_of(body) != crc:
            report(at, "checksum")
            at, parts = at + room, None
            continue
        if kind in (FULL, FIRST) and parts is not None:
            report(at, "record without an end")
        if kind == FULL:
            yield body[1:]
            parts = None
        elif kind == FIRST:
            parts = [body[1:]]
        elif kind in (MIDDLE, LAST) and parts is not None:
            parts.append(body[1:])
            if kind == LAST:
                yield b"".join(parts)
                parts = None
        else:
            report(at, "fragment without a start" if kind in (MIDDLE, LAST) else "unknown type")
        at += HEADER + n


def read_logs(files: DataFrame) -> DataFrame:
    """(path, ordinal, record, error) for rows (path, content) of the binaryFile source: a task a file."""

    def run(batches):
        import pandas as pd

        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                bad: list[tuple[int, str]] = []
                rows = [(path, i, r, None) for i, r in enumerate(unframe(bytes(content), lambda at, why: bad.append((at, why))))]  # noqa: B023
                rows += [(path, None, None, f"{why} at {at}") for at, why in bad]
                yield pd.DataFrame(rows, columns=["path", "ordinal", "record", "error"]).astype({"ordinal": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, ordinal long, record binary, error string")


def write_logs(records: DataFrame, path: str, order: str, record: str) -> DataFrame:
    """(path, content): a log file's content for each value of the column `path`, its records in `order`; a task a file, so what one
    file holds has to fit into a task's memory."""
    import pandas as pd

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("o", kind="stable")
        return pd.DataFrame({"path": [key[0]], "content": [frame(bytes(r) for r in rows["r"])]})

    d = records.select(F.col(path).cast("string").alias("path"), F.col(order).alias("o"), F.col(record).cast("binary").alias("r"))
    return d.groupBy("path").applyInPandas(run, "path string, content binary")
