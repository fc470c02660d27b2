"""Byte encodings as column expressions: fixed width, varint, length prefix, shared prefix, CRC32C, internal keys.

Unsigned 64-bit values are the bit patterns of BIGINT columns. Readers return a struct (value, next): next is the position
after what was read, or null (and value null) where the bytes are cut short or too long; the position never moves on an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _reversed_bytes(h: Column) -> Column:
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(h, F.lit("(..)"), F.lit(1))), ""))


def fixed32(x: Column) -> Column:
    """Four bytes, low byte first."""
    return _reversed_bytes(F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))


def fixed64(x: Column) -> Column:
    return _reversed_bytes(F.lpad(F.hex(x.cast("bigint")), 16, "0"))


def read_fixed32(b: Column, at: int = 0) -> Column:
    return F.when(F.octet_length(b) >= at + 4, F.conv(F.hex(_reversed_bytes(F.hex(F.substring(b, at + 1, 4)))), 16, 10).cast("bigint"))


def read_fixed64(b: Column, at: int = 0) -> Column:
    return F.when(F.octet_length(b) >= at + 8, F.conv(F.hex(_reversed_bytes(F.hex(F.substring(b, at + 1, 8)))), 16, -10).cast("bigint"))


def varint_length(x: Column) -> Column:
    return F.ceil(F.length(F.bin(x.cast("bigint"))) / 7).cast("int")


def varint(x: Column) -> Column:
    """Seven bits a byte, low group first, the high bit set on all bytes but the last."""
    x = x.cast("bigint")
    n = varint_length(x)

    def byte(i: Column) -> Column:
        group = F.call_function("shiftrightunsigned", x, (i * 7).cast("int")).bitwiseAND(F.lit(127))
        return F.lpad(F.hex(group + F.when(i < n - 1, 128).otherwise(0)), 2, "0")

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), byte), ""))


def read_varint(b: Column, at: Column | int = 0, bits: int = 64) -> Column:
    """struct(value, next). At most 5 (bits=32) or 10 bytes; encodings that aren't the shortest are read, bits over the width are dropped."""
    at = F.lit(at) if isinstance(at, int) else at
    most = 5 if bits == 32 else 10
    codes = F.transform(F.regexp_extract_all(F.hex(F.substring(b, at + 1, F.lit(most))), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("bigint"))
    ends = F.array_position(F.transform(codes, lambda c: c < 128), True)
    used = F.slice(codes, F.lit(1), ends.cast("int"))
    value = F.aggregate(
        F.transform(used, lambda c, i: F.call_function("shiftleft", c.bitwiseAND(F.lit(127)), (i * 7).cast("int"))), F.lit(0).cast("bigint"), lambda a, g: a.bitwiseOR(g)
    )
    if bits == 32:
        value = value.bitwiseAND(F.lit(0xFFFFFFFF))
    ok = ends > 0
    return F.struct(F.when(ok, value).alias("value"), F.when(ok, (at + ends).cast("int")).alias("next"))


def length_prefixed(b: Column) -> Column:
    return F.concat(varint(F.octet_length(b)), b)


def read_length_prefixed(b: Column, at: Column | int = 0) -> Column:
    """struct(value, next) of length-prefixed bytes; both null if the body is short."""
    head = read_varint(b, at, 32)
    end = head["next"] + head["value"]
    ok = end <= F.octet_length(b)
    return F.struct(F.when(ok, F.substring(b, head["next"] + 1, head["value"].cast("int"))).alias("value"), F.when(ok, end.cast("int")).alias("next"))


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix; 0 where either is null."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.coalesce(F.array_max(same), F.lit(0)).cast("int")


def internal_order(key: str = "key", seq: str = "seq") -> list[Column]:
    """Keys ascending, newest version first."""
    return [F.col(key).asc(), F.col(seq).desc()]


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0x82F63B78 if i & 1 else 0)
        out.append(i)
    return out


_TABLE = _crc_table()


_WORDS = np.array(_TABLE, np.uint32)
#: Long values are cut into stretches of this many bytes that are summed side by side.
_STRETCH = 1024


def _columns(state: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The states after each has taken its row of bytes, a column of all rows at a time."""
    for c in range(rows.shape[1]):
        state = _WORDS[(state ^ rows[:, c]) & np.uint32(255)] ^ (state >> np.uint32(8))
    return state


@cache
def _after_zeros() -> np.ndarray:
    """Four tables: what each byte of a state becomes after _STRETCH zero bytes; a state's bytes add up by xor."""
    bits = _columns(np.uint32(1) << np.arange(32, dtype=np.uint32), np.zeros((32, _STRETCH), np.uint8))
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for b in range(8):
            out[byte][np.arange(256) >> b & 1 == 1] ^= bits[8 * byte + b]
    return out


def crc32c_many(values: Sequence[bytes]) -> np.ndarray:
    """Castagnoli checksums of all values; Spark's crc32 has another polynomial.

    Table look-ups run down columns of bytes: over all values' first bytes (less than a stretch each), longest values first, and over all
    whole stretches of long values, whose states are then joined."""
    n = np.array([len(v) for v in values], np.int64)
    head = n % _STRETCH
    order = np.argsort(-head, kind="stable")
    data = np.frombuffer(b"".join(values), np.uint8)
    start = np.cumsum(n) - n
    state = np.full(len(n), 0xFFFFFFFF, np.uint32)
    sizes = head[order]
    for c in range(int(sizes[0]) if len(n) else 0):
        live = order[: np.searchsorted(-sizes, -c, "left")]
        state[live] = _WORDS[(state[live] ^ data[start[live] + c]) & np.uint32(255)] ^ (state[live] >> np.uint32(8))
    for i in np.flatnonzero(n >= _STRETCH):
        at = start[i] + head[i]
        parts = data[at : start[i] + n[i]].reshape(-1, _STRETCH)
        zero, c = _after_zeros(), int(state[i])
        for x in _columns(np.zeros(len(parts), np.uint32), parts).tolist():
            c = int(zero[0, c & 255] ^ zero[1, c >> 8 & 255] ^ zero[2, c >> 16 & 255] ^ zero[3, c >> 24]) ^ x
        state[i] = c
    return state ^ np.uint32(0xFFFFFFFF)


def crc32c_of(data: bytes) -> int:
    return int(crc32c_many([data])[0])


def crc32c(b: Column) -> Column:
    """The Castagnoli checksum of a binary column, a batch at a time; null stays null."""

    def run(x: pd.Series) -> pd.Series:
        there = x.notna().to_numpy()
        out = pd.Series(pd.array([None] * len(x), "Int64"), index=x.index)
        out[there] = crc32c_many([bytes(v) for v in x[there]]).astype(np.int64)
        return out

    return F.pandas_udf(run, "long")(b)


def murmur(b: Column) -> Column:
    """A 32-bit Murmur hash of a binary column, as Spark's own (Murmur3, seed 42)."""
    return F.hash(b)


def key_hash(value: Column) -> Column:
    """Murmur3 over 32 bits, as Spark has it (seed 42): a signed int. Nulls hash to the seed."""
    return F.hash(value)
