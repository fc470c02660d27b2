"""Vectorised hashing of words and shingles over bytes, for whole texts of any length in bounded memory."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_T = np.random.Generator(np.random.PCG64(20240611)).integers(0, 1 << 64, 256, np.uint64)
_LOW = _T.copy()
_LOW[65:91] = _T[97:123]
_LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None
_cache: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    got = _cache.get(base)
    if got is None or len(got) < n:
        size = max(n, 2 * CHUNK + 2)
        got = np.full(size, base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if n <= 2 * CHUNK + 2:
            _cache[base] = got
    return got[:n]


def give_back() -> None:
    """Return freed memory to the system: Python workers are kept between tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def fmix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hash_bytes(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word in buf, ASCII letters lower-cased."""
    a = np.frombuffer(buf, np.uint8)
    gap = np.ones(len(a) + 2, np.int8)
    gap[1:-1] = SPACE[a]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    s, e = edge[0::2], edge[1::2]
    c = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_LOW[a] * powers(_ODD, len(a)), out=c[1:])
    return fmix((c[e] - c[s]) * powers(_INV, len(a) + 1)[s] + (e - s).astype(np.uint64)), s, e


def pieces(data: bytes) -> Iterator[bytes]:
    """data in parts of about CHUNK bytes, cut at white space only."""
    at = 0
    while len(data) - at > CHUNK:
        cut = at + CHUNK
        while cut < len(data) and not SPACE[data[cut]]:
            cut += 1
        yield data[at:cut]
        at = cut
    yield data[at:]


def word_hashes(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hashes, words per text) for runs of texts of about CHUNK bytes; null counts as empty."""
    i = 0
    while i < len(texts):
        j, parts, size = i, [], 0
        while j < len(texts) and (size < CHUNK or j == i):
            b = (texts[j] or "").encode("utf-8", "surrogatepass")
            if parts and size + len(b) > 2 * CHUNK - len(parts):
                break
            parts.append(b)
            size += len(b) + 1
            j += 1
        if len(parts) == 1:
            h = np.concatenate([hash_bytes(p)[0] for p in pieces(parts[0])])
            yield i, j, h, np.array([len(h)])
        else:
            h, s, _ = hash_bytes(b"\n".join(parts))
            bounds = np.cumsum([len(b) + 1 for b in parts])
            yield i, j, h, np.diff(np.searchsorted(s, bounds), prepend=0)
        i = j


def shingles(h: np.ndarray, w: int) -> np.ndarray:
    """Sorted distinct hashes of the w-word windows of one text; a text of fewer words counts as one window."""
    if not len(h):
        return np.empty(0, np.uint64)
    n = min(w, len(h))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        acc = acc * np.uint64(_ODD) + h[k : k + len(acc)]
    return np.unique(fmix(acc))


def run_hashes(buf: bytes, least: int, seed: np.uint64) -> np.ndarray:
    """Hashes, mixed with seed, of the runs of least words that start at each word of buf; words stand one space apart, case counts."""
    a = np.frombuffer(buf, np.uint8)
    gap = np.flatnonzero(a == 32)
    if len(gap) + 1 < least:
        return np.empty(0, np.uint64)
    s, e = np.append(0, gap + 1), np.append(gap, len(a))
    c = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_T[a] * powers(_ODD, len(a)), out=c[1:])
    h = fmix((c[e] - c[s]) * powers(_INV, len(a) + 1)[s] + (e - s).astype(np.uint64))
    acc = np.full(len(h) - least + 1, seed, np.uint64)
    for k in range(least):
        acc = acc * np.uint64(_ODD) + h[k : k + len(acc)]
    return fmix(acc)
