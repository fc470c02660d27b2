"""Best-fit packing of token pieces into sequences, after Martello-Toth dominance reduction.

Tokenising is spread over the rows; only the count of pieces by length (at most one number a length) comes to the driver. There,
sets of lengths that dominate every alternative are fixed for good, at once for as many sequences as the counts
allow, and best-fit decreasing packs the rest. The plan is a list of patterns of lengths with counts; each piece finds its
sequence by its rank among the pieces of its length.

Defined cases: a null or empty text is one piece of one token (the end); repeated rows are packed each; ties in rank are
settled by id, piece and checksum; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import global_rank, spread, stored
from keystrata.llm.text_hash import give_back

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


@cache
def encoder(path: str):
    """Text -> ids of the byte-level tokenizer file at path, without added special tokens.

    The file's own vocabulary is run by the faster of two engines that give the same ids; the file's own library takes
    texts that spell one of its special tokens, and files that are not plain byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = [x["content"] for x in spec.get("added_tokens", [])]

    @cache
    def own():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        return tokenizers.Tokenizer.from_file(path)

    slow = lambda t: np.array(own().encode(t, add_special_tokens=False).ids, np.uint32)
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        return slow
    import tiktoken

    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    del spec
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda t: slow(t) if any(a in t for a in added) else np.asarray(fast.encode_to_numpy(t, allowed_special=set(), disallowed_special=()), np.uint32)


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """A row a piece: longer documents are cut into whole sequences, the first piece having what is left over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
                start, size = 0, len(ids) % capacity or capacity
                for piece in range(-(-len(ids) // capacity)):
                    part = ids[start : start + size]
                    rows.append((doc, piece, start, len(part), zlib.crc32(part.tobytes())))
                    start, size = start + len(part), capacity
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})
        give_back()

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInPandas(run, SCHEMA)


def reduce_dominated(counts: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix sets that dominate all others with the same longest piece; counts keeps the rest."""
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(lengths: tuple[int, ...], n: int) -> None:
        fixed.append((lengths, n))
        for x in lengths:
            counts[x] -= n
            if not counts[x]:
                del counts[x]

    again = True
    while again:
        again = False
        for a in sorted(counts, reverse=True):
            while counts.get(a):
                room = capacity - a
                others = counts.copy()
                others[a] -= 1
                lengths = sorted(x for x, n in others.items() if n and x <= room)
                if not lengths:  # nothing fits beside it
                    fix((a,), counts[a] if a * 2 > capacity else 1)
                    again = True
                    continue
                b = lengths[-1]
                small = lengths[0]
                second = small if others[small] > 1 else (lengths[1] if len(lengths) > 1 else capacity + 1)
                alone = small + second > room  # at most one other fits: the longest that fits is best
                if not alone and b != room:
                    smallest = sorted(x for y in lengths[:3] for x in [y] * min(3, others[y]))[:3]
                    three = len(smallest) == 3 and sum(smallest) <= room
                    best = 0 if three else max((x + y for x in lengths for y in lengths if x <= y and x + y <= room and (x != y or others[x] > 1)), default=0)
                    if three or best > b:
                        break
                # b alone fills at least as much as anything else that fits, so whatever else could stand there fits into b's place
                fix((a, b), min(counts[a], counts[b]) if a != b else counts[a] // 2)
                again = True
    return fixed


def best_fit(counts: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: patterns of lengths with the number of sequences of each."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for a in sorted(counts, reverse=True):
        left = counts[a]
        while left:
            room = min((r for r in open_ if r >= a), default=None)
            pattern, bins = open_[room].pop() if room is not None else ((), left)
            if room is not None and not open_[room]:
                del open_[room]
            r = room if room is not None else capacity
            each = r // a
            whole = min(bins, left // each)
            used = whole * each
            if whole:
                open_.setdefault(r - each * a, []).append((pattern + (a,) * each, whole))
            if whole < bins and (some := min(left - used, each)):
                open_.setdefault(r - some * a, []).append((pattern + (a,) * some, 1))
                used, whole = used + some, whole + 1
            if room is not None and whole < bins:
                open_.setdefault(r, []).append((pattern, bins - whole))
            left -= used
    return [x for patterns in open_.values() for x in patterns]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    left = Counter({k: v for k, v in counts.items() if v})
    fixed = reduce_dominated(left, capacity)
    return fixed + best_fit(left, capacity)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    p = stored(pieces_of(docs, tokenizer or default_tokenizer(), capacity), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in p.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter = Counter()
    base = 0
    for pattern, n in plan(counts, capacity):
        offset = 0
        for x in pattern:
            ranges.setdefault(x, []).append((taken[x], base, offset))
            taken[x] += n
            offset += x
        base += n
    # By length: first rank, its sequence and the offset there. As many entries as patterns have pieces, whatever the rows.
    where = {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in ranges.items()}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.empty((len(length), 2), np.int64)
        n, r = length.to_numpy(), rank.to_numpy()
        for x in np.unique(n):
            at = np.flatnonzero(n == x)
            first, seq, off = where[int(x)]
            i = np.searchsorted(first, r[at], "right") - 1
            out[at, 0], out[at, 1] = seq[i] + r[at] - first[i], off[i]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(4096))
    d = global_rank(p, ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32"), F.col("start")], bucket, "rank")
    return d.withColumn("_p", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "_p.sequence_id", "_p.offset")
