"""Exact top-k search by inner product over norm-sorted, rotated vectors.

Components become floor(256 * x). Vectors are dealt into blocks by descending length. Each block of queries first meets the
longest vectors, which gives every query a k-th best score so far; a block of vectors is then read only
for queries whose length times the block's greatest length can still reach that score. Inside a block, vectors and
queries are rotated by the eigenvectors of the Gram matrix (the right singular vectors of the data), partial sums run
over the leading coordinates, and what is left is bounded by Cauchy-Schwarz. What passes is scored in whole numbers.

Defined cases: null vectors and those holding null, NaN or infinite components, or of another length than the most common one,
take no part; ids may repeat: every row with the query's own id is left out, and a repeated query id asks once, with the least of its vectors; fewer than k candidates give all;
no rows give no rows; other columns are ignored. A row with a null id takes no part. A component or score that a long
doesn't hold raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrata.llm.common import stored

#: Products of lengths from here on are scored in integers of any size.
WIDE = 2.0**62
OUT = "query_id long, vec_id long, score long"


def _pack(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows, np.int64).tobytes()


def _scores(v: np.ndarray, q: np.ndarray, wide: bool) -> np.ndarray:
    if not wide:
        return v @ q
    got = [sum(a * b for a, b in zip(row, q.tolist(), strict=True)) for row in v.tolist()]
    if any(abs(x) >= 1 << 63 for x in got):
        raise OverflowError("a score exceeds 64 bits")
    return np.array(got, np.int64)


def _best(q: np.ndarray, qid: np.ndarray, v: np.ndarray, vid: np.ndarray, rot: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Top k of v for every query, as far as they reach floor; v is sorted by descending length."""
    head = max(1, min(v.shape[1], v.shape[1] // 4))
    vf, qf = v @ rot, q @ rot
    vn, qn = np.sqrt((vf**2).sum(1)), np.sqrt((qf**2).sum(1))
    vr, qr = np.sqrt((vf[:, head:] ** 2).sum(1)), np.sqrt((qf[:, head:] ** 2).sum(1))
    for i in range(len(q)):
        slack = 1e-6 * (1 + qn[i] * (vn[0] if len(vn) else 0))
        low, at, ids, scores = floor[i], 0, np.empty(0, np.int64), np.empty(0, np.int64)
        while at < len(v):
            end = min(at + 1024, len(v))
            if vn[at] * qn[i] + slack < low:
                break
            part = vf[at:end, :head] @ qf[i, :head]
            live = at + np.flatnonzero(part + vr[at:end] * qr[i] + slack >= low)
            live = live[vid[live] != qid[i]]
            ids, scores = np.concatenate([ids, vid[live]]), np.concatenate([scores, _scores(v[live], q[i], vn[at] * qn[i] >= WIDE)])
            if len(ids) > k:
                top = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[top], scores[top]
            if len(ids) >= k:
                low = max(low, scores.min())
            at = end
        reach = scores >= floor[i]
        yield np.full(int(reach.sum()), qid[i]), ids[reach], scores[reach]


def top_k(df: DataFrame, key: str, vector: str, is_query: F.Column, k: int = 5, block: int = 4096, query_block: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for every row that is_query selects."""
    spark = df.sparkSession
    x = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & F.col(key).isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    d = df.where(fine).select(F.col(key).cast("long").alias("vec_id"), x.alias("v"), is_query.alias("is_query"))
    lengths = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths or lengths[0]["n"] == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = lengths[0]["n"]
    whole = lambda e: F.when(F.abs(e) >= 2.0**55, F.raise_error(F.lit("a component exceeds 64 bits"))).otherwise(F.floor(e * 256).cast("long"))
    d = d.where(F.size("v") == dim).withColumn("v", F.transform("v", whole)).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))))
    d = stored(d, "vectors")

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for b in batches:
            if len(b):
                m = np.array(b["v"].tolist(), np.float64)
                total += m.T @ m
        yield pd.DataFrame({"i": np.repeat(np.arange(dim), dim), "j": np.tile(np.arange(dim), dim), "x": total.ravel()})

    sums = d.select("v").mapInPandas(gram, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    g = np.zeros((dim, dim))
    for r in sums:
        g[r["i"], r["j"]] = r["x"]
    rot = np.ascontiguousarray(np.linalg.eigh(g + g.T)[1][:, ::-1])

    rows = d.count()
    parts = max(1, -(-rows // block))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            while sum(map(len, held)) >= block:
                whole = pd.concat(held)
                yield one(whole[:block])
                held = [whole[block:]]
        if sum(map(len, held)):
            yield one(pd.concat(held))

    def one(b: pd.DataFrame) -> pd.DataFrame:
        m = np.array(b["v"].tolist(), np.int64).reshape(len(b), dim)
        return pd.DataFrame({"top": [float(b["norm"].max())], "n": [len(b)], "ids": [_pack(b["vec_id"].to_numpy())], "vs": [_pack(m)]})

    shape = "top double, n long, ids binary, vs binary"
    vectors = d.repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id").mapInPandas(blocks, shape)
    vectors = stored(vectors.withColumn("block", F.monotonically_increasing_id()), "blocks")
    longest = vectors.orderBy(F.desc("top"), "block").select("block").first()
    if longest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    q = d.where("is_query").groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("x")).select("vec_id", "x.v", "x.norm")
    qparts = max(1, -(-q.count() // query_block))
    queries = stored(q.repartitionByRange(qparts, F.desc("norm"), "vec_id").mapInPandas(blocks, shape).withColumn("q", F.monotonically_increasing_id()), "queries")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                qid, vid = np.frombuffer(r.qids, np.int64), np.frombuffer(r.ids, np.int64)
                qs, vs = np.frombuffer(r.qs, np.int64).reshape(-1, dim), np.frombuffer(r.vs, np.int64).reshape(-1, dim)
                floor = np.full(len(qid), -np.inf) if r.floors is None else np.frombuffer(r.floors, np.float64)
                for part in range(0, len(qid), query_block):
                    s = slice(part, part + query_block)
                    got = list(_best(qs[s], qid[s], vs, vid, rot, floor[s], k))
                    yield pd.DataFrame({"query_id": np.concatenate([x[0] for x in got]), "vec_id": np.concatenate([x[1] for x in got]), "score": np.concatenate([x[2] for x in got])})

    side = queries.select("q", F.col("ids").alias("qids"), F.col("vs").alias("qs"), F.col("top").alias("q_top"))
    lead = vectors.where(F.col("block") == longest["block"]).select("block", "ids", "vs")
    cols = ["qids", "qs", "ids", "vs", "floors"]
    first = side.withColumn("block", F.lit(longest["block"])).join(lead, "block").withColumn("floors", F.lit(None).cast("binary"))
    first = stored(first.repartition(qparts, "q").select(*cols).mapInPandas(run, OUT), "first")

    # The k-th best so far per query, in the order of the query block's rows; minus infinity where fewer were found.
    low = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("low")).where(F.col("c") >= k)

    def ids_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                ids = np.frombuffer(r.qids, np.int64)
                yield pd.DataFrame({"q": np.full(len(ids), r.q), "pos": np.arange(len(ids)), "query_id": ids})

    floors = side.select("q", "qids").mapInPandas(ids_of, "q long, pos int, query_id long").join(low, "query_id", "left")
    floors = floors.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce(F.col("low").cast("double") - F.abs(F.col("low").cast("double")) * 1e-15, F.lit(float("-inf"))).alias("low")))).alias("l"))

    @F.pandas_udf("binary")
    def packed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: np.array(list(x), np.float64).tobytes())

    floors = floors.select("q", F.array_min("l.low").alias("least"), packed("l.low").alias("floors"))
    tops = vectors.where(F.col("block") != longest["block"]).select("block", "top")
    asked = side.select("q", "q_top").join(floors.select("q", "least"), "q")
    # Blocks of the stated queries by blocks of rows, on their bounds only: the pairs that can hold a result.
    pairs = asked.join(tops, F.col("q_top") * F.col("top") * F.lit(1 + 1e-9) + 1 >= F.col("least")).select("q", "block")
    rest = pairs.join(side.select("q", "qids", "qs"), "q").join(floors.select("q", "floors"), "q").join(vectors.select("block", "ids", "vs"), "block")
    rest = rest.repartition(max(1, parts), "q", "block").select(*cols).mapInPandas(run, OUT)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
