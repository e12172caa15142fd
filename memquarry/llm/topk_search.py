"""Exact top-k inner-product search by tiled matrix products.

Queries are dealt into blocks and candidates into shards; one tile is one block
against one shard. A tile is one matrix product, from which a partial selection
keeps k rows a query; the lists are merged in a tree of fan-in FAN_IN.

Cases: vectors that are null or hold null or non-finite components take no part;
only vectors of equal length are compared; a query never meets rows of its own
id; repeated query ids are one query (the least vector); repeated candidate rows
each count; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLOCK, SHARD, FAN_IN = 1024, 4096, 16


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): v holds floor(scale * x) for the rows that take part."""
    v = F.col(vector_col)
    good = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _best(query, vec, score, k: int):
    """Order of the k best of each query: score descending, then id ascending."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return order[rank < k], rank[rank < k]


def _matrix(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (row numbers, integer matrix)."""
    column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    return {int(n): (at := np.flatnonzero(sizes == n), values[(ends[at] - n)[:, None] + np.arange(n)].astype(np.int64)) for n in np.unique(sizes)}


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in integers: by floats where every partial sum is exact."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if largest < 2**53 else a @ b.T


def tile(k: int):
    def run(key, queries, shard):
        out = [(np.zeros(0, np.int64),) * 3]
        if queries.num_rows and shard.num_rows:
            qid, cid = queries["id"].to_numpy(), shard["cid"].to_numpy()
            left, right = _matrix(queries["v"]), _matrix(shard["cv"])
            for n in left.keys() & right.keys():
                (qa, q), (ca, c) = left[n], right[n]
                s = product(q, c)
                own = qid[qa][:, None] == cid[ca][None, :]
                s[own] = np.iinfo(np.int64).min
                cut = np.partition(s, len(ca) - k, axis=1)[:, len(ca) - k] if len(ca) > k else np.full(len(qa), np.iinfo(np.int64).min)
                i, j = np.nonzero((s >= cut[:, None]) & ~own)
                query, vec, score = qid[qa][i], cid[ca][j], s[i, j]
                keep, _ = _best(query, vec, score, k)
                out.append((query[keep], vec[keep], score[keep]))
        query, vec, score = (np.concatenate(x) for x in zip(*out))
        return pa.table({"block": pa.array(np.full(len(query), key[0].as_py()), pa.int64()), "node": pa.array(np.full(len(query), key[1].as_py()), pa.int64()), "query_id": query, "vec_id": vec, "score": score})

    return run


def merge(k: int):
    def run(key, rows):
        query, vec, score = (rows[c].to_numpy() for c in ("query_id", "vec_id", "score"))
        keep, rank = _best(query, vec, score, k)
        return pa.table({"block": rows["block"].take(pa.array(keep)), "node": rows["node"].take(pa.array(keep)), "query_id": query[keep], "vec_id": vec[keep], "score": score[keep], "rank": pa.array(rank + 1, pa.int32())})

    return run


def topk(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """queries, candidates: (id long, v array<long>) -> (query_id, rank, vec_id, score)."""
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    blocks, shards = max(1, math.ceil(queries.count() / BLOCK)), max(1, math.ceil(candidates.count() / SHARD))
    q = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    c = candidates.withColumn("node", F.pmod(F.xxhash64("id", "v"), F.lit(shards))).select(F.col("id").alias("cid"), F.col("v").alias("cv"), "node").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    part = q.groupBy("block", "node").cogroup(c.groupBy("block", "node")).applyInArrow(tile(k), "block long, node long, query_id long, vec_id long, score long")
    while True:
        part = part.withColumn("node", F.floor(F.col("node") / FAN_IN)).groupBy("block", "node").applyInArrow(merge(k), "block long, node long, query_id long, vec_id long, score long, rank int")
        shards = math.ceil(shards / FAN_IN)
        if shards <= 1:
            return part.select("query_id", "rank", "vec_id", "score")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return topk(rows.where("id % 20 = 0"), rows, 20)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
