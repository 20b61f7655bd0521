"""Approximate nearest neighbours by a permutation index.

A vector is represented by its NEAREST pivots in order of nearness. Shards of the index post these permutations in one inverted file per pivot; a query walks the files of
its own pivots, adds up Spearman's footrule (a pivot missing from a list has the rank after its end), keeps the best SHARE of a shard and reranks
those by exact cosine in double precision. Pivots come from a sample of PIVOTS distinct vectors (the first by hash), and every distinct vector is indexed.

Equal vectors are collapsed first (the k + 1 smallest ids of each are enough for any answer of k, as ties go to the smaller id), so a very common vector is one
entry. The query set is stated: it meets all shards block by block, as vectors without clusters share their few nearest pivots with too few of their neighbours to be routed by those
(README). Vectors that are null, zero or hold null or non-finite components, those whose length is not the table's most frequent one, and rows without vec_id take no part. Rows that
repeat a vec_id are one row, with the least of their vectors, so an id is found once. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkquarry.llm.common import staged

PIVOTS, NEAREST, SHARE, LEAST_KEPT = 256, 64, 0.15, 128
SHARD_VECTORS, BLOCK_QUERIES = 8192, 1024


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of doubles) of the rows that take part, one row a vec_id."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(finite & F.exists("v", lambda x: x != 0))
    size = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return v.where(F.size("v") == (size["n"] if size else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def permutations(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Each row's nearest pivots, nearest first, ties to the smaller pivot."""
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :NEAREST].astype(np.int16)


def footrule(perm: np.ndarray, starts: np.ndarray, rows: np.ndarray, ranks: np.ndarray, n: int) -> np.ndarray:
    """Footrule distance of a query's permutation to the n posted ones (less a constant), from the inverted files of its pivots."""
    total, last = np.zeros(n, dtype=np.int32), len(perm)
    for rank, pivot in enumerate(perm.tolist()):
        lo, hi = starts[pivot], starts[pivot + 1]
        there = ranks[lo:hi]
        total[rows[lo:hi]] += np.abs(there - rank) - (last - there) - (last - rank)
    return total


def _matrix(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, dtype="<f8").reshape(-1, dim)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query row."""
    valid = staged(usable(vectors), "vectors")
    first = Window.partitionBy("v").orderBy("vec_id")
    low = valid.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    distinct = staged(low.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct")
    n = distinct.count()
    pivots = np.array([r["v"] for r in distinct.orderBy(F.xxhash64("v"), F.col("ids")[0]).limit(PIVOTS).collect()], dtype=np.float64)
    pivots = pivots / np.linalg.norm(pivots, axis=1, keepdims=True) if n else np.zeros((1, 1))
    dim, shards = pivots.shape[1], max(1, -(-n // SHARD_VECTORS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy()).astype("<f8")
        perm = permutations(x / np.linalg.norm(x, axis=1, keepdims=True), pivots)
        flat = perm.ravel()
        order = np.argsort(flat, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(pivots)))])
        return pd.DataFrame({
            "shard": [int(pdf["shard"].iat[0])], "vectors": [x.tobytes()], "ids": [pdf["ids"].map(list).tolist()], "starts": [starts.astype("<i4").tobytes()],
            "rows": [(order // perm.shape[1]).astype("<i4").tobytes()], "ranks": [(order % perm.shape[1]).astype("<i2").tobytes()],
        })

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [int(pdf["block"].iat[0])], "keys": [pdf["key"].astype("<i8").to_numpy().tobytes()], "queries": [np.stack(pdf["v"].to_numpy()).astype("<f8").tobytes()]})

    index = staged(
        distinct.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).groupBy("shard")
        .applyInPandas(build, "shard int, vectors binary, ids array<array<long>>, starts binary, rows binary, ranks binary"), "index"
    )
    keyed = valid.where(is_query).join(distinct.select("v", F.col("ids")[0].alias("key")), "v").select(F.col("vec_id").alias("query_id"), "key", "v")
    keyed = staged(keyed, "queries")
    asked = keyed.groupBy("key").agg(F.first("v").alias("v"))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    packed = asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(gather, "block int, keys binary, queries binary")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(left) and len(right):
            shard, x = left.iloc[0], _matrix(left["vectors"].iat[0], dim)
            starts, rows, ranks = np.frombuffer(shard["starts"], "<i4"), np.frombuffer(shard["rows"], "<i4"), np.frombuffer(shard["ranks"], "<i2").astype(np.int32)
            keys, q = np.frombuffer(right["keys"].iat[0], "<i8").tolist(), _matrix(right["queries"].iat[0], dim)
            norms, lengths = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
            kept = min(len(x), max(LEAST_KEPT, int(np.ceil(share * len(x)))))
            for key, vec, length, perm in zip(keys, q, lengths, permutations(q / lengths[:, None], pivots), strict=True):
                near = np.argpartition(footrule(perm, starts, rows, ranks, len(x)), kept - 1)[:kept]
                score = np.clip((x[near] * vec).sum(axis=1) / (norms[near] * length), -1.0, 1.0)
                # all at or above the (k + 1)th score, so that ties can go to the smaller id
                edge = np.partition(score, len(score) - min(len(score), k + 1))[len(score) - min(len(score), k + 1)]
                best = [(-s, i) for s, row in zip(score[score >= edge].tolist(), near[score >= edge].tolist(), strict=True) for i in shard["ids"][row]]
                out += [(key, int(i), -s) for s, i in sorted(best)[: k + 1]]
        return pd.DataFrame(out, columns=["key", "vec_id", "score"])

    units = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = units[0].groupBy("shard", "block").cogroup(units[1].groupBy("shard", "block")).applyInPandas(search, "key long, vec_id long, score double")
    near = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= k + 1).select("key", "vec_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answers = keyed.select("query_id", "key").join(top, "key").where("query_id <> vec_id").withColumn("rank", F.row_number().over(order))
    return answers.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
