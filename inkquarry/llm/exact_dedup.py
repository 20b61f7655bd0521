"""Exact deduplication against a minimal perfect hash over historical distinct digests.

History is a set of distinct SHA-256 digests, each with the locator of its winning row and the size of its group. It is cut into
shards by digest; every shard has a minimal perfect hash (levels of bitmaps, Limasset et al. 2017) that sends its n digests to n slots,
and each slot holds the full digest, the locator and the size. A lookup computes one slot and compares all 32 bytes, so a digest that
isn't in the history is always found out; such nonmembers are grouped among themselves.

Null and empty texts are equal; texts of any length are hashed whole. Rows that repeat both doc_id and text are one document and get the same answer (unique_documents() keeps one of
them). A null doc_id never wins against another; further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkquarry.llm.common import HOT_SHARE, mix64, staged, text_of, unused

#: Digests of one shard of the index, and rows of one lookup, on average.
SHARD_KEYS, SHARD_ROWS, LEVELS = 20_000, 100_000, 40


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the whole text."""
    return docs.select("doc_id", F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("digest"))


def groups(rows: DataFrame) -> DataFrame:
    """One row per distinct digest: the winner is the largest doc_id. Partial aggregation shrinks hot groups before the shuffle."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def _words(digest: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(digest), dtype=">u8").reshape(len(digest), 4).astype(np.uint64)


def _spot(words: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix64(words[:, level % 4] + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))) % np.uint64(size)


def build_levels(words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The bitmaps of a minimal perfect hash over distinct digests, and the slot of each digest.

    On every level, digests that are alone at their bit are placed; the others try the next level. A digest's slot is the number of bits set before its own."""
    left, levels, slots, base = np.arange(len(words)), [], np.zeros(len(words), dtype=np.int64), 0
    while len(left):
        if len(levels) >= LEVELS:
            raise ValueError("digests repeat: history must be distinct")
        size = max(64, 2 * len(left))
        spot = _spot(words[left], len(levels), size).astype(np.int64)
        alone = np.bincount(spot, minlength=size) == 1
        rank, placed = np.cumsum(alone) - 1, alone[spot]
        slots[left[placed]] = base + rank[spot[placed]]
        base += int(alone.sum())
        levels.append(alone)
        left = left[~placed]
    return levels, slots


def slots_of(levels: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """The only slot that each digest can be in, or -1."""
    slots, left, base = np.full(len(words), -1, dtype=np.int64), np.arange(len(words)), 0
    for k, bits in enumerate(levels):
        spot = _spot(words[left], k, len(bits)).astype(np.int64)
        hit, rank = bits[spot], np.cumsum(bits) - 1
        slots[left[hit]] = base + rank[spot[hit]]
        base += int(bits.sum())
        left = left[~hit]
    return slots


def _shard(n: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int").alias("shard")


def build_history(winners: DataFrame, shards: int) -> DataFrame:
    """The index of (digest, keep_id, group_size) rows with distinct digests: a row per shard."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        levels, slots = build_levels(_words(pdf["digest"].to_numpy()))
        order = np.argsort(slots)
        return pd.DataFrame({
            "shard": [int(pdf["shard"].iat[0])],
            "sizes": [[len(x) for x in levels]],
            "bits": [[np.packbits(x).tobytes() for x in levels]],
            "digests": [b"".join(pdf["digest"].to_numpy()[order])],
            "winners": [pdf["keep_id"].to_numpy()[order].astype("<i8").tobytes()],
            "counts": [pdf["group_size"].to_numpy()[order].astype("<i8").tobytes()],
        })

    return (
        winners.select(_shard(shards), "digest", "keep_id", "group_size").groupBy("shard")
        .applyInPandas(build, "shard int, sizes array<int>, bits array<binary>, digests binary, winners binary, counts binary")
    )


def lookup(distinct: DataFrame, history: DataFrame, shards: int) -> DataFrame:
    """distinct: (digest, keep_id, group_size), one row a digest, so no shard holds a hot group. Members get the keep_id and group_size of the history's slot, nonmembers keep
    their own; `member` tells which, and `times` is the own group_size."""

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"digest": left["digest"], "keep_id": left["keep_id"].astype("Int64"), "group_size": left["group_size"], "times": left["group_size"].copy(), "member": False})
        if len(right) and len(left):
            index = right.iloc[0]
            levels = [np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n).astype(bool) for n, b in zip(index["sizes"], index["bits"], strict=True)]
            words = _words(left["digest"].to_numpy())
            slots, held = slots_of(levels, words), np.frombuffer(index["digests"], dtype=">u8").reshape(-1, 4)
            same = (slots >= 0) & (held[np.maximum(slots, 0)] == words).all(axis=1)
            out.loc[same, "keep_id"] = np.frombuffer(index["winners"], dtype="<i8")[slots[same]]
            out.loc[same, "group_size"] = np.frombuffer(index["counts"], dtype="<i8")[slots[same]]
            out["member"] = same
        return out

    return (
        distinct.select("digest", "keep_id", "group_size", _shard(shards)).groupBy("shard").cogroup(history.groupBy("shard"))
        .applyInPandas(find, "digest binary, keep_id long, group_size long, times long, member boolean")
    )


def decide(rows: DataFrame, own: DataFrame, winners: DataFrame) -> DataFrame:
    """(doc_id, digest, keep_id, group_size) of every (doc_id, digest) row, given its groups() and the historical winners.

    Every distinct digest goes through the index once. The answers then go back to the rows: those of digests with at least 1/HOT_SHARE of the rows by a broadcast (HOT_SHARE
    rows at most, by counting), the others by a join in which no key is hot."""
    n, kept = rows.count(), winners.count()
    shards = max(1, own.count() // SHARD_ROWS, kept // SHARD_KEYS)
    found = lookup(own, build_history(winners, shards), shards)
    answers = staged(found.select("digest", F.struct("keep_id", "group_size").alias("answer"), (F.col("times") * HOT_SHARE >= F.lit(n)).alias("hot")), "answers")
    there = rows.join(F.broadcast(answers.where("hot").select("digest", "answer")), "digest", "left")
    cold = there.where("answer is null").select("doc_id", "digest").join(answers.where("not hot").select("digest", "answer"), "digest")
    return there.where("answer is not null").select("doc_id", "digest", "answer.*").unionByName(cold.select("doc_id", "digest", "answer.*"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, digest, keep_id, group_size of every document: the digests that repeat are the history, all others are its nonmembers."""
    rows = staged(digests(docs), "digests")
    own = staged(groups(rows), "groups")
    return decide(rows, own, own.where("group_size > 1 and keep_id is not null"))


def against_history(batch: DataFrame, history: DataFrame) -> DataFrame:
    """The decisions on a new batch, where `history` are earlier documents: a repeat of one of them goes, whatever its doc_id."""
    rows = staged(digests(batch), "digests")
    return decide(rows, staged(groups(rows), "groups"), staged(groups(digests(history)).where("keep_id is not null"), "winners"))


def unique_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns, one row each."""
    mine, key, held = unused(docs, 3)
    kept = exact_groups(docs).where("doc_id <=> keep_id").select(F.col("doc_id").alias(key), F.col("digest").alias(held)).distinct()
    sha = F.unhex(F.sha2(text_of().cast("binary"), 256))
    joined = docs.withColumn(mine, sha).join(kept, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(mine) == F.col(held)))
    return joined.dropDuplicates([key, held]).select(*docs.columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
