"""Shared pieces: staging in the cluster's shared folder, hot keys, packed arrays and connected components."""

from __future__ import annotations

import itertools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups with at least 1/HOT_SHARE of all rows are hot. By counting, there are never more than HOT_SHARE of them,
#: which is the proven bound of every broadcast of hot keys.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a temporary one on a local master; on a cluster that is an error, as other machines would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-inkquarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder; all tables of one application lie below one folder."""
    return f"{shared_dir(spark)}/inkquarry-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back. Lost executors lose none of it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Deletes every table that staged() of this application has written; call it when their results are written."""
    jvm, path = spark._jvm, f"{shared_dir(spark)}/inkquarry-{spark.sparkContext.applicationId}"
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def unused(df: DataFrame, n: int) -> list[str]:
    """n column names that df doesn't have, whatever its user has called the columns."""
    taken, names = {c.lower() for c in df.columns}, (f"_own{k}" for k in itertools.count())
    return list(itertools.islice((x for x in names if x not in taken), n))


def packed(column, dtype) -> np.ndarray:
    return np.frombuffer(column, dtype=dtype)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Cached(dict):
    """key -> make(key); forgets everything beyond a bound, so memory stays bounded."""

    def __init__(self, make, bound: int = 300_000):
        super().__init__()
        self.make, self.bound = make, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        value = self[key] = self.make(key)
        return value


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str) -> DataFrame:
    """rows (any number a key) with the columns of per_key (one row a key, just aggregated by it); key is a long.

    An aggregate is partitioned by its key already, and adaptive skew join only splits what comes straight from a shuffle. The complement of the key
    is another expression, so both sides are shuffled for the join, and the rows of a hot key are split over tasks."""
    other = per_key.withColumn("_key", F.bitwise_not(F.col(key))).drop(key)
    return rows.withColumn("_key", F.bitwise_not(F.col(key))).join(other, "_key").drop("_key")


def are_stars(e: DataFrame) -> bool:
    """Whether distinct edges (u, v), u > v, tie each u to one v that is no u itself: then v is the smallest node of its component."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    roles = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.agg(F.count_if(F.col("up") + F.col("down") > 1)).first()[0] == 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge; component is the smallest node that can be reached.

    Alternating large-star and small-star steps (Kiveris et al., 2014) in joins and partial aggregates: a node with very many
    neighbours is never collected, adaptive skew join splits its rows. Each round is staged in the shared folder. Its joins go by shuffle always: as many small broadcasts as there are
    rounds leave the driver with their threads and buffers. Edges that are stars already, as those of one forest are, take no round: what a round's tasks and plans leave in the driver adds up.
    """
    e = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while not are_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_per_key(both, low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = join_per_key(large, low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(down.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def pointer_roots(pointers: DataFrame) -> DataFrame:
    """(node, component) of every b of pointers (a, b), a < b, where each b has one a only: the root of its tree, which is its smallest node and itself no b.

    Each join takes all nodes to their pointer's own pointer, which halves all depths for a quarter of the shuffles of a round of connected_components."""
    e = staged(pointers.select(F.col("b").alias("u"), F.col("a").alias("v")), "pointers")
    while not are_stars(e):
        above = e.select(F.col("u").alias("v"), F.col("v").alias("top"))
        e = staged(e.join(above.hint("merge"), "v", "left").select("u", F.coalesce("top", "v").alias("v")), "pointers")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


class Forest:
    """Union-find over 0..n-1 inside one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def batched(batches, most_words: int):
    """(ids, texts as lists of words) of parts of Arrow batches of (doc_id, text as binary) of some `most_words` words; a longer text is a part of its own.

    Words are what lies between space, tab, line feed, vertical tab, form feed and carriage return, which is how bytes.split() cuts."""
    for batch in batches:
        ids, texts, n = [], [], 0
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = text.split()
                if ids and n + len(words) > most_words:
                    yield ids, texts
                    ids, texts, n = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                n += len(words)
        if ids:
            yield ids, texts


def codes_of(words: list[bytes]) -> np.ndarray:
    """A number for each word; equal words have equal numbers."""
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
