"""Near-duplicate detection by MinHash bands and odd sketches.

1. One pass over the texts gives each document's set of word shingles (as 64-bit hashes), the digest of the set, BANDS keys of ROWS MinHash values each, and an
   odd sketch: every one of the BANDS * ROWS samples flips one of BITS bits, so the population count of the XOR of two sketches tells how many samples
   differ. Documents with the same set are collapsed to the smallest doc_id before anything is compared.
2. Documents that share a band key meet in a bucket. Inside a bucket, pairs whose sketches are compatible with the threshold (MARGIN below it) tie documents together; only a
   spanning forest of a bucket leaves the task. A large bucket is dealt in blocks, and each of its documents is tied to its smallest one without any
   test, which can only make groups larger. Connected components of those ties are candidate groups: each linked pair that met in a bucket is inside one.
3. Every group's links are confirmed on the full sets (exact intersections in one matrix product), group by group where a group has at most BLOCK documents, and
   beyond in rounds of blocks, then across what is still apart. Again only spanning forests of confirmed links leave the tasks; their components are the result.

A pair at the threshold 0.8 is missed with probability (1 - 0.8^ROWS)^BANDS < 1e-7; there is no cap on partners. No pair is ever a row but those of spanning forests.
Null texts and texts without words have an empty set and are linked with nothing. Rows that repeat a doc_id are one document with one of their sets
(the least by digest) and one component; each row has its own n_shingles. Rows without doc_id are left out of links (component null). Further columns are ignored. Very long texts are read whole, and their sets compared whole. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkquarry.llm.common import Forest, connected_components, join_per_key, mix64, pointer_roots, staged, text_of, unused

ROWS, BANDS, BITS, MARGIN, BLOCK = 6, 54, 1024, 0.12, 512
#: Shingles that one pass of a sample covers, of as many documents as they belong to: 256 KB an array.
TOGETHER = 65_536
ODD = tuple(np.uint64(x | 1) for x in np.random.default_rng(11).integers(1, 2**62, size=8, dtype=np.int64).tolist())


def distinct(x: np.ndarray) -> np.ndarray:
    """np.unique by sorting, which for 64-bit integers takes a fraction of the time of its hash table."""
    x = np.sort(x)
    first = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def shingles(text: str, words: int) -> np.ndarray:
    """The distinct hashed shingles, sorted. bytes.lower() and bytes.split() know A-Z and the white space of ASCII only, as wanted. Words are hashed anew each time: that takes
    less than looking them up."""
    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=len(parts))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        out = mix64(out + h[k : len(h) - n + 1 + k] * ODD[k % 8])
    return distinct(out)


def set_digest(found: bytes) -> bytes:
    return hashlib.blake2b(found, digest_size=16).digest()


def samplers(rows: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 2**32, size=(rows * bands, 1), dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, size=(rows * bands, 1), dtype=np.uint32)


def minhashes(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A row of 32-bit minima for each set, one a sample; no set is empty. A pass covers TOGETHER shingles, of many small sets or of a part of a large one."""
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    ends = np.cumsum([len(x) for x in sets])
    starts = np.concatenate([[0], ends[:-1]])
    out = np.full((len(a), len(sets)), 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(low), TOGETHER):
        x = low[lo : lo + TOGETHER]
        y, high = np.empty_like(x), np.empty_like(x)
        i, j = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, lo + len(x))
        at = np.maximum(starts[i:j] - lo, 0)
        for k, (times, plus) in enumerate(zip(a[:, 0], b[:, 0], strict=True)):
            np.multiply(x, times, out=y)
            y += plus
            np.right_shift(y, np.uint32(15), out=high)
            y ^= high
            np.minimum(out[k, i:j], np.minimum.reduceat(y, at), out=out[k, i:j])
    return np.ascontiguousarray(out.T)


def minhash(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 32-bit minimum per sample."""
    return minhashes([found], a, b)[0]


def band_keys(samples: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A row of keys, one a band, for each row of samples."""
    band = samples.reshape(len(samples), bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        key = mix64(key + band[:, :, k] * ODD[k % 8])
    return key.view(np.int64)


def odd_sketches(samples: np.ndarray, bits: int = BITS) -> list[bytes]:
    """A parity bitmap for each row of samples: each (sample number, value) flips one bit."""
    place = mix64((np.arange(samples.shape[1], dtype=np.uint64) << np.uint64(32)) | samples.astype(np.uint64)) % np.uint64(bits)
    place = place.astype(np.int64) + np.arange(len(samples))[:, None] * bits
    odd = np.bincount(place.ravel(), minlength=len(samples) * bits).reshape(-1, bits) & 1
    return [x.tobytes() for x in np.packbits(odd.astype(np.uint8), axis=1)]


def odd_sketch(samples: np.ndarray, bits: int = BITS) -> bytes:
    return odd_sketches(samples[None], bits)[0]


def estimate(differing_bits: np.ndarray, samples: int, bits: int = BITS) -> np.ndarray:
    """Similarity from the population count of the XOR of two odd sketches."""
    full = np.clip(1 - 2 * differing_bits / bits, 1e-9, 1.0)
    return 1 + bits / (4 * samples) * np.log(full)


SKETCHED = "doc_id long, n_shingles long, digest binary, keys array<long>, sketch binary"


def sketch_documents(docs: DataFrame, words: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = samplers(rows, bands)

        def rows_of(ids: list[int | None], sets: list[np.ndarray]) -> pa.RecordBatch:
            full = [k for k, found in enumerate(sets) if len(found)]
            digests, keys, sketches = ([None] * len(sets) for _ in range(3))
            if full:
                samples = minhashes([sets[k] for k in full], a, b)
                for k, key, sketch in zip(full, band_keys(samples, rows, bands), odd_sketches(samples), strict=True):
                    digests[k], keys[k], sketches[k] = set_digest(sets[k].tobytes()), key, sketch
            n = [len(found) for found in sets]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "digest", "keys", "sketch"])

        for batch in batches:
            ids, sets, held = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc_id.as_py())
                sets.append(shingles(text.as_py(), words))
                held += len(sets[-1])
                # the sets of few documents at once, or one long one
                if held >= TOGETHER or len(sets) == 500:
                    yield rows_of(ids, sets)
                    ids, sets, held = [], [], 0
            if sets:
                yield rows_of(ids, sets)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, SKETCHED)


def compatible(sketches: np.ndarray, threshold: float, samples: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of packed sketches, the later rows whose similarity may reach the threshold."""
    most = int(BITS / 2 * (1 - np.exp(-4 * samples * (1 - threshold) / BITS)))
    wide = sketches.view(np.uint64)
    for i in range(len(wide) - 1):
        yield i, i + 1 + np.flatnonzero(np.bitwise_count(wide[i + 1 :] ^ wide[i]).sum(axis=1) <= most)


def bucket_ties(found: DataFrame, reps: DataFrame, threshold: float, samples: int) -> DataFrame:
    """(a, b): spanning forests of the compatible pairs in each bucket, and the ties of large buckets' blocks."""
    spread = reps.select("doc_id", F.explode("keys").alias("key"))
    buckets = spread.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("head")).where("n > 1")
    seats = join_per_key(spread, buckets, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / BLOCK)).cast("int"))
    seats = staged(seats.select("key", "block", "doc_id", "head", "n"), "seats")
    needed = found.join(seats.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "sketch")
    full = seats.where("doc_id <> head or n <= %d" % BLOCK).select("key", "block", "doc_id").join(needed, "doc_id")
    full = full.select("key", "block", "doc_id", "sketch").repartition(F.col("key"), F.col("block")).sortWithinPartitions("key", "block", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, sketches = None, [], []

        def ties() -> tuple[list[int], list[int]]:
            out: tuple[list[int], list[int]] = [], []
            forest = Forest(len(docs))
            for i, later in compatible(np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(docs), -1), threshold - MARGIN, samples):
                for j in later.tolist():
                    if forest.union(i, j):
                        out[0].append(docs[i]), out[1].append(docs[j])
            return out

        def batch_of(x: tuple[list[int], list[int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.int64())], ["a", "b"])

        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for k, block, doc, sketch in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (k, block) != key:
                    if len(docs) > 1:
                        x, y = ties()
                        a += x
                        b += y
                    key, docs, sketches = (k, block), [], []
                docs.append(doc)
                sketches.append(sketch)
            yield batch_of((a, b))
        if len(docs) > 1:
            yield batch_of(ties())

    heads = seats.where(f"n > {BLOCK}").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct()
    return full.mapInArrow(run, "a long, b long").unionByName(heads)


def links(sets: list[np.ndarray], threshold: tuple[int, int], split: int | None = None) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs with threshold[1] * intersection >= threshold[0] * union; with split, of the pairs across it only."""
    n, sizes = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = np.bincount(place, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[place]
    owner, place = owner[keep], column[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    left = n if split is None else split
    common = np.zeros((left, n if split is None else n - split), dtype=np.float32)
    most = int(shared.sum())
    # no wider than what is shared: groups are mostly a few documents, whose product then costs as much as their sets
    width = min(most, max(256, 8_000_000 // max(1, n)))
    for lo in range(0, most, max(1, width)):
        i, j = np.searchsorted(place, [lo, lo + width])
        dense = np.zeros((n, width), dtype=np.float32)
        dense[owner[i:j], place[i:j] - lo] = 1
        common += dense[:left] @ (dense if split is None else dense[split:]).T
    inter = common.astype(np.int64)
    other = sizes if split is None else sizes[split:]
    hit = threshold[1] * inter >= threshold[0] * (sizes[:left, None] + other[None, :] - inter)
    forest = Forest(n)
    for i, j in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
        j += 0 if split is None else split
        if i != j and forest.union(i, j):
            yield i, j


def forests(units: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b) of units (component, i, j, block, node, set): each node b that confirmed links inside its unit tie to a smaller one, with the smallest, a. A unit of one block (i = j) is
    compared in full, one of two blocks across only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []

        def forest() -> pa.RecordBatch:
            rows.sort(key=lambda r: (r[0], r[1]))
            split = None if unit[1] == unit[2] else sum(r[0] == unit[1] for r in rows)
            pairs = links([np.frombuffer(r[2], dtype=np.uint64) for r in rows], threshold, split) if len(rows) > 1 and split not in (0, len(rows)) else ()
            # nodes in ascending order, so that the root of a tree is its smallest
            order = {node: k for k, node in enumerate(sorted(r[1] for r in rows))}
            nodes, tree = list(order), Forest(len(order))
            for i, j in pairs:
                tree.union(order[rows[i][1]], order[rows[j][1]])
            tied = [(nodes[tree.find(k)], node) for k, node in enumerate(nodes) if tree.find(k) != k]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in tied], pa.int64()), pa.array([x[1] for x in tied], pa.int64())], ["a", "b"])

        for batch in batches:
            for c, i, j, block, node, found in zip(*(batch.column(k) for k in range(6)), strict=True):
                if (c.as_py(), i.as_py(), j.as_py()) != unit:
                    if rows:
                        yield forest()
                    unit, rows = (c.as_py(), i.as_py(), j.as_py()), []
                rows.append((block.as_py(), node.as_py(), found.as_py()))
        if rows:
            yield forest()

    units = units.select("component", "i", "j", "block", "node", "set").repartition(F.col("component"), F.col("i"), F.col("j")).sortWithinPartitions("component", "i", "j")
    return units.mapInArrow(run, "a long, b long")


def sized(nodes: DataFrame, *more: str) -> DataFrame:
    """(component, node) rows, and more columns, with n, the number of nodes of the component."""
    nodes = nodes.select("component", "node", *more)
    return join_per_key(nodes, nodes.groupBy("component").agg(F.count("*").alias("n")).hint("merge"), "component")


def block_of(blocks: Column, salt: int = 0) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), blocks).cast("int")


def member_sets(docs: DataFrame, groups: DataFrame, words: int) -> DataFrame:
    """component, n, node, set of every member of the candidate groups (node, component, digest)."""
    placed = sized(groups, "digest")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), text_of().alias("text")).where("node is not null")
    # always by shuffle: how much is moved then follows the input, whatever the number of groups
    held = placed.join(texts.hint("merge"), "node")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x, words).tobytes() for x in batch.column("text").to_pylist()]
            # rows that repeat a doc_id: only the text that was sketched
            own = [set_digest(x) == d for x, d in zip(sets, batch.column("digest").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("component", "n", "node")], pa.array(sets, pa.binary())], ["component", "n", "node", "set"]).filter(pa.array(own, pa.bool_()))

    return held.select("component", "n", "node", "text", "digest").mapInArrow(sets_of, "component long, n long, node long, set binary").dropDuplicates(["node"])


def confirmed(docs: DataFrame, groups: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """(a, b): confirmed links, a spanning forest of each set of documents that they connect. groups: node, component, digest.

    A group of at most BLOCK documents is compared in full. A larger one is dealt in blocks that are compared in full; of what a block ties together only the smallest document goes on
    to the next round of blocks, so a group of near copies costs its size and no square of it. What then is still apart in a group is compared across: every document outside
    the largest part with every document of the group, by pairs of blocks."""
    sets = staged(member_sets(docs, groups, words), "sets")
    zero = F.lit(0)
    found = [forests(sets.where(f"n <= {BLOCK}").withColumns({"i": zero, "j": zero, "block": zero}), threshold)]
    large = sets.where(f"n > {BLOCK}")
    level, before = large.select("component", "node", "n"), large.count()
    if not before:
        return found[0]
    rounds, wide = 0, True
    while True:
        block = block_of(F.ceil(F.col("n") / BLOCK), rounds)
        units = level.withColumn("block", block).join(large.select("node", "set"), "node").withColumns({"i": F.col("block"), "j": F.col("block")})
        tied = staged(forests(units, threshold), "links")
        found.append(tied)
        left = staged(sized(level.join(tied.select(F.col("b").alias("node")), "node", "left_anti")), "left")
        # one job tells all that is asked about a round
        now, still_wide, still_apart = left.agg(F.count("*"), F.count_if(F.col("n") > BLOCK) > 0, F.count_if(F.col("n") > 1) > 0).first()
        rounds += 1
        if not still_wide or now > 0.9 * before:
            if rounds == 1 or not wide or now > 0.9 * before:
                break
        level, before, wide = left, now, still_wide
    apart = left.where("n > 1").select("component").distinct()
    ties = found[1]
    for more in found[2:]:
        ties = ties.unionByName(more)
    if not still_apart:
        return found[0].unionByName(ties)
    # a document that was tied to a smaller one left its level, so it has one such tie
    parts = pointer_roots(ties).withColumnRenamed("component", "part")
    members = large.select("component", "node").join(apart, "component", "left_semi").join(parts, "node", "left").select("component", "node", F.coalesce("part", "node").alias("part"))
    counts = members.groupBy("component", "part").agg(F.count("*").alias("m")).groupBy("component").agg(F.max_by("part", F.struct("m", -F.col("part"))).alias("main"), F.max("m").alias("held"), F.sum("m").alias("n"))
    rest, own = F.ceil((F.col("n") - F.col("held")) / BLOCK), F.ceil(F.col("held") / BLOCK)
    dealt = join_per_key(members, counts, "component").withColumns({"outside": F.col("part") != F.col("main"), "rest": rest, "own": own})
    dealt = dealt.withColumn("block", F.when(F.col("outside"), block_of(F.col("rest"))).otherwise(F.col("rest").cast("int") + block_of(F.col("own"))))
    # documents outside the main part meet every block, the others only the blocks outside it
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("outside"), F.col("rest") + F.col("own")).otherwise(F.col("rest")).cast("int") - 1)).alias("other")
    units = dealt.select("component", "node", "block", other).join(large.select("node", "set"), "node").withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    # the parts tie what all rounds tied, and are stars already
    stars = parts.select(F.col("part").alias("a"), F.col("node").alias("b"))
    return found[0].unionByName(stars).unionByName(forests(units, threshold))


def near_groups(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100), rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every document. threshold (p, q): linked where q * intersection >= p * union."""
    found = staged(sketch_documents(docs, words, rows, bands), "sketches")
    # one set a doc_id, then one document a set
    first = found.where("digest is not null and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("digest"))
    first = staged(first, "first")
    heads = first.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = found.join(heads, (found["doc_id"] == heads["rep"]) & (found["digest"] == heads["digest"]), "left_semi").dropDuplicates(["doc_id"])
    reps = staged(reps, "representatives")
    ties = bucket_ties(reps, reps, threshold[0] / threshold[1], rows * bands)
    groups = connected_components(ties).join(reps.select(F.col("doc_id").alias("node"), "digest"), "node")
    linked = connected_components(confirmed(docs, groups, words, threshold)).withColumnRenamed("node", "rep")
    named = heads.join(linked, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    of_doc = first.join(named, "digest").select(F.col("doc_id").alias("id"), "component")
    return found.select("doc_id", "n_shingles").join(of_doc, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The documents of which each is the smallest of its group, all columns."""
    (key,) = unused(docs, 1)
    kept = near_groups(docs, words, threshold).where("doc_id <=> component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(key))).select(*docs.columns)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, threshold=(85, 100))
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
