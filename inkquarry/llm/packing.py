"""Best-fit packing with several permitted sequence lengths.

A document longer than the largest capacity is cut into full sequences and a rest; every piece goes into a bin. Pieces are dealt by hash to shards of
about SHARD_PIECES, which tasks pack on their own: longest first, each into the open bin it fills best; where none fits, the
capacity to open is the one of least cost per unit expected to be used (cost: capacity plus a fixed OVERHEAD a sequence; expected use from what is still to be packed
that fits beside the piece). At the end each bin is downsized to the smallest permitted capacity that holds its contents. A shard leaves a few half-empty bins, whatever
its size, so the waste does not grow with the number of shards.

sequences() packs token ids: each document's ids and an end id are cut into pieces, pieces travel to their shard with their ids, and a row comes out for each sequence: its ids with padding, and
which documents' pieces lie where in it. pack() places lengths alone. Null texts are empty documents, which are an end id; texts of any length are encoded whole and cut after.

Lengths that are null or below 1 count as 1. Null doc_ids are packed like others. Rows that repeat a doc_id are pieces of their own, and pieces of one length
go by doc_id and piece. Further columns are ignored, and an empty table gives an empty result. The texts are read once, for their lengths; shards follow the number of pieces.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkquarry.llm.bpe import bpe, ordinary
from inkquarry.llm.common import staged, text_of

CAPACITIES, OVERHEAD, SHARD_PIECES = (512, 1024, 2048, 4096), 16, 20_000
#: Ids that one task packs, and the share of a sequence's cost that grows with its square, as attention does: at this length it costs twice as much per id.
SHARD_IDS, ATTENTION = 4_000_000, 16_384
SEQUENCES = "shard int, bin int, capacity int, used int, doc_ids array<bigint>, pieces array<int>, starts array<int>, lengths array<int>, ids binary"
PLACED = "doc_id long, piece int, length int, shard int, bin int, capacity int, start int, bin_used int"


def word_length(text: Column) -> Column:
    """Words between white space, and one for the end of the document."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + 1


def sized(docs: DataFrame, length: Column) -> DataFrame:
    """doc_id and n, the length of each document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(length.cast("int"), F.lit(1)), F.lit(1)).alias("n"))


def pieces_of(lengths: DataFrame, largest: int) -> DataFrame:
    cut = lengths.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {largest}").cast("int"))).alias("piece"))
    return cut.select("doc_id", "piece", F.least(F.lit(largest), F.col("n") - F.col("piece") * largest).cast("int").alias("length"))


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, attention: float = float("inf")) -> tuple[list[int], list[int], list[int]]:
    """The bin and start of each piece (given longest first), and each bin's final capacity. A sequence of capacity c costs c (1 + c / attention) + overhead."""
    capacities = sorted(capacities)
    left = np.bincount(np.asarray(lengths, dtype=np.int64), minlength=capacities[-1] + 1).astype(np.int64)
    units = np.arange(len(left)) * left
    free: list[tuple[int, int]] = []  # (room, bin), sorted: the best fit is the first that is large enough
    used: list[int] = []
    bins, starts = [], []
    smaller, seen = np.cumsum(units), 0  # units of pieces up to each length; those packed already are longer or the same
    for n in lengths:
        seen += n
        k = bisect.bisect_left(free, (n, -1))
        if k < len(free):
            room, b = free.pop(k)
        else:
            to_come = int(smaller[-1]) - seen
            costs = []
            for c in capacities:
                if c >= n:
                    fits = min(int(smaller[min(c - n, len(left) - 1)]), to_come)
                    costs.append(((c * (1 + c / attention) + overhead) / (n + min(c - n, fits)), c))
            room, b = min(costs)[1], len(used)
            used.append(0)
        bins.append(b)
        starts.append(used[b])
        used[b] += n
        if room > n:
            bisect.insort(free, (room - n, b))
    return bins, starts, [capacities[bisect.bisect_left(capacities, u)] for u in used]


def pack(docs: DataFrame, length: Column, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """Every piece of every document with its bin: (shard, bin) names a bin, start is the piece's place in it."""
    capacities = sorted(capacities)
    lengths = staged(sized(docs, length), "lengths")
    n = lengths.agg(F.sum(F.expr(f"(n + {capacities[-1] - 1}) div {capacities[-1]}"))).first()[0] or 0
    shards = max(1, -(-n // SHARD_PIECES))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", na_position="first")
        bins, starts, sizes = best_fit(pdf["length"].tolist(), capacities, overhead)
        held = np.bincount(bins, pdf["length"].to_numpy()).astype("int32")
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "piece": pdf["piece"], "length": pdf["length"], "shard": pdf["shard"], "bin": np.array(bins, dtype="int32"), "capacity": np.array(sizes, dtype="int32")[bins], "start": np.array(starts, dtype="int32"), "bin_used": held[bins]})

    dealt = pieces_of(lengths, capacities[-1]).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(one, PLACED)


def id_pieces(docs: DataFrame, tokenizer: str, largest: int) -> DataFrame:
    """doc_id, piece, length and ids (little-endian unsigned 16-bit integers, as the vocabulary has fewer than 65,536) of every document, an end id behind it. Special tokens in a text are plain text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe(tokenizer)
        encode, end = ordinary(enc), max(enc.special.values())
        if max(enc.token) > 65535:
            raise ValueError("ids don't fit into 16 bits")
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, out = batch.slice(lo, 256), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data = np.array([*encode(text), end], dtype="<u2")
                    out += [(doc_id, k, len(x), x.tobytes()) for k, x in enumerate(np.split(data, range(largest, len(data), largest)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["doc_id", "piece", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(work, "doc_id long, piece int, length int, ids binary")


def sequences(docs: DataFrame, tokenizer: str, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, attention: float = ATTENTION) -> DataFrame:
    """A row per sequence: (shard, bin) names it, used of its capacity are ids of documents and the others padding with the end id; doc_ids, pieces, starts and lengths tell what lies where."""
    capacities = sorted(capacities)
    pieces = staged(id_pieces(docs, tokenizer, capacities[-1]), "pieces")
    shards = max(1, -(-(pieces.agg(F.sum("length")).first()[0] or 0) // SHARD_IDS))

    def one(t: pa.Table) -> pa.Table:
        doc_ids, places, lengths, ids = (t[c].to_pylist() for c in ("doc_id", "piece", "length", "ids"))
        order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], doc_ids[k] is not None, doc_ids[k] or 0, places[k], ids[k]))
        bins, starts, sizes = best_fit([lengths[k] for k in order], capacities, overhead, attention)
        held: list[list[tuple[int, int]]] = [[] for _ in sizes]
        for k, b, at in zip(order, bins, starts):
            held[b].append((k, at))
        out = []
        for b, (members, size) in enumerate(zip(held, sizes)):
            used = sum(lengths[k] for k, _ in members)
            out.append((t["shard"][0].as_py(), b, size, used, [doc_ids[k] for k, _ in members], [places[k] for k, _ in members], [at for _, at in members], [lengths[k] for k, _ in members], b"".join(ids[k] for k, _ in members)))
        columns = list(zip(*out))
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    i32 = pa.int32()
    schema = pa.schema(list(zip(("shard", "bin", "capacity", "used", "doc_ids", "pieces", "starts", "lengths", "ids"), (i32, i32, i32, i32, pa.list_(pa.int64()), pa.list_(i32), pa.list_(i32), pa.list_(i32), pa.binary()))))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids"), F.lit(shards)).cast("int"))
    packed = dealt.groupBy("shard").applyInArrow(one, SEQUENCES)
    end_id = max(bpe(tokenizer).special.values())
    padding = F.unhex(F.expr(f"repeat('{np.array([end_id], dtype='<u2').tobytes().hex()}', capacity - used)"))
    return packed.withColumn("ids", F.concat("ids", padding))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
