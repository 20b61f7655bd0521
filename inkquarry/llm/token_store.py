"""Token ids in a content-addressed store.

Format, below one folder: `chunks/` (digest, n, data: unique runs of ids as little-endian unsigned 16-bit integers, SHA-256 as address, number of copies, and the
place that owns it), `recipes/` (one row per document in ascending doc_id order, dealt to shards by doc_id range: its place in the id stream, the digests of its chunks
and their Merkle root) and `manifest/` (per shard: first place, documents, ids and the Merkle root of its documents' roots). A rolling hash over the
last WINDOW ids cuts each document, so of passages that documents share, the chunks inside (a few hundred ids each; the two at a
passage's edges differ) are stored once. Reading joins recipes to
chunks and checks every chunk against its address and every document and shard against its Merkle root.

Null texts are empty documents and hold the end id only. Null doc_ids come first; rows that repeat a doc_id are stored each, in the order of their
Merkle roots. Further columns are ignored. Very long texts are encoded whole, by one task, and an empty table gives a store without documents.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkquarry.llm.common import Cached, mix64, new_path, text_of

#: Ids that the rolling hash sees; a cut where its top bits are zero (one id in CUT); least and most ids of a chunk; documents of a shard.
WINDOW, CUT, LEAST, MOST, SHARD_DOCS = 8, 256, 64, 2048, 50_000
END_ID, SLICE_BYTES = 2, 16 << 20
#: A random 64-bit integer for each id.
ID_MIX = mix64(np.arange(1, 65537, dtype=np.uint64))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes as themselves, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


#: The tokenizer's own pattern of pre-tokens, for lower-case ASCII without white space.
PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
PLAIN = re.compile(r"[!-~]*")


class WordEncoder:
    """Ids of whole texts as the tokenizers library gives them, with the pieces between blanks remembered.

    The file's pre-tokens never span white space, so a text's ids are those of its pieces in turn. Arrow splits a batch and finds its distinct pieces; only those
    are looked up. A piece of ASCII letters, digits and marks is cut into pre-tokens here, a piece of other letters is one (with a comma or full stop, two), and each
    pre-token goes straight to the library's BPE model; any other piece goes through its whole encode(). Texts with "<|" (added tokens) are encoded in one go."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model, self.letters, self.pieces, self.words = self.whole.model, byte_letters(), Cached(self.piece, 500_000), Cached(self.word, 500_000)

    def word(self, word: str) -> bytes:
        """Ids of one lower-case pre-token."""
        letters = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        return array("H", [x.id for x in self.model.tokenize(letters)]).tobytes()

    def piece(self, piece: str) -> bytes:
        low = piece.lower()
        if piece.isascii():
            if piece.isalpha():
                return self.words[low]
            if PLAIN.fullmatch(low):
                return b"".join([self.words[x] for x in PRE_TOKENS.findall(low)])
        else:
            mark = piece[-1]
            core, low = (piece[:-1], low[:-1]) if mark == "." or mark == "," else (piece, low)
            if core.isalpha() and low.isalpha() and "Σ" not in core and unicodedata.is_normalized("NFC", core):
                return self.words[low] if core is piece else self.words[low] + self.words[mark]
        return array("H", self.whole.encode(piece, add_special_tokens=False).ids).tobytes()

    def encode_texts(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 16-bit ids of each text."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pc.dictionary_encode(parts.values)
        known = pa.array(list(map(self.pieces.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False))), pa.large_binary())
        flat = pc.take(known, coded.indices)
        data = flat.buffers()[2].to_pybytes() if flat.buffers()[2] else b""
        ends = np.frombuffer(flat.buffers()[1], "<i8")[parts.offsets.to_numpy()].tolist()
        out = [data[a:b] for a, b in zip(ends, ends[1:])]
        for k in np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)).tolist():
            out[k] = array("H", self.whole.encode(texts[k].as_py(), add_special_tokens=False).ids).tobytes()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cuts(ids: np.ndarray) -> list[int]:
    """Where chunks end: the last is len(ids)."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    mixed, rolled = ID_MIX[ids], np.zeros(n, dtype=np.uint64)
    for k in range(min(WINDOW, n)):
        rolled[k:] += mixed[: n - k] << np.uint64(k)
    ends, start = [], 0
    for end in (np.flatnonzero(rolled * np.uint64(0x9E3779B97F4A7C15) < np.uint64(2**64 // CUT)) + 1).tolist():
        while end - start > MOST:
            start += MOST
            ends.append(start)
        if end - start >= LEAST:
            ends.append(end)
            start = end
    while n - start > MOST:
        start += MOST
        ends.append(start)
    return ends if ends and ends[-1] == n else [*ends, n]


def merkle(digests: list[bytes]) -> bytes:
    """The Merkle root: pairs are hashed level by level, an odd one moves up; leaves and inner nodes have different prefixes."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in digests] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


CODED = "doc_id long, n_tokens long, root binary, digests array<binary>, chunks array<binary>"


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts of about `most` bytes; a longer text is a run of its own."""
    size, start = 0, 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + n > most:
            yield start, k - start
            size, start = 0, k
        size += max(n, 1)
    if len(texts) > start:
        yield start, len(texts) - start


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(tokenizer), array("H", [end_id]).tobytes()
        for batch in batches:
            for lo, size in slices(batch.column(1)):
                part, out = batch.slice(lo, size), []
                for data in enc.encode_texts(part.column(1)):
                    data += tail
                    ends = cuts(np.frombuffer(data, dtype="<u2"))
                    chunks = [data[2 * a : 2 * b] for a, b in zip([0, *ends], ends)]
                    digests = [hashlib.sha256(c).digest() for c in chunks]
                    out.append((len(data) // 2, merkle(digests), digests, chunks))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())), strict=True)]], ["doc_id", "n_tokens", "root", "digests", "chunks"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, CODED)


RECIPES = "doc_id long, n_tokens long, root binary, digests array<binary>, shard int, place long, before long"
CHUNKS = "digest binary, n int, data binary, copies long, owner struct<doc_id:long,mark:long,part:int>"
MANIFEST = "shard int, docs long, ids long, root binary, start long"


def _drop(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    spark, zstd = docs.sparkSession, {"compression": "zstd"}
    encode_documents(docs, tokenizer, end_id).write.options(**zstd).parquet(f"{path}/_encoded")
    coded = spark.read.schema(CODED).parquet(f"{path}/_encoded")
    pairs = coded.select("doc_id", "root", F.posexplode(F.arrays_zip("digests", "chunks")).alias("part", "x"))
    # the owner's root, shortened, tells rows apart that repeat a doc_id
    owner = F.struct("doc_id", F.xxhash64("root").alias("mark"), "part")
    unique = pairs.groupBy(F.col("x.digests").alias("digest")).agg(F.first("x.chunks").alias("data"), F.count("*").alias("copies"), F.min(owner).alias("owner"))
    unique.select("digest", (F.octet_length("data") / 2).cast("int").alias("n"), "data", "copies", "owner").write.options(**zstd).parquet(f"{path}/chunks")
    shards = max(1, -(-coded.count() // SHARD_DOCS))
    slim = coded.select("doc_id", "n_tokens", "root", "digests").repartitionByRange(shards, "doc_id", "root").sortWithinPartitions("doc_id", "root")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition comes in its order, so places and starts are running sums: no shard is ever held as a whole
        shard, place, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            more = np.full(len(n), shard, dtype="int32"), place + np.arange(len(n)), before + np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more)], [*batch.schema.names, "shard", "place", "before"])
            place, before = place + len(n), before + int(n.sum())

    slim.mapInArrow(number, RECIPES).write.options(**zstd).parquet(f"{path}/recipes")

    sums = shard_sums(read_recipes(spark, path)).select("shard", "docs", "ids", "root")
    # One row per shard of SHARD_DOCS documents: the only ordered sum in one task.
    start = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums.withColumn("start", start).write.parquet(f"{path}/manifest")
    _drop(spark, f"{path}/_encoded")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes")


def shard_sums(recipes: DataFrame) -> DataFrame:
    """What the manifest says of each shard, found from its recipes, and whether their places and starts follow each other."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        before = (pdf["n_tokens"].cumsum() - pdf["n_tokens"]).to_numpy()
        whole = bool((pdf["place"].to_numpy() == np.arange(len(pdf))).all() and (pdf["before"].to_numpy() == before).all())
        return pd.DataFrame({"shard": [int(pdf["shard"].iat[0])], "docs": [len(pdf)], "ids": [int(pdf["n_tokens"].sum())], "root": [merkle(list(pdf["root"]))], "whole": [whole]})

    return recipes.select("shard", "place", "before", "n_tokens", "root").groupBy("shard").applyInPandas(one, "shard int, docs long, ids long, root binary, whole boolean")


def checked_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(shard, start, good): good where a shard's recipes have the Merkle root and the numbers that the manifest has."""
    found = shard_sums(read_recipes(spark, path)).select("shard", F.struct("docs", "ids", "root").alias("found"), "whole")
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("shard", F.struct("docs", "ids", "root").alias("said"), "start")
    # one row per shard of SHARD_DOCS documents
    start = F.coalesce(F.sum("said.ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    manifest = manifest.withColumn("sum", start)
    return manifest.join(found, "shard", "full").select("shard", "start", F.coalesce(F.col("said").eqNullSafe(F.col("found")) & F.col("whole") & (F.col("start") == F.col("sum")), F.lit(False)).alias("good"))


def read_store(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Every document rebuilt from the files: doc_id, start, n_tokens and ids (little-endian unsigned 32-bit integers), or with ids=False their ids_crc32. Fails where a document or a
    shard doesn't match its Merkle root.

    Each chunk goes straight to the document that owns it; only chunks with more than one copy are joined by address, to the other places that name them."""
    recipes, chunks = read_recipes(spark, path), spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    # a document's key: its id, also where that is null, and what tells rows apart that repeat an id
    key = lambda doc_id, mark: [F.coalesce(doc_id, F.lit(0)).alias("key"), doc_id.isNull().alias("idless"), mark.alias("mark")]
    own = chunks.select(*key(F.col("owner.doc_id"), F.col("owner.mark")), "owner.part", "data")
    shared = chunks.where("copies > 1").select("digest", F.struct(*key(F.col("owner.doc_id"), F.col("owner.mark")), "owner.part").alias("owner"), "data")
    places = recipes.select(*key(F.col("doc_id"), F.xxhash64("root")), F.posexplode("digests").alias("part", "digest"))
    others = places.join(shared, "digest").where(F.struct("key", "idless", "mark", "part") != F.col("owner"))
    # a set, as rows that repeat a document name its chunks again
    whole = own.unionByName(others.drop("digest", "owner")).groupBy("key", "idless", "mark").agg(F.array_sort(F.collect_set(F.struct("part", "data"))).alias("parts"))
    start = F.when(F.col("good"), F.col("start")).otherwise(F.raise_error(F.concat(F.lit("shard "), F.col("shard").cast("string"), F.lit(" does not match the manifest"))).cast("long"))
    # the manifest meets the slim recipes, never the data, whatever way Spark joins them
    slim = recipes.select(*key(F.col("doc_id"), F.xxhash64("root")), "shard", "doc_id", "before", "n_tokens", "root").join(checked_manifest(spark, path).select("shard", start.alias("start")), "shard")
    rows = slim.join(whole, ["key", "idless", "mark"], "left")

    last = "ids binary" if ids else "ids_crc32 long"

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part, starts, out = batch.slice(lo, 500), [], []
                for row in part.to_pylist():
                    data = [x["data"] for x in row["parts"] or ()]
                    joined = b"".join(data)
                    if merkle([hashlib.sha256(x).digest() for x in data]) != row["root"] or len(joined) != 2 * row["n_tokens"]:
                        raise ValueError(f"document {row['doc_id']} does not match its Merkle root")
                    starts.append(row["start"] + row["before"])
                    wide = np.frombuffer(joined, dtype="<u2").astype("<u4").tobytes()
                    out.append(wide if ids else zlib.crc32(wide))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(starts, pa.int64()), part.column("n_tokens"), pa.array(out, pa.binary() if ids else pa.int64())], ["doc_id", "start", "n_tokens", last.split()[0]])

    return rows.select("doc_id", "start", "before", "n_tokens", "root", "parts").mapInArrow(rebuild, f"doc_id long, start long, n_tokens long, {last}")


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Shards whose recipes don't match the manifest; empty when all is well."""
    return checked_manifest(spark, path).where("not good")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_store(spark, path, ids=False)
