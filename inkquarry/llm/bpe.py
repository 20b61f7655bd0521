"""Byte-level BPE: encoding by a contiguous rank array, and decoding.

Each distinct pre-token is merged once per worker: its part boundaries and the ranks of adjacent parts lie in two arrays; the least rank is found by a
scan, its boundary is deleted, and the two ranks beside it are looked up anew. Pre-tokens longer than SCAN_BYTES use the same merges from a heap, since
repeated scans take quadratic time. Special tokens in a text become their own ids, as in the tokenizers library; null texts are empty.
Nothing depends on other rows, so the plan has no shuffle; repeated rows, ties and further columns need no care. A very long text is encoded whole, by one task; an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkquarry.llm.common import Cached, text_of

SCAN_BYTES = 400
#: The pattern of byte-level pre-tokens; W is the Unicode property White_Space.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^W\p{L}\p{N}]+|[W]+(?![^W])|[W]+".replace("W", SPACE)
NO_RANK = 1 << 60


class Bpe:
    def __init__(self, path: str):
        from inkquarry.llm.token_store import byte_letters

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.first = [vocab[c] for c in byte_letters()]
        #: (left id, right id) -> rank and id of the merged token
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[left], vocab[right]] = rank, vocab[left + right]
        self.words = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache = Cached(lambda word: array("I", self.word(word.encode())).tobytes())

    def word(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        if len(data) > SCAN_BYTES:
            return self._long(data)
        merge = self.merge
        ids = [self.first[b] for b in data]
        bounds = list(range(len(ids)))  # where each part starts; ids[k] is the part from bounds[k]
        found = [merge.get(pair) for pair in zip(ids, ids[1:])]
        ranks = [x[0] if x else NO_RANK for x in found]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            k = ranks.index(least)
            ids[k] = merge[ids[k], ids[k + 1]][1]
            del bounds[k + 1], ids[k + 1], ranks[k]
            if k < len(ranks):
                x = merge.get((ids[k], ids[k + 1]))
                ranks[k] = x[0] if x else NO_RANK
            if k:
                x = merge.get((ids[k - 1], ids[k]))
                ranks[k - 1] = x[0] if x else NO_RANK
        return ids

    def _long(self, data: bytes) -> list[int]:
        """The same merges for long pre-tokens: a linked list, and a heap of (rank, place)."""
        ids: list[int | None] = [self.first[b] for b in data]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.merge[p][0], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merge]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            if (n := after[k]) >= len(ids) or (ids[k], ids[n]) != pair:
                continue
            ids[k], ids[n], after[k] = self.merge[pair][1], None, after[n]
            if after[n] < len(ids):
                before[after[n]] = k
            for left in (before[k], k):
                if left >= 0 and (right := after[left]) < len(ids) and (p := (ids[left], ids[right])) in self.merge:
                    heapq.heappush(heap, (self.merge[p][0], left, p))
        return [x for x in ids if x is not None]

    def encode(self, text: str) -> bytes:
        """Ids as native unsigned 32-bit integers."""
        if self.marks and self.marks.search(text):
            out, at = [], 0
            for m in self.marks.finditer(text):
                out += [self._plain(text[at : m.start()]), array("I", [self.special[m[0]]]).tobytes()]
                at = m.end()
            return b"".join([*out, self._plain(text[at:])])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.words.findall(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token.__getitem__, array("I", ids))).decode("utf-8", "replace")


#: Stretches without a change between white space and other characters that the library of ordinary() would take long for.
LONG = re.compile(r"\S{2000}|\s{2000}")


def ordinary(enc: Bpe) -> Callable[[str], list[int]]:
    """Encodes a text in which special tokens are plain text: by a library that merges by the ids of merged tokens, where merges come in the order of ids, else and for long stretches by Bpe."""
    own = lambda text: np.frombuffer(enc._plain(text), dtype="<u4").tolist()
    if any(i != 256 + rank for rank, i in enc.merge.values()):
        return own
    import tiktoken

    special = set(enc.special.values())
    quick = tiktoken.Encoding("ordinary", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enc.token.items() if i not in special}, special_tokens={}).encode_ordinary
    return lambda text: own(text) if LONG.search(text) else quick(text)


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([enc.encode(x) for x in part.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(coded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([enc.decode(x) for x in part.column(1).to_pylist()], pa.string())], ["doc_id", "ids", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
