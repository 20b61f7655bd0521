"""Substring dedup by level-wise doubling: the words that a window repeated from an earlier document covers are removed.

Short windows are tested first, and windows that repeat at one length alone are extended to twice that length, until the asked length is reached or no candidates survive. The
name of a window is made from the names of its two halves, so a level's names are those of the level before, paired. Lengths are the asked one halved (rounded up) down to
at most SHORTEST; for 13 words 7 and 13. Longer windows than the asked one are not looked at: what they cover is covered by those of the asked length.

Documents are packed into segments of some SEGMENT_WORDS words, staged once. On each level a segment sends every distinct candidate name once, cut to 32 bits beside the number of its bucket,
so a window that very many documents hold is one key a segment; buckets are ranges of names of BUCKET_KEYS keys on average, and answer with one bit a key: is it in another document?
Names that meet by chance only leave a candidate more. On the last level, names have 96 bits, a segment sends with each name the least doc_id that holds it there, and the bit says
whether another segment has a smaller one; within the segment that is decided at once. Documents without candidates leave after the first level.

Texts that are null or empty have no words. A very long text is a segment of its own. Windows of rows with the same doc_id don't remove each other's words, so repeated rows are all
returned, alike; a null doc_id counts as the largest number. Further columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkquarry.llm.common import mix64, staged, text_of

#: Words of a segment, keys of a bucket on average, and the length up to which windows are not halved.
SEGMENT_WORDS, BUCKET_KEYS, SHORTEST = 1_000_000, 500_000, 7
LAST_ID = np.iinfo(np.int64).max
#: Ids are texts in here, as lists of numbers with nulls become floats on their way through pandas.
STATE = "segment long, ids array<string>, counts array<long>, words binary, alive binary, candidates long, done array<struct<doc_id:string,n_words:bigint,kept:binary>>"


def named(doc_id: int | None) -> str | None:
    return None if doc_id is None else str(doc_id)


def ladder(width: int) -> list[int]:
    """The lengths of the levels, shortest first."""
    lengths = [width]
    while lengths[0] > SHORTEST:
        lengths.insert(0, (lengths[0] + 1) // 2)
    return lengths


def packed_planes(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes, which suits sorted and small ones."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.reshape(-1, 1).view("u1").T).tobytes())


def unpacked_planes(data: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype="u1").reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(dtype).ravel()


def names(words: np.ndarray, length: int) -> np.ndarray:
    """The name of the window of `length` words at each place, from the names of its two halves, which overlap by a word where the length is odd."""
    if length == 1 or len(words) < length:
        return words if length == 1 else words[:0]
    half = names(words, (length + 1) // 2)
    shift = length // 2
    return mix64(half[: len(half) - shift] * np.uint64(0x9E3779B97F4A7C15) + mix64(half[shift:] ^ np.uint64(length)))


class Segment:
    """Some documents: their words one behind the other, and which places are candidates for a window."""

    def __init__(self, ids: list[int | None], counts: np.ndarray, blob: bytes, alive: bytes | None):
        self.ids, self.counts = ids, counts.astype(np.int64)
        self.words = zstandard.ZstdDecompressor().decompress(blob).split()
        self.ends = np.cumsum(self.counts)
        self.doc = np.repeat(np.arange(len(ids)), self.counts)
        self.alive = None if alive is None else np.unpackbits(np.frombuffer(alive, dtype="u1"), count=len(self.words)).astype(bool)
        coded = pa.array(self.words, pa.binary()).dictionary_encode()
        hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in coded.dictionary.to_pylist()), dtype="<u8").reshape(-1, 2)
        self.lanes = [hashes[:, k][coded.indices.to_numpy(zero_copy_only=False)] for k in (0, 1)] if len(self.words) else [np.zeros(0, dtype="<u8")] * 2

    def candidates(self, length: int) -> np.ndarray:
        """Places where a window of this length starts that is inside one document and was not given up."""
        at = np.arange(len(self.words) - length + 1) if len(self.words) >= length else np.zeros(0, dtype=np.int64)
        at = at[self.doc[at] == self.doc[at + length - 1]]
        return at if self.alive is None else at[self.alive[at]]

    def distinct(self, length: int, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """places by name, where each name starts among them, and for each name both its lanes (the second one only if wide) and the document number at each place."""
        at = self.candidates(length)
        first = names(self.lanes[0], length)[at]
        second = names(self.lanes[1], length)[at] >> np.uint64(32) if wide else None
        order = np.lexsort((second, first)) if wide else np.argsort(first, kind="stable")
        at, first = at[order], first[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = first[1:] != first[:-1]
        if wide:
            second = second[order]
            new[1:] |= second[1:] != second[:-1]
        start = np.flatnonzero(new)
        return at, start, first[start], second[start] if wide else None, self.doc[at]

    def document(self, d: int, stays: np.ndarray | None = None) -> bytes:
        text = self.words[self.ends[d] - self.counts[d] : self.ends[d]]
        return b" ".join(text if stays is None else compress(text, stays.tolist()))

    def numbers(self) -> np.ndarray:
        return np.array([LAST_ID if i is None else i for i in self.ids], dtype=np.int64)


def segments(docs: DataFrame) -> DataFrame:
    """The documents in segments, every place a candidate."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, counts, texts = TaskContext.get().partitionId() << 32, [], [], []
        types = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.int64()]

        def segment() -> pa.RecordBatch:
            row = number, ids, counts, zstandard.ZstdCompressor(level=3).compress(b"\n".join(texts)), sum(counts)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], ["segment", "ids", "counts", "words", "candidates"])

        n = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = text.split()  # ASCII white space: exactly \x20 and \x09 to \x0D
                    if ids and n + len(words) > SEGMENT_WORDS:
                        yield segment()
                        number, ids, counts, texts, n = number + 1, [], [], [], 0
                    ids.append(named(doc_id))
                    counts.append(len(words))
                    texts.append(b" ".join(words))
                    n += len(words)
        if ids:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("long"), text_of().cast("binary").alias("text"))
    found = rows.mapInArrow(work, "segment long, ids array<string>, counts array<long>, words binary, candidates long")
    return found.select("segment", "ids", "counts", "words", F.lit(None).cast("binary").alias("alive"), "candidates", F.array().cast("array<struct<doc_id:string,n_words:bigint,kept:binary>>").alias("done"))


def opened(row: dict) -> Segment:
    return Segment([None if x is None else int(x) for x in row["ids"]], np.asarray(row["counts"], dtype=np.int64), row["words"], row["alive"])


def _bits(candidates: int) -> int:
    """Buckets are numbered by this many leading bits of a name."""
    return max(6, int(candidates // BUCKET_KEYS).bit_length())


def asked(state: DataFrame, length: int, bits: int, last: bool) -> DataFrame:
    """(bucket, segment, keys, owners) of every segment: on the last level the owners are doc_ids, before it a bit that tells whether two documents of the segment hold the window."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not row["candidates"]:
                    continue
                seg = opened(row)
                at, start, first, second, doc = seg.distinct(length, last)
                if not len(start):
                    continue
                if last:
                    owner = np.minimum.reduceat(seg.numbers()[doc], start)
                else:
                    key = ((first << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
                    many = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
                bucket = (first >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist() + [len(bucket)]
                out = []
                for lo, hi in zip(cuts, cuts[1:]):
                    if last:
                        data = packed_planes(first[lo:hi]), packed_planes(second[lo:hi].astype("<u4")), packed_planes(owner[lo:hi])
                    else:
                        data = packed_planes(key[lo:hi]), b"", np.packbits(many[lo:hi]).tobytes()
                    out.append((int(bucket[lo]), row["segment"], hi - lo, *data))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "segment", "n", "keys", "more", "owners"]
                )

    return state.select("segment", "ids", "counts", "words", "alive", "candidates").mapInArrow(work, "bucket long, segment long, n long, keys binary, more binary, owners binary")


def answered(questions: DataFrame, last: bool) -> DataFrame:
    """(segment, bucket, hits): a bit for each key that was sent, in its order."""

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = pdf["n"].to_numpy().cumsum()
        if last:
            first, second = (np.concatenate([unpacked_planes(x, t) for x in pdf[c]]) for c, t in (("keys", "<u8"), ("more", "<u4")))
            owner = np.concatenate([unpacked_planes(x, "<i8") for x in pdf["owners"]])
            order = np.lexsort((second, first))
            new = np.concatenate(([True], (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])))
            start = np.flatnonzero(new)
            least = np.minimum.reduceat(owner[order], start)
            hit = np.empty(len(owner), dtype=bool)
            hit[order] = owner[order] > least[np.cumsum(new) - 1]
        else:
            key = np.concatenate([unpacked_planes(x, "<u4") for x in pdf["keys"]])
            many = np.concatenate([np.unpackbits(np.frombuffer(x, dtype="u1"), count=n).astype(bool) for x, n in zip(pdf["owners"], pdf["n"])])
            _, which, times = np.unique(key, return_inverse=True, return_counts=True)
            times[which[many]] += 1
            hit = times[which] > 1
        parts = np.split(hit, ends[:-1])
        return pd.DataFrame({"segment": pdf["segment"], "bucket": pdf["bucket"], "n": pdf["n"], "hits": [np.packbits(x).tobytes() for x in parts]})

    return questions.groupBy("bucket").applyInPandas(judge, "segment long, bucket long, n long, hits binary")


def _hits(right: pd.DataFrame) -> np.ndarray:
    right = right.sort_values("bucket")
    parts = [np.unpackbits(np.frombuffer(x, dtype="u1"), count=n).astype(bool) for x, n in zip(right["hits"], right["n"])]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=bool)


def advanced(state: DataFrame, answers: DataFrame, length: int, following: int, of_kept) -> DataFrame:
    """The state of the next level: places whose two windows of `length` both repeat, so that one of `following` words may; documents without any are done."""

    def step(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["segment", "ids", "counts", "words", "alive", "candidates", "done"]
        if not len(left):
            return pd.DataFrame(columns=columns)
        row = left.iloc[0]
        done = [dict(x) for x in row["done"]]
        if not row["candidates"]:
            return pd.DataFrame([[row["segment"], row["ids"], row["counts"], row["words"], row["alive"], 0, done]], columns=columns)
        seg = opened(row)
        at, start, _, _, _ = seg.distinct(length, False)
        repeats = np.zeros(len(seg.words) + following, dtype=bool)
        repeats[at] = np.repeat(_hits(right), np.diff(np.append(start, len(at))))
        seg.alive = repeats[: len(seg.words)] & repeats[following - length :][: len(seg.words)]
        places = seg.candidates(following)
        alive = np.zeros(len(seg.words), dtype=bool)
        alive[places] = True
        stay = np.bincount(seg.doc[places], minlength=len(seg.ids)) > 0
        ids, texts = [], []
        for d, doc_id in enumerate(seg.ids):
            text = seg.document(d)
            if stay[d]:
                ids.append(named(doc_id))
                texts.append(text)
            else:
                done.append({"doc_id": named(doc_id), "n_words": int(seg.counts[d]), "kept": of_kept(text)})
        bits = np.packbits(alive[np.repeat(stay, seg.counts)]).tobytes()
        return pd.DataFrame([[row["segment"], ids, seg.counts[stay].tolist(), zstandard.ZstdCompressor(level=3).compress(b"\n".join(texts)), bits, len(places), done]], columns=columns)

    return state.groupBy("segment").cogroup(answers.groupBy("segment")).applyInPandas(step, STATE)


def without_repeats(state: DataFrame, answers: DataFrame, width: int, of_kept) -> DataFrame:
    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [] if not len(left) else [(None if x["doc_id"] is None else int(x["doc_id"]), x["n_words"], 0, x["kept"]) for x in left.iloc[0]["done"]]
        if len(left) and len(left.iloc[0]["ids"]):
            seg = opened(left.iloc[0])
            at, start, _, _, doc = seg.distinct(width, True)
            covered = np.zeros(len(seg.words) + width + 1, dtype=np.int64)
            if len(at):
                number, times = seg.numbers(), np.diff(np.append(start, len(at)))
                owner = np.repeat(np.minimum.reduceat(number[doc], start), times)
                late = at[(number[doc] > owner) | np.repeat(_hits(right), times)]
                np.add.at(covered, late, 1)
                np.add.at(covered, late + width, -1)
            stays = np.cumsum(covered)[: len(seg.words)] == 0
            for d, doc_id in enumerate(seg.ids):
                mine = stays[seg.ends[d] - seg.counts[d] : seg.ends[d]]
                out.append((doc_id, int(seg.counts[d]), int(len(mine) - mine.sum()), of_kept(seg.document(d, mine))))
        doc_id, n_words, n_removed, kept = zip(*out) if out else ((), (), (), ())
        return pd.DataFrame({"doc_id": pd.array(doc_id, dtype="Int64"), "n_words": n_words, "n_removed": n_removed, "kept": kept})

    return state.groupBy("segment").cogroup(answers.groupBy("segment")).applyInPandas(finish, "doc_id long, n_words long, n_removed long, kept binary")


def digest(kept: bytes) -> bytes:
    return hashlib.sha256(kept).digest()


def remove_repeats(docs: DataFrame, width: int, of_kept=bytes) -> DataFrame:
    """doc_id, n_words, n_removed and kept of every document: the words that no window repeated from a document of smaller doc_id covers, joined by one space, as of_kept gives them back."""
    if width < 1:
        raise ValueError("a window has one word at least")
    state, lengths = staged(segments(docs), "segments"), ladder(width)
    for length, following in zip(lengths, lengths[1:]):
        n = state.agg(F.sum("candidates")).first()[0] or 0
        if not n:  # no candidates survive: nothing repeats at the full length either
            break
        state = staged(advanced(state, answered(asked(state, length, _bits(n), False), False), length, following, of_kept), "level")
    n = state.agg(F.sum("candidates")).first()[0] or 0
    return without_repeats(state, answered(asked(state, width, _bits(n), True), True), width, of_kept)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 13, digest)
    return found.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept")).alias("kept_sha256"))
