"""Periodic runs of words: repeated k-gram masking, then Main and Lorentz on what survives.

A run is a maximal stretch of words of one document with smallest period q and a length of at least max(least, times * q). The stretch and its copy q words on overlap in
length - q words, so every word of a run lies in a k-gram that its document repeats, where k is the least overlap of any period. Words outside such k-grams are masked; what is
left between them are segments, and no run leaves its segment.

Segments are halved again and again (Main and Lorentz, 1984): a run lies in the smallest node whose middle it crosses, and from the middle it reaches a period to the right or to
the left, so for each period up to a node's length / times two common extensions tell its whole extent. The segments of many documents are worked on together in arrays:
extensions are read from the ranks of all windows of 1, 2, 4, ... words, and segments end at marks that equal nothing. Time is n log^2 n, memory n log n for n surviving words.

Null and empty texts have no words and no runs; a very long text is worked on alone (some 200 bytes a surviving word). Documents are judged one by one, so repeated rows are all
returned, ties between runs don't arise (start and period name a run), null doc_ids stay null, further columns are ignored, and an empty table gives an empty result. There is no
shuffle, so no group is hot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkquarry.llm.common import batched, codes_of, mix64, text_of

#: Documents are worked on together up to this many words.
PART_WORDS = 400_000


def least_overlap(least: int, times: int) -> int:
    """The least length minus period of a run of any period."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def repeated_grams(codes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that starts twice or more in the same document. starts: where each document starts, and the end of the last one."""
    n, covered = len(codes), np.zeros(len(codes) + 1, dtype=np.int64)
    if n < k:
        return covered[:n] > 0
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    h = mix64(doc.astype(np.uint64) + np.uint64(1))[: n - k + 1]
    for j in range(k):  # hashes: two k-grams that meet by chance only leave more words to look at
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + codes[j : n - k + 1 + j].astype(np.uint64))
    at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    _, which, times = np.unique(h[at], return_inverse=True, return_counts=True)
    at = at[times[which] > 1]
    np.add.at(covered, at, 1)
    np.add.at(covered, at + k, -1)
    return np.cumsum(covered)[:n] > 0


def window_ranks(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each power of two up to `longest`, a number for the window at each place; equal numbers are equal windows."""
    ranks, width = [np.unique(codes, return_inverse=True)[1].astype(np.int32)], 1
    while 2 * width <= longest:
        r = ranks[-1].astype(np.int64)
        ranks.append(np.unique(r[:-width] * (r.max() + 1) + r[width:], return_inverse=True)[1].astype(np.int32))
        width *= 2
    return ranks


def common_after(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i on equal those from j on, for places i < j of one segment."""
    i, j, first = i.copy(), j.copy(), j
    for k in range(len(ranks) - 1, -1, -1):
        r, width = ranks[k], 1 << k
        fits = np.flatnonzero(j < len(r))
        step = fits[r[i[fits]] == r[j[fits]]]
        i[step] += width
        j[step] += width
    return j - first


def common_before(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i equal those before j."""
    i, j, first = i.copy(), j.copy(), j
    for k in range(len(ranks) - 1, -1, -1):
        r, width = ranks[k], 1 << k
        fits = np.flatnonzero(i >= width)
        step = fits[r[i[fits] - width] == r[j[fits] - width]]
        i[step] -= width
        j[step] -= width
    return first - j


def crossing(ranks: list[np.ndarray], lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, period) of the runs that cross the middle of their node, found from the right and from the left of it."""
    most = (hi - lo) // times
    node = np.repeat(np.arange(len(lo)), most)
    p = np.arange(len(node)) - np.repeat(np.cumsum(most) - most, most) + 1
    m = mid[node]
    for left in (m, m - p):
        # a run that ends no further than p behind the middle starts at least p before it, as it has two periods or more
        after = common_after(ranks, left, left + p)
        on = np.flatnonzero(after >= 1) if left is m else np.arange(len(p))
        q, at, after = p[on], left[on], after[on]
        before = common_before(ranks, at, at + q)
        start, end = at - before, at + q + after
        good = end - start >= np.maximum(least, times * q)
        yield start[good], end[good], q[good]


def runs_of(codes: np.ndarray, starts: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, end, period) of all runs of some documents' words, by start and period; places count through all documents."""
    none = np.zeros((0, 3), dtype=np.int64)
    live = repeated_grams(codes, starts, least_overlap(least, times))
    if not live.any():
        return none
    edge = np.zeros(len(codes) + 1, dtype=bool)
    edge[starts] = True
    begin = np.flatnonzero(live & (edge[:-1] | np.concatenate(([True], ~live[:-1]))))
    end = np.flatnonzero(live & (edge[1:] | np.concatenate((~live[1:], [True])))) + 1
    begin, end = begin[end - begin >= least], end[end - begin >= least]
    if not len(begin):
        return none
    size = end - begin
    # the segments one behind the other, each followed by a mark of its own
    lo = np.cumsum(size + 1) - (size + 1)
    held = np.empty(int((size + 1).sum()), dtype=np.int64)
    inside = np.ones(len(held), dtype=bool)
    inside[lo + size] = False
    place = np.repeat(begin - lo, size + 1) + np.arange(len(held))
    held[inside] = codes[place[inside]]
    held[~inside] = -1 - np.arange(len(size))
    ranks, hi, found = window_ranks(held, int(size.max())), lo + size, []
    while len(lo):
        mid = (lo + hi) // 2
        found += [np.stack(x, axis=1) for x in crossing(ranks, lo, mid, hi, least, times)]
        lo, hi = np.concatenate((lo, mid)), np.concatenate((mid, hi))
        large = hi - lo >= least
        lo, hi = lo[large], hi[large]
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # a stretch that also has a multiple of its smallest period is found again by that, with the same extent
    first = np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))) if len(rows) else np.zeros(0, dtype=bool)
    rows = rows[first]
    shift = place[rows[:, 0]] - rows[:, 0] if len(rows) else rows[:, 0]
    rows = rows + np.stack((shift, shift, np.zeros_like(shift)), axis=1)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_words, the runs of every whole text (by start, then period) and its words without those behind a run's first period, joined by one space."""
    if times < 2 or least < times:
        raise ValueError("a run repeats its period at least twice, and least is no less than that")
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batched(batches, PART_WORDS):
            words = [w for t in texts for w in t]
            starts = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
            rows = runs_of(codes_of(words), starts, least, times)
            drop = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(drop, rows[:, 0] + rows[:, 2], 1)
            np.add.at(drop, rows[:, 1], -1)
            stays = np.cumsum(drop)[:-1] == 0
            cut = np.searchsorted(rows[:, 0], starts)
            runs, kept = [], []
            for d, text in enumerate(texts):
                of = rows[cut[d] : cut[d + 1]].tolist()
                runs.append([{"start": s - int(starts[d]), "length": e - s, "period": q} for s, e, q in of])
                kept.append(b" ".join(w for w, stay in zip(text, stays[starts[d] : starts[d + 1]].tolist()) if stay) if of else b" ".join(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(runs, run_type), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), text_of().cast("binary").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def made_periodic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """What the query asks of some documents first: from a word on that the crc32 of the doc_id names, the words repeat with a period that it names."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def rewritten(docs: DataFrame) -> DataFrame:
    """doc_id and text with the words of made_periodic(); a null doc_id changes nothing."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batched(batches, PART_WORDS):
            out = [b" ".join(made_periodic(t, i)) for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), text_of().cast("binary").alias("text")).mapInArrow(work, "doc_id long, text string")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(rewritten(spark.read.parquet(f"{sf_dir}/documents.parquet")), least=6, times=4)
    # exact: different ratios of such lengths differ as doubles, equal ones don't
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("ratio"), (-r["start"]).alias("s"), (-r["period"]).alias("q"), r["length"].alias("n"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"), (-F.col("best.q")).alias("period"),
        F.expr("(1000 * best.n) div (-best.q)").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
