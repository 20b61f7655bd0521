"""Suffix-array deduplication of long repeated byte strings by longest-previous-factor arrays.

A string of LENGTH bytes (a window) that starts in two places is a repeat. The suffixes that can matter are brought together by content, not by place:

1. Each window is labelled by the leftmost least hash among its GRAM-byte strings (its anchor). Windows in a row with the same anchor form a run; equal windows have
   the same anchor at the same offset, so they lie in runs of the same label. Labels that occur once are dropped, after partial counts.
2. Runs that repeat as a whole are repeats without more ado. Of every distinct run, one representative goes on, with its bytes.
3. Tasks build the suffix array of the representatives' bytes by prefix doubling, the LCP array, and from previous and next smaller positions in suffix order
   the longest previous factor of each window (and, by the mirrored array, the longest next factor). A factor of LENGTH bytes or more is a repeat.
4. A label with more than CAP distinct runs (a passage in very many documents) is not built in one task: its runs are cut by anchor offset into
   narrower ones that are labelled by their common bytes, and these go through 2 and 3 again, down to single windows, where step 2 alone decides.
So the result is exact; hashes only decide which bytes meet, but for two 64-bit hashes that must both agree for step 2.

keep="none" removes all copies; keep="first" leaves the first one (by doc_id, then place). Matches never cross documents; null texts are empty; a null doc_id sorts
before all others; rows that repeat a doc_id are documents of their own. Very long texts are cut into runs whole, by one task; further columns are ignored, and an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkquarry.llm.common import join_per_key, mix64, staged

LENGTH, GRAM, CAP = 200, 40, 4096
#: Widths of the offset ranges that runs of frequent labels are cut to, in turn.
WIDTHS = (28, 6, 1)
#: Bytes of text that are hashed at once, bytes of one suffix array.
PIECE, ARRAY = 4 << 20, 2 << 20
BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)
_table = np.random.default_rng(3).integers(0, 2**63, size=256, dtype=np.int64).astype(np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        _powers = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, np.uint64(x)))]).astype(np.uint64) for x in (BASE, pow(BASE, -1, 2**64)))
    return _powers


def runs_of(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(label, first window, number of windows, anchor offset of the first) of all runs, long texts piece by piece."""
    for lo in range(0, max(1, len(data) - LENGTH + 1), PIECE):
        part = data[lo : lo + PIECE + LENGTH - 1]
        if len(part) < LENGTH:
            return
        up, down = powers(len(part) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_table[part] * up[: len(part)], dtype=np.uint64)])
        grams = mix64((sums[GRAM:] - sums[:-GRAM]) * down[: len(part) - GRAM + 1])
        low = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        span, width = 1, LENGTH - GRAM + 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: len(part) - LENGTH + 1], low[width - span : width - span + len(part) - LENGTH + 1])
        first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
        count = np.diff(np.append(first, len(low)))
        anchor = (low[first] & np.uint64(0xFFFFFF)).astype(np.int64)
        yield grams[anchor].view(np.int64), first + lo, count, anchor - first


RUNS = "label long, content long, doc long, fp int, first int, n int, offset int"
_RUN_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
_RUN_NAMES = ["label", "content", "doc", "fp", "first", "n", "offset"]


def keyed(docs: DataFrame) -> DataFrame:
    """doc and fp name a document (a null doc_id as the least long), data are its bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.hash(text).alias("fp"), "doc_id", text.cast("binary").alias("data"))


def find_runs(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part, out = batch.slice(lo, 200), [[] for _ in range(7)]
                for doc, fp, data in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    for label, first, n, offset in runs_of(np.frombuffer(data, dtype=np.uint8)):
                        content = [xxhash.xxh3_64_intdigest(data[s:e]) for s, e in zip(first.tolist(), (first + n + LENGTH - 1).tolist(), strict=True)]
                        for k, x in enumerate((label, np.array(content, dtype=np.uint64).view(np.int64), np.full(len(n), doc), np.full(len(n), fp), first, n, offset)):
                            out[k].append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(out, _RUN_TYPES, strict=True)], _RUN_NAMES)

    return docs.where(F.octet_length("data") >= LENGTH).select("doc", "fp", "data").mapInArrow(run, RUNS)


def ranks_of(data: np.ndarray) -> dict[int, np.ndarray]:
    """For lengths 8, 16, ... 128: the rank of the string of that length at each place (bytes beyond the end count as 0), by prefix doubling; at 0, the next eight bytes themselves."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    value = np.zeros(len(data), dtype=np.uint64)
    for k in range(8):
        value |= padded[k : k + len(data)] << np.uint64(56 - 8 * k)
    ranks, length = {0: value, 8: np.unique(value, return_inverse=True)[1].astype(np.int64) + 1}, 8
    while length < 128:
        ranks[2 * length] = pair_ranks(ranks[length], length)
        length *= 2
    return ranks


def pair_ranks(rank: np.ndarray, shift: int) -> np.ndarray:
    """Ranks of the strings made of the one at each place and the one `shift` later."""
    later = np.zeros_like(rank)
    later[: max(0, len(rank) - shift)] = rank[shift:]
    return np.unique((rank << 32) | later, return_inverse=True)[1].astype(np.int64) + 1


def suffix_order(ranks: dict[int, np.ndarray], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in the order of their first LENGTH bytes, ties by place, and the LCP of neighbours (at most LENGTH; the first is 0)."""
    full = pair_ranks(ranks[128], LENGTH - 128)
    order = places[np.argsort(full[places], kind="stable")]
    a, b = order[:-1].copy(), order[1:].copy()
    lcp, same = np.zeros(len(a), dtype=np.int64), full[a] == full[b]
    for length in (128, 64, 32, 16, 8):
        at = (a + lcp < len(full)) & (b + lcp < len(full))
        equal = np.zeros(len(a), dtype=bool)
        equal[at] = ranks[length][a[at] + lcp[at]] == ranks[length][b[at] + lcp[at]]
        lcp += length * equal
    last = len(full) - 1
    differ = ranks[0][np.minimum(a + lcp, last)] ^ ranks[0][np.minimum(b + lcp, last)]
    lcp += sum((differ >> np.uint64(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 8))
    return order, np.concatenate([[0], np.where(same, LENGTH, np.minimum(lcp, LENGTH - 1))])


def longest_previous_factor(order: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """By suffix order: the longest common prefix with a suffix that starts earlier, where it has `least` bytes or more (else something below that).

    The previous smaller place of each suffix is found by jumping over larger ones, all suffixes at once, with the least LCP on the way; next smaller ones are those of the
    reversed order. The better of the two is the longest previous factor."""
    best = np.zeros(len(order), dtype=np.int64)
    for reverse in (False, True):
        place = order[::-1] if reverse else order
        common = np.concatenate([[0], lcp[1:][::-1]]) if reverse else lcp.copy()
        jump = np.arange(-1, len(place) - 1)
        common = common.copy()
        while len(todo := np.flatnonzero((jump >= 0) & (common >= least) & (place[jump] > place))):
            common[todo] = np.minimum(common[todo], common[jump[todo]])
            jump[todo] = jump[jump[todo]]
        common = np.where(jump >= 0, common, 0)
        best = np.maximum(best, common[::-1] if reverse else common)
    return best


def repeated_windows(segments: list[tuple[bytes, int]], keep: str = "none") -> list[np.ndarray]:
    """For each (bytes, number of windows), in the order of places: which windows are repeats among all segments."""
    data = np.frombuffer(b"".join(x for x, _ in segments), dtype=np.uint8)
    starts = np.cumsum([0, *[len(x) for x, _ in segments]])[:-1]
    places = np.concatenate([np.arange(s, s + n) for s, (_, n) in zip(starts, segments, strict=True)])
    order, lcp = suffix_order(ranks_of(data), places)
    hit = longest_previous_factor(order, lcp, LENGTH) >= LENGTH
    if keep == "none":
        # the longest next factor: the same with places counted from the end; ties in suffix order stay valid neighbours
        hit |= longest_previous_factor(len(data) - order, lcp, LENGTH) >= LENGTH
    flags = np.zeros(len(data), dtype=bool)
    flags[order[hit]] = True
    return [flags[s : s + n] for s, (_, n) in zip(starts, segments, strict=True)]


def stretches(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, number) of the true stretches."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True)


COVER = "doc long, fp int, first int, n int"


def build_arrays(segments: DataFrame, keep: str) -> DataFrame:
    """Covered windows (doc, fp, first, n), by suffix arrays over the runs of as many labels as fit ARRAY bytes. segments: RUNS and data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, label = [], 0, None

        def done() -> pa.RecordBatch:
            rows.sort(key=lambda r: r[:3])
            out = [(doc, fp, first + s, k) for (doc, first, fp, n, _), flags in zip(rows, repeated_windows([(d, n) for *_, n, d in rows], keep), strict=True) for s, k in stretches(flags)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc", "fp", "first", "n"])

        for batch in batches:
            for lab, doc, fp, first, n, data in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if lab != label and size >= ARRAY:
                    yield done()
                    rows, size = [], 0
                label = lab
                rows.append((doc, first, fp, n, data))
                size += len(data)
        if rows:
            yield done()

    dealt = segments.select("label", "doc", "fp", "first", "n", "data").repartition(F.col("label")).sortWithinPartitions("label")
    return dealt.mapInArrow(run, COVER)


def decide(runs: DataFrame, keep: str) -> tuple[DataFrame, DataFrame]:
    """Of runs whose labels repeat: the windows covered since their whole run repeats, and a representative of each distinct run of labels with more than one (with the label's `kinds`)."""
    here = F.struct("doc", "first", "fp", "n", "offset")
    kinds = staged(runs.groupBy("label", "content").agg(F.count("*").alias("copies"), F.min(here).alias("rep")), "kinds")
    many = kinds.where("copies > 1").select("label", "content", "rep")
    covered = runs.join(many, ["label", "content"])
    covered = covered.where(~((F.col("doc") == F.col("rep.doc")) & (F.col("first") == F.col("rep.first")) & (F.col("fp") == F.col("rep.fp")))) if keep == "first" else covered
    labels = kinds.groupBy("label").agg(F.count("*").alias("kinds")).where("kinds > 1")
    reps = join_per_key(kinds, labels, "label").select("label", "content", "kinds", "rep.*")
    return covered.select("doc", "fp", "first", "n"), reps


def cut_runs(segments: DataFrame, width: int) -> DataFrame:
    """The runs cut by anchor offset into ranges of `width`, labelled by what all windows of a range have in common. segments and result: RUNS and data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, fp, first, n, offset, data in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                for lo in range((offset - n + 1) // width * width, offset + 1, width):
                    high, low = min(lo + width - 1, offset), max(lo, offset - n + 1)
                    a, b = offset - high, offset - low  # windows of the run, counted from its first
                    core = data[offset - lo : offset - lo - width + 1 + LENGTH]
                    part = data[a : b + LENGTH]
                    out.append((xxhash.xxh3_64_intdigest(core, seed=width) ^ lo, xxhash.xxh3_64_intdigest(part, seed=high - lo), doc, fp, first + a, b - a + 1, high, part))
            arrays = [pa.array(np.array([r[k] for r in out], dtype=np.uint64).view(np.int64)) for k in (0, 1)] + [pa.array([r[k] for r in out], t) for k, t in zip(range(2, 8), (*_RUN_TYPES[2:], pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [*_RUN_NAMES, "data"])

    return segments.select("doc", "fp", "first", "n", "offset", "data").mapInArrow(run, f"{RUNS}, data binary")


def with_bytes(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The representatives with their bytes: wanted places are grouped by document, and documents meet them once."""
    wanted = reps.groupBy("doc", "fp").agg(F.collect_list(F.struct("label", "content", "kinds", "first", "n", "offset")).alias("runs"))
    schema = f"{RUNS}, kinds long, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                out = [
                    (r["label"], r["content"], doc, fp, r["first"], r["n"], r["offset"], r["kinds"], data[r["first"] : r["first"] + r["n"] + LENGTH - 1])
                    for doc, fp, data, found in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True) for r in found
                ]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((*_RUN_TYPES, pa.int64(), pa.binary()))], [*_RUN_NAMES, "kinds", "data"])

    return docs.join(wanted, ["doc", "fp"]).select("doc", "fp", "data", "runs").mapInArrow(run, schema)


def covered_windows(docs: DataFrame, keep: str = "none") -> DataFrame:
    """(doc, fp, first, n): stretches of windows that are to go. docs: keyed()."""
    runs = find_runs(docs)
    labels = runs.groupBy("label").agg(F.count("*").alias("_n")).where("_n > 1")
    repeats = staged(join_per_key(runs, labels, "label").select(*_RUN_NAMES), "runs")
    found, reps = decide(repeats, keep)
    segments = staged(with_bytes(reps, docs), "segments")
    out = [found, build_arrays(segments.where(F.col("kinds") <= CAP), keep)]
    for width in WIDTHS:
        frequent = segments.where(F.col("kinds") > CAP)
        if not frequent.take(1):
            break
        cut = staged(cut_runs(frequent, width), "cut")
        # a run that was covered as a whole is known already, but its windows still count as occurrences
        found, reps = decide(cut.drop("data"), keep)
        segments = staged(reps.join(cut.select("doc", "fp", "first", "n", "label", "data").dropDuplicates(["doc", "fp", "first", "n", "label"]), ["doc", "fp", "first", "n", "label"]), "segments")
        out += [found, build_arrays(segments.where(F.col("kinds") <= CAP), keep)]
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def remaining(data: bytes, windows: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed stretches, and what is left."""
    left, at, removed, spans = [], 0, 0, 0
    for first, n in sorted(windows):
        end = first + n + LENGTH - 1
        if first > at or not spans:
            left.append(data[at:first])
            spans += 1
            removed += end - first
        elif end > at:
            removed += end - at
        at = max(at, end)
    left.append(data[at:])
    return removed, spans, b"".join(left)


def remove_repeats(docs: DataFrame, keep: str = "none") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and what is left of each document (bytes)."""
    docs = keyed(docs)
    windows = covered_windows(docs, keep).groupBy("doc", "fp").agg(F.collect_list(F.struct("first", "n")).alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                out = [(len(data), *remaining(data, [(x["first"], x["n"]) for x in found or ()])) for data, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]], ["doc_id", "n_bytes", "n_removed", "n_spans", "left"])

    joined = docs.join(windows, ["doc", "fp"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "data", "windows")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, left binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("left", 256).alias("kept_sha256"))
