"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of its hashed words and their beginnings, a document's is their noisy-or, 1 - prod(1 - p), and the weights
are trained from document labels alone; the sentence probabilities then locate what offends. Training takes at most MAX_TRAINING labelled documents (the first by
hash of doc_id) of at most MAX_BYTES of text together, each whole or not at all (both bounds are parameters); scoring reads every whole text and needs no shuffle, only WIDTH weights per task.

Null and empty texts have one empty sentence. A document labelled more than once is toxic if any label says so; null labels don't count. Without any label
to learn from, every score is 0. Repeated rows get the same answer, and train as one document (of different texts with one doc_id, the first by hash); further columns are ignored. A null doc_id is not held out. Very long texts are scored whole, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkquarry.llm.common import Cached, staged, text_of

WIDTH, MAX_TRAINING, MAX_BYTES, THRESHOLD = 1 << 20, 6_000, 32 << 20, 0.3
#: Besides a word as such, its beginnings of these lengths are features; those in fewer training documents than LEAST_DOCS are not learned.
BEGINNINGS, LEAST_DOCS = (3, 4, 5, 6), 4
#: Words, and the runs that end a sentence.
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]+")
STOPS = frozenset(".!?\n")


def _cells_of(word: str) -> bytes:
    """The cells of a token's features; a stop has the one cell -1."""
    if word[0] in STOPS:
        return array("i", [-1]).tobytes()
    parts = [f"{word}$", *[word[:n] for n in BEGINNINGS if n <= len(word)]]
    return array("i", [xxhash.xxh32_intdigest(x) % WIDTH for x in parts]).tobytes()


def text_cells(text: str, cells: Cached) -> np.ndarray:
    return np.frombuffer(b"".join(map(cells.__getitem__, TOKEN.findall(text.lower()))), dtype=np.int32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    def __init__(self, weights: np.ndarray, bias: float, trained: bool = True):
        self.weights, self.bias, self.trained = weights.astype(np.float32), bias, trained

    def cache(self) -> Cached:
        """token -> what it adds to its sentence's logit; NaN for stops."""
        return Cached(lambda word: np.nan if word[0] in STOPS else float(self.weights[np.frombuffer(_cells_of(word), dtype=np.int32)].sum(dtype=np.float64)))

    def sentences(self, text: str, cache: Cached) -> np.ndarray:
        """The logit of each sentence; a stop belongs to the sentence that it ends."""
        words = TOKEN.findall(text.lower())
        adds = np.fromiter(map(cache.__getitem__, words), dtype=np.float64, count=len(words))
        stop = np.isnan(adds)
        owner = np.cumsum(stop) - stop
        return np.bincount(owner, np.where(stop, 0.0, adds), minlength=1) + self.bias

    def score(self, logits: np.ndarray) -> float:
        return float(-np.expm1(-np.logaddexp(0, logits).sum())) if self.trained else 0.0


def train(docs: list[tuple[np.ndarray, int]], steps: int = 400, batch: int = 128, rate: float = 0.3, ridge: float = 1e-5) -> Model:
    """Adagrad on the log-likelihood of noisy-or over bags, in a fixed order, for a fixed number of steps. docs: (cells, label)."""
    if not docs:
        return Model(np.zeros(WIDTH), 0.0, False)
    weights, power, bias, bias_power, rng = np.zeros(WIDTH), np.full(WIDTH, 0.1), -8.0, 1.0, np.random.default_rng(7)
    if not any(y for _, y in docs):
        return Model(weights, -20.0)
    seen = np.zeros(WIDTH, dtype=np.int32)
    for cells, _ in docs:
        distinct = np.unique(cells)
        seen[distinct[distinct >= 0]] += 1
    learned, docs = docs, []
    # in one array, which goes back to the system as a whole
    kept, end = np.empty(sum(len(cells) for cells, _ in learned), dtype=np.int32), 0
    for cells, label in learned:
        cells = cells[(cells < 0) | (seen[cells] >= LEAST_DOCS)]
        own = kept[end : end + len(cells)]
        own[:] = cells
        docs.append((own, label))
        end += len(cells)
    del learned
    for _ in range(max(1, steps // -(-len(docs) // batch))):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            part = [docs[i] for i in order[lo : lo + batch]]
            # each document ends with a stop, so sentences never span documents
            cells = np.concatenate([np.append(c, np.int32(-1)) for c, _ in part])
            ends = np.cumsum([int((c < 0).sum()) + 1 for c, _ in part])
            stop = cells < 0
            owner = np.cumsum(stop) - stop
            word = ~stop
            logit = np.bincount(owner[word], weights[cells[word]], minlength=ends[-1]) + bias
            doc = np.repeat(np.arange(len(part)), np.diff(ends, prepend=0))
            label = np.array([y for _, y in part])
            log_none = -np.bincount(doc, np.logaddexp(0, logit), minlength=len(part))
            some = np.maximum(-np.expm1(log_none), 1e-12)
            pull = np.where(label == 1, -np.exp(log_none) / some, 1.0)  # of log-loss by each sentence's logit, over its probability
            slope = pull[doc] * np.exp(-np.logaddexp(0, -logit))
            used, place = np.unique(cells[word], return_inverse=True)
            grad = np.bincount(place, slope[owner[word]], minlength=len(used)) + ridge * weights[used]
            power[used] += grad * grad
            weights[used] -= rate * grad / np.sqrt(power[used])
            total = float(slope.sum())
            bias_power += total * total
            bias -= rate * total / np.sqrt(bias_power)
    return Model(weights, bias)


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAINING, most_bytes: int = MAX_BYTES) -> list[tuple[np.ndarray, int]]:
    """The word cells and label of labelled documents that are not held out: at most `bound` of them, and at most `most_bytes` of text. The chosen ids are broadcast: `bound` rows of
    16 bytes at most."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = staged(docs.select(F.col("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", F.xxhash64("text").alias("mark")), "training")
    # one text a doc_id; of those at most `bound` rows, as many as fit, in the order of the hash
    sizes = texts.groupBy("doc_id").agg(F.min(F.struct("mark", F.octet_length("text").alias("n"))).alias("x")).select("doc_id", "x.mark", "x.n")
    left, taken = most_bytes, []
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r["n"] <= left:
            left -= r["n"]
            taken.append((r["doc_id"], r["mark"]))
    if not taken:
        return []
    taken = docs.sparkSession.createDataFrame(taken, "doc_id long, mark long")
    rows = texts.join(F.broadcast(taken), ["doc_id", "mark"]).dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cached(_cells_of)
        for batch in batches:
            packed = [text_cells(x, cells).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary()), batch.column("toxic")], ["doc_id", "cells", "toxic"])

    # Arrow's buffers as they are: rows would be held by the JVM, by the reader and by Python one by one
    found = rows.select(F.col("doc_id").cast("long"), "text", "toxic").mapInArrow(run, "doc_id long, cells binary, toxic int").toArrow()
    found = sorted(zip(*(found.column(c) for c in ("doc_id", "cells", "toxic")), strict=True), key=lambda r: r[0].as_py())
    return [(np.frombuffer(cells.as_buffer(), dtype=np.int32), int(toxic.as_py() > 0)) for _, cells, toxic in found]


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAINING, most_bytes: int = MAX_BYTES) -> Model:
    return train(training_rows(docs, labels, bound, most_bytes))


SCORED = "doc_id long, score double, worst_start int, worst_end int, worst_score double"


def _worst(text: str, logits: np.ndarray) -> tuple[int, int, float]:
    """Start, end and probability of the sentence that counts most; code points, end exclusive."""
    k, at, no = int(np.argmax(logits)), 0, 0
    for m in TOKEN.finditer(text.lower()):
        if m[0][0] in STOPS:
            if no == k:
                return at, m.end(), float(1 / (1 + np.exp(-logits[k])))
            no, at = no + 1, m.end()
    return at, len(text), float(1 / (1 + np.exp(-logits[k])))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, and for documents at or over the threshold the sentence that counts most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = model.cache()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part, out = batch.slice(lo, 1000), []
                for text in part.column(1).to_pylist():
                    logits = model.sentences(text, cache)
                    score = model.score(logits)
                    out.append((score, *(_worst(text, logits) if score >= threshold else (None, None, None))))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, t) for x, t in zip(zip(*out), (pa.float64(), pa.int32(), pa.int32(), pa.float64()), strict=True)]], ["doc_id", "score", "worst_start", "worst_end", "worst_score"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, SCORED)


def clean_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents under the threshold, all columns; map-only."""
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = model.cache()
        for batch in batches:
            keep = [model.score(model.sentences(x or "", cache)) < threshold for x in batch.column(where).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score")
