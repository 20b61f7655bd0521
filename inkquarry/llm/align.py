"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, in minimal groups, and how often each pair of tokens meets in the whole corpus.

The tokens of one text by A and by B are the nodes of a bipartite graph, with an edge where their byte ranges overlap. Both cut the same bytes into ranges, so the edges are the
ranges between neighbouring ends of either. Union-find joins the nodes along the edges; the connected components are exactly the minimal groups, as two tokens are connected
unless both tokenizers end a token between them. The members of a component, in order, give its group and its links.

Texts are cut into units that both tokenizers code apart from each other: between a visible character and a space. So each distinct unit is aligned once per worker, as a graph of its own,
and a document's groups and links are those of its units, one behind the other.

The links of some million bytes of documents (a part) are counted together as pairs of ids before anything is shuffled. The counts of all parts are summed by pair, the highest of each B id
is found from the sums, and both go back to the parts that hold the pair. A pair that every document holds is therefore one row a part; its sum is one row that a skew join deals out.
Pairs are bounded by the two vocabularies, parts grow with the corpus; nothing is collected.

Null and empty texts, and texts whose tokens don't give back the same bytes (as those with U+2581, which piece models take for a space), have no tokens: zeros and ''. A
very long text is a part of its own. Repeated rows count as often as they are there; ties for a B id's highest count all count as highest; null doc_ids stay null, further columns are
ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkquarry.llm.bpe import bpe, ordinary
from inkquarry.llm.common import join_per_key, staged, text_of

#: Documents are aligned together up to this many characters, their links counted together up to this many, and a worker remembers this many units.
ALIGN_CHARS, PART_CHARS, MOST_UNITS = 1 << 20, 8 << 20, 400_000
#: Units end only before a space behind something visible. Pieces hold a space at their start only, and byte-level pre-tokens look no further than a run of white space and what follows
#: it, so nothing is merged over these borders. White space at the end stays with what is before it, as piece models give an empty text no space.
UNITS = re.compile(r"\s*(?:\S+(?:[^\S ]\s*|\s+\Z)?)+|\s+")
#: The id is a text in here, as lists of numbers with nulls become floats on their way through pandas.
DOCUMENT = "struct<doc_id:string,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>"


class Pieces:
    """A sentencepiece model: ids of a text that starts with a space, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.token = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        #: Units are coded apart only if no piece has a space behind anything but spaces.
        self.apart = not any("▁" in p.lstrip("▁") for p in names)

    def encode(self, units: list[str]) -> list[list[int]]:
        """The ids of texts that start with a space; the model adds one itself, so each is given to it without its own."""
        return self.model.encode([x[1:] for x in units], num_threads=1)


class Aligner:
    """Tokenizers A (byte-level BPE) and B (pieces), and the units of texts that were aligned already.

    Of each unit: counts (A tokens, B tokens, groups, links), its groups as text, and its links as numbers of pairs; a unit whose tokens don't give back its bytes has counts of -1."""

    def __init__(self, a: str, b: str):
        enc, self.b = bpe(a), Pieces(b)
        self.encode_a = ordinary(enc)
        self.bytes_a = [enc.token.get(i, b"") for i in range(max(enc.token) + 1)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.b.token))
        # an id's text before a further id of its side (0), or at the end of its side (1)
        self.text = [[np.array([f"{i}{end}" for i in range(n)], dtype=object) for end in ends] for n, ends in ((len(self.size_a), ",|"), (len(self.size_b), ",;"))]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.pair_number: dict[int, int] = {}
        self.texts: list[str] = []
        self.pairs = np.zeros(0, dtype=np.int64)
        self.counts, self.first, self.links = np.zeros((0, 4), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of A and how many each unit has, and those of B; none for units that either doesn't give back byte for byte. Special tokens are plain text here."""
        a, b = [self.encode_a(x) for x in units], self.b.encode(units)
        data = [x.encode() for x in units]
        whole = b"".join(data)
        if any(b"".join(map(t.__getitem__, chain.from_iterable(ids))) != whole for ids, t in ((a, self.bytes_a), (b, self.b.token))):
            lost = [self._differs(*x) for x in zip(a, b, data)]
            a, b = ([[] if gone else x for x, gone in zip(ids, lost)] for ids in (a, b))
        flat = lambda ids: (np.fromiter(chain.from_iterable(ids), dtype=np.int64), np.array(list(map(len, ids)), dtype=np.int64))
        return *flat(a), *flat(b)

    def _differs(self, a: list[int], b: list[int], data: bytes) -> bool:
        return b"".join(map(self.bytes_a.__getitem__, a)) != data or b"".join(map(self.b.token.__getitem__, b)) != data

    def learn(self, units: list[str]) -> None:
        """Aligns units that are not known yet, all at once."""
        rows, texts, pairs = align(self, *self.ids(units))
        self.number.update(zip(units, range(len(self.number), len(self.number) + len(units))))
        self.texts += texts
        distinct, which = np.unique(pairs, return_inverse=True)
        new = [x for x in distinct.tolist() if x not in self.pair_number]
        self.pair_number.update(zip(new, range(len(self.pair_number), len(self.pair_number) + len(new))))
        self.pairs = np.concatenate((self.pairs, np.array(new, dtype=np.int64)))
        numbers = np.array([self.pair_number[x] for x in distinct.tolist()], dtype=np.int32)
        ends = len(self.links) + np.cumsum(rows[:, 3])
        self.first = np.concatenate((self.first, ends - rows[:, 3]))
        self.links = np.concatenate((self.links, numbers[which])) if len(which) else self.links
        rows[rows[:, 0] == 0, :3] = -1
        self.counts = np.concatenate((self.counts, rows))

    def documents(self, texts: list[str]) -> tuple[list[tuple[int, int, int, int, str]], np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links, groups as text) of each text, the distinct pairs (A id << 32 | B id) and the place of each link's pair among them, in order."""
        if len(self.number) > MOST_UNITS:
            self.forget()
        cut = [(UNITS.findall(" " + t) if self.b.apart else [" " + t]) if t else [] for t in texts]
        unknown = list(dict.fromkeys(u for units in cut for u in units if u not in self.number))
        if unknown:
            self.learn(unknown)
        number, found, out = self.number, [], []
        for units in cut:
            codes = [number[u] for u in units]
            counts = self.counts[codes]
            if not codes or counts.min() < 0:
                out.append((0, 0, 0, 0, ""))
                continue
            out.append((*counts.sum(axis=0).tolist(), ";".join(map(self.texts.__getitem__, codes))))
            found += codes
        at = np.array(found, dtype=np.int64)
        n = self.counts[at, 3]
        places = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return out, self.pairs, self.links[places]


@lru_cache(maxsize=2)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes is connected to by the edges u-v: roots are hooked to smaller ones for all open edges at once, then all paths are shortened."""
    up = np.arange(n)
    while len(u):
        a, b = up[u], up[v]
        apart = a != b
        u, v = u[apart], v[apart]
        np.minimum.at(up, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up, higher := up[up]):
            up = higher
    return up


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens (numbers in A, numbers in B) of each pair whose byte ranges overlap, in order: one for each range between neighbouring ends of either."""
    marks = np.zeros(int(ends_a[-1]) + 1, dtype=np.int8)
    marks[ends_a] = 1
    marks[ends_b] |= 2
    at = np.flatnonzero(marks)
    a, b = marks[at] & 1, marks[at] >> 1
    return np.cumsum(a) - a, np.cumsum(b) - b


def align(of: Aligner, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """For some units, their ids one behind the other and how many each has: rows (n_a, n_b, n_groups, n_links), groups as text, and the pair (A id << 32 | B id) of each link, in order."""
    if not len(a):
        return np.zeros((len(n_a), 4), dtype=np.int64), [""] * len(n_a), np.zeros(0, dtype=np.int64)
    la, lb = overlaps(np.cumsum(of.size_a[a]), np.cumsum(of.size_b[b]))
    root = union_find(len(a) + len(b), la, lb + len(a))
    # a component's smallest node is its first A token, so components are numbered in the order of the text
    first = root[: len(a)] == np.arange(len(a))
    group = np.cumsum(first) - 1
    group_a, group_b = group[root[: len(a)]], group[root[len(a) :]]
    # a unit's groups as text: its members in order, those of A before those of B within each component
    last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
    texts = np.empty(len(a) + len(b), dtype=object)
    place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
    place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
    for (plain, closing), ids, last, place in zip(of.text, (a, b), (last_a, last_b), (place_a, place_b)):
        texts[place] = np.where(last, closing[ids], plain[ids])
    ends_a, ends = np.cumsum(n_a), np.cumsum(n_a + n_b).tolist()
    # links are in the order of A tokens and end with their unit, as groups do
    links, groups = np.searchsorted(la, ends_a), np.concatenate(([0], np.cumsum(first)))[ends_a]
    flat = texts.tolist()
    named = ["".join(flat[lo:hi])[:-1] for lo, hi in zip([0, *ends], ends)]
    return np.stack((n_a, n_b, np.diff(groups, prepend=0), np.diff(links, prepend=0)), axis=1), named, (a[la] << 32) | b[lb]


def aligned_parts(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row per part: its documents, its distinct pairs with their counts, and each link's place among the pairs (commonest first), in the order of documents."""
    document = pa.struct([("doc_id", pa.string()), *[(x, pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())])
    schema = pa.schema([("part", pa.int64()), ("documents", pa.list_(document)), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("links", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, number = aligner(a, b), TaskContext.get().partitionId() << 32
        documents, linked, size, waiting, waiting_size = [], [], 0, [], 0

        def settle() -> None:
            rows, pairs, links = of.documents([text for _, text in waiting])
            for (doc_id, _), (n_a, n_b, n_groups, n_links, text) in zip(waiting, rows):
                digest = hashlib.sha256(text.encode()).hexdigest() if n_a else ""
                documents.append({"doc_id": None if doc_id is None else str(doc_id), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digest})
            used = np.flatnonzero(np.bincount(links, minlength=1))
            linked.append((pairs[used], np.searchsorted(used, links)) if len(links) else (pairs[:0], links))

        def part() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate([x[0] for x in linked]))
            which = np.concatenate([np.searchsorted(pairs, x[0]).astype(np.int32)[x[1]] for x in linked])
            counts = np.bincount(which, minlength=len(pairs))
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), dtype="<u4")
            rank[order] = np.arange(len(order))
            links = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(rank[which].reshape(-1, 1).view("u1").T).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((number, documents, pairs[order], counts[order], links), schema.types)], schema=schema)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    waiting.append((doc_id, text))
                    waiting_size += len(text)
                    if waiting_size >= ALIGN_CHARS:
                        settle()
                        waiting, size, waiting_size = [], size + waiting_size, 0
                    if size >= PART_CHARS:
                        yield part()
                        number, documents, linked, size = number + 1, [], [], 0
        if waiting:
            settle()
        if documents:
            yield part()

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return rows.mapInArrow(work, f"part long, documents array<{DOCUMENT}>, pairs array<long>, counts array<long>, links binary")


def pair_counts(parts: DataFrame) -> DataFrame:
    """a, b, n, best: how many links of all parts hold each pair of ids, and whether no pair of the same B id is held by more."""
    rows = parts.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    # sums of each pair first: what then is grouped by B id is bounded by the vocabulary of A
    sums = rows.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    highest = sums.groupBy("b").agg(F.max("n").alias("highest"))
    return join_per_key(sums, highest, "b").select("pair", F.shiftright("pair", 32).alias("a"), "b", "n", (F.col("n") == F.col("highest")).alias("best"))


def alignment(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document, for the tokenizer files a (byte-level BPE) and b (pieces)."""
    parts = staged(aligned_parts(docs, a, b), "aligned")
    known = staged(pair_counts(parts).select("pair", "n", "best"), "pairs")
    held = parts.select("part", F.posexplode("pairs").alias("place", "pair"))
    back = join_per_key(held, known, "pair").select(F.col("part").alias("holder"), "place", "n", "best")

    def total(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        if not len(left):
            return pd.DataFrame(columns=columns)
        n, best = np.zeros(len(right) + 1, dtype=np.int64), np.zeros(len(right) + 1, dtype=np.int64)
        n[right["place"]], best[right["place"]] = right["n"], right["best"]
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(left["links"].iat[0]), dtype="u1").reshape(4, -1)
        links = np.ascontiguousarray(planes.T).view("<u4").ravel()
        sums, bests = (np.concatenate(([0], np.cumsum(x[links]))) for x in (n, best))
        documents = list(left["documents"].iat[0])
        out = pd.DataFrame(documents)
        end = out["n_links"].to_numpy().cumsum()
        start = end - out["n_links"].to_numpy()
        out["count_sum"], out["n_best"] = sums[end] - sums[start], bests[end] - bests[start]
        out["doc_id"] = pd.array([None if x["doc_id"] is None else int(x["doc_id"]) for x in documents], dtype="Int64")
        return out[columns]

    return (
        parts.select("part", "documents", "links").groupBy("part").cogroup(back.groupBy("holder"))
        .applyInPandas(total, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
