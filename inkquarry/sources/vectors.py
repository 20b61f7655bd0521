"""A stored collection of vectors with inverted lists: adding, changing and removing without a rebuild, and batches of nearest-neighbour queries.

Vectors lie in the list of their nearest centre. Centres are found once, from a bounded sample, and kept beside the vectors; a query looks into the lists of its nearest centres only.
The collection is a Store of its own, so every change is a transaction and writes what it changes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkquarry.sources.store import Store, one_per_key
from inkquarry.staging import kept

#: Centres at most, vectors of the sample that they are found from for each of them, and rounds of improving them. So what goes through the driver is bounded.
MOST_LISTS, SAMPLE_PER_LIST, ROUNDS = 1024, 40, 12
#: Vectors and queries of a list that one task compares, and scores that it holds at a time.
BLOCK, QUERIES, SCORES = 8192, 16384, 1 << 20
SCHEMAS = {"vectors": "id long, list int, unit array<double>", "centres": "id long, unit array<double>"}


def unit_of(vector: Column) -> Column:
    """The vector at length 1, as doubles; null for one that is null, empty, zero or holds nulls or numbers that aren't finite."""
    v = vector.cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (length > 0) & (length < float("inf"))
    return F.when(fine, F.transform(v, lambda x: x / length))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def centres_of(sample: np.ndarray, lists: int, seed: int = 1) -> np.ndarray:
    """Centres of length 1 of unit vectors: rounds of assigning each to the nearest and averaging, from a random choice of them. A centre that loses all its vectors stays where it is."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


def nearest(queries: pa.Table, vectors: pa.Table, k: int, itself: bool) -> pa.Table:
    """query_id, id, score of the k nearest vectors (id, unit) of each query (query_id, q) of as many dimensions. Matrix products find what may be among them; these are scored anew, term by
    term as dot() does, so that scores and ties don't depend on what else is in a block."""
    out: list[tuple] = []
    known = queries["query_id"].is_valid().to_numpy()
    places = np.arange(queries.num_rows), vectors["id"].to_numpy()
    own = queries["query_id"].fill_null(0).to_numpy()
    units = [(i, u.combine_chunks()) for i, u in zip(places, (queries["q"], vectors["unit"]))]
    lengths = [u.value_lengths().to_numpy(zero_copy_only=False) for _, u in units]
    for d in np.intersect1d(*lengths).tolist():
        (ask, q), (ids, v) = ((i[n == d], u.filter(pa.array(n == d)).flatten().to_numpy().reshape(-1, d)) for (i, u), n in zip(units, lengths))
        rows = max(1, SCORES // len(v))
        for lo in range(0, len(q), rows):
            part = q[lo : lo + rows]
            about = part @ v.T
            if not itself:
                at = ask[lo : lo + rows]
                about[(own[at][:, None] == ids) & known[at][:, None]] = -np.inf
            least = np.partition(about, len(v) - k, axis=1)[:, len(v) - k] if len(v) > k else np.full(len(part), -np.inf)
            i, j = np.nonzero((about >= least[:, None] - 1e-9) & (about > -np.inf))
            score = np.zeros(len(i))
            for c in range(d):
                score += part[i, c] * v[j, c]
            order = np.lexsort((ids[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((ask[lo + i[first]], ids[j[first]], score[first]))
    place, ids, score = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), [], [])
    return pa.table([queries["query_id"].take(pa.array(place)), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], ["query_id", "id", "score"])


class Vectors:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root, SCHEMAS)

    def build(self, vectors: DataFrame, lists: int | None = None) -> None:
        """Finds centres from a sample of the vectors (id, vector), the square root of their number if not given, and puts them all in. What was there before gives way."""
        units = vectors.select("id", unit_of(F.col("vector")).alias("unit")).where("unit is not null and id is not null")
        lists = max(1, min(MOST_LISTS, lists or int(units.count() ** 0.5)))
        # the rows of the smallest hashes: a sample that doesn't depend on how rows are dealt out
        sample = units.orderBy(F.xxhash64("id"), "id").limit(lists * SAMPLE_PER_LIST).select("unit").collect()
        found = centres_of(np.array([r[0] for r in sample]), lists) if sample else np.zeros((0, 1))
        centres = self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(found)], SCHEMAS["centres"])

        def change(t) -> None:
            t.write("centres", centres)
            t.write("vectors", self._empty())
            t.replace_rows("vectors", self._listed(vectors, centres))

        self.store.transact(change)

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMAS["vectors"])

    def _near(self, df: DataFrame, centres: DataFrame, n: int) -> DataFrame:
        """df (with `unit`) and `lists`, the numbers of the n nearest centres, nearest first. The centres, MOST_LISTS at most, are one broadcast row."""
        all_ = centres.agg(F.array_sort(F.collect_list(F.struct("id", "unit"))).alias("_centres"))
        scored = lambda c: F.struct((-dot(F.col("unit"), c["unit"])).alias("s"), c["id"].cast("int").alias("list"))
        return df.crossJoin(F.broadcast(all_)).withColumn("lists", F.transform(F.slice(F.array_sort(F.transform("_centres", scored)), 1, n), lambda x: x["list"])).drop("_centres")

    def _listed(self, vectors: DataFrame, centres: DataFrame) -> DataFrame:
        units = one_per_key(vectors.select("id", "vector"), "id").select("id", unit_of(F.col("vector")).alias("unit")).where("unit is not null and id is not null")
        return self._near(units, centres, 1).select("id", F.element_at("lists", 1).alias("list"), "unit")

    def upsert(self, vectors: DataFrame) -> None:
        """Adds vectors (id, vector) or puts them in the place of those of their ids; of rows of one id the one with the largest numbers counts. Ids whose new vector is not one are removed."""

        def change(t) -> None:
            t.remove_rows("vectors", vectors.select("id").where("id is not null"))
            t.replace_rows("vectors", self._listed(vectors, t.read("centres")))

        self.store.transact(change)

    def remove(self, ids: DataFrame) -> None:
        self.store.transact(lambda t: t.remove_rows("vectors", ids.select("id")))

    def search(self, queries: DataFrame, k: int, probes: int, itself: bool = False) -> DataFrame:
        """query_id, rank, id, score: of each query (id, vector) the k nearest by cosine in the lists of its `probes` nearest centres, ties to the smaller id; without the vector of its own id unless
        `itself`. A list's vectors and the queries that look into it meet in blocks, by matrix products, and each block keeps k of a query before they are brought together."""
        now = self.store.snapshot()
        units = queries.select(F.col("id").cast("long").alias("query_id"), unit_of(F.col("vector")).alias("unit")).where("unit is not null")
        asked = kept(self._near(units, now.read("centres"), probes).select("query_id", F.col("unit").alias("q"), F.explode("lists").alias("list")), "asked")
        vectors = now.read("vectors")
        # a row a list, MOST_LISTS at most
        per = lambda df, name, most: df.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
        blocks = F.broadcast(kept(per(vectors, "_n", BLOCK).join(per(asked, "_m", QUERIES), "list"), "blocks"))
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = asked.join(blocks, "list").withColumn("_qblock", dealt("query_id", "_m")).withColumn("_block", every("_n")).select("list", "_block", "_qblock", "query_id", "q")
        right = vectors.join(blocks, "list").withColumn("_block", dealt("id", "_n")).withColumn("_qblock", every("_m")).select("list", "_block", "_qblock", "id", "unit")
        by = ["list", "_block", "_qblock"]
        met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda a, b: nearest(a, b, k, itself), "query_id long, id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
