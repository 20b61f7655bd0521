"""Accuracy of extracted series: normalised RMSE, R2, point precision and recall, series matching and reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from inkquarry.operators.ordered import hot_apart, with_groups
from inkquarry.staging import kept

RMSE_THRESHOLD, POINT_TOLERANCE = 0.05, 0.05
#: Points of a key, of both sides together, that one task compares.
MOST_POINTS = 500_000


def rmse(true: Column, predicted: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Aggregate: both sides normalised by the truth's range, that of the rows or the given one; 0 for no rows or no range. The range is taken out of the sum, so partial aggregates do."""
    low, high = F.min(true) if low is None else F.min(low), F.max(true) if high is None else F.max(high)
    return F.coalesce(F.sqrt(F.avg(F.pow(true - predicted, 2))) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))


def r2(true: Column, predicted: Column) -> Column:
    """Aggregate: 1 - SSR / SST; 0 for fewer than two rows; without variance 1 if exact, else 0."""
    paired = true.isNotNull() & predicted.isNotNull()
    n, ssr = F.count(F.when(paired, 1)), F.sum(F.pow(true - predicted, 2))
    sst = F.var_pop(F.when(paired, true)) * n
    return F.when(n < 2, 0.0).when(F.min(F.when(paired, true)) == F.max(F.when(paired, true)), F.when(ssr == 0, 1.0).otherwise(0.0)).otherwise(1 - ssr / sst)


def minmax(value: Column, *keys: str) -> Column:
    """(v - min) / (max - min) in its group; v - min where the range is 0."""
    w = Window.partitionBy(*keys)
    low, span = F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)
    return F.when(span > 0, (value - low) / span).otherwise(value - low)


def minmax_rows(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """df with each of the columns normalised as minmax() does, by one aggregate of each key and a join, so that no task has all rows of a hot key."""
    ends = {f"_{side}_{c}": f(c) for c in columns for side, f in (("low", F.min), ("high", F.max))}
    j = with_groups(df, keys, **ends)
    span = lambda c: F.col(f"_high_{c}") - F.col(f"_low_{c}")
    return j.withColumns({c: F.when(span(c) > 0, (F.col(c) - F.col(f"_low_{c}")) / span(c)).otherwise(F.col(c) - F.col(f"_low_{c}")) for c in columns}).drop(*ends)


def match_series(truth: Column, predicted: Column) -> Column:
    """Greedy matching of two arrays of names: in order of truth, the first exact name (case and outer blanks aside), else the first that contains or is contained, else the first left. Each prediction is used once.
    Result: array of (t, p) places. A fold over the array, so nothing leaves the row."""
    norm = lambda c: F.lower(F.trim(c))
    entry = F.transform(predicted, lambda p, i: F.struct(i.alias("i"), norm(p).alias("p")))
    start = F.struct(entry.alias("left"), F.array().cast("array<struct<t:int,p:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = lambda cond: F.get(F.filter(acc["left"], cond), F.lit(0))["i"]
        pick = F.coalesce(first(lambda e: e["p"] == x["name"]), first(lambda e: F.contains(e["p"], x["name"]) | F.contains(x["name"], e["p"])), F.get(acc["left"], F.lit(0))["i"])
        return F.when(pick.isNull(), acc).otherwise(
            F.struct(F.filter(acc["left"], lambda e: e["i"] != pick).alias("left"), F.array_append(acc["out"], F.struct(x["t"].alias("t"), pick.alias("p"))).alias("out"))
        )

    named = F.transform(truth, lambda t, i: F.struct(i.alias("t"), norm(t).alias("name")))
    return F.aggregate(named, start, step, lambda acc: acc["out"])


def _share_near(left: np.ndarray, right: np.ndarray, tolerance: float, pairs: int = 1 << 20) -> float:
    """The share of the left points (rows of x, y; each side normalised here) that have a right one within the tolerance. Cells decide most of them; the others are compared with the points
    whose x is near, about `pairs` at a time."""
    if not len(left):
        return 0.0

    def normal(v: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            low, high = np.fmin.reduce(v, axis=0, initial=np.inf), np.fmax.reduce(v, axis=0, initial=-np.inf)
            v = np.where(high > low, (v - low) / (high - low), v - low)
        return v[np.isfinite(v).all(axis=1)]

    a, b = normal(left), normal(right)
    code = lambda v: (c := np.floor(v / (tolerance / 1.415)).astype(np.int64))[:, 0] * (1 << 31) + c[:, 1]
    easy = np.isin(code(a), code(b))
    a, b, hits = a[~easy], b[np.argsort(b[:, 0], kind="stable")], int(easy.sum())
    reach = tolerance * (1 + 1e-9)
    lo, hi = np.searchsorted(b[:, 0], a[:, 0] - reach), np.searchsorted(b[:, 0], a[:, 0] + reach, "right")
    a, lo, n = a[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    ends = np.cumsum(n)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + pairs, "right")))
        m, first = n[at:to], np.cumsum(n[at:to]) - n[at:to]
        d = np.repeat(a[at:to], m, axis=0) - b[np.arange(m.sum()) - np.repeat(first - lo[at:to], m)]
        hits += int(np.logical_or.reduceat(np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) <= tolerance, first).sum())
        at = to
    return hits / len(left)


def point_precision_recall(truth: DataFrame, predicted: DataFrame, key: str, tolerance: float = POINT_TOLERANCE, most: int = MOST_POINTS) -> DataFrame:
    """key, precision, recall of points (key, x, y), each side normalised by itself; points without a key are left out. The points of a key come together in one shuffle; keys of more than
    `most` points go by cells, whose points are spread over tasks."""
    held = lambda df, side: df.where(F.col(key).isNotNull()).select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(side).alias("side"))
    both = held(truth, True).unionByName(held(predicted, False))
    schema = StructType([StructField(key, both.schema[key].dataType), StructField("precision", DoubleType()), StructField("recall", DoubleType())])

    def one(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        v = np.column_stack([t[c].to_numpy().astype(np.float64) for c in ("x", "y")])  # nulls are NaN
        a, b = v[side], v[~side]
        return pa.table([t[key].slice(0, 1).combine_chunks(), pa.array([_share_near(b, a, tolerance)]), pa.array([_share_near(a, b, tolerance)])], [key, "precision", "recall"])

    def by_cells(rows: DataFrame) -> DataFrame:
        return _by_cells(rows.where("side").drop("side"), rows.where("not side").drop("side"), key, tolerance)

    return hot_apart(both, [key], lambda rows: rows.groupBy(key).applyInArrow(one, schema), by_cells, most)


def _by_cells(truth: DataFrame, predicted: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Cells decide most points without any pair; only the points of cells that the other side leaves empty are compared with the distinct points of cells close by."""

    def normal(df: DataFrame) -> DataFrame:
        return kept(minmax_rows(df.select(key, "x", "y"), ["x", "y"], [key]), "normal")

    # points of one small cell are near each other, whatever their places in it; others are in the nine cells of the tolerance around a point
    small, cell = tolerance / 1.415, lambda c, side: F.floor(c / side).cast("long")

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        spots = right.select(key, F.col("x").alias("x2"), F.col("y").alias("y2")).distinct()
        full = spots.select(key, cell(F.col("x2"), small).alias("cx"), cell(F.col("y2"), small).alias("cy")).distinct()
        l = left.groupBy(key, "x", "y").agg(F.count("*").alias("n")).withColumns({"cx": cell(F.col("x"), small), "cy": cell(F.col("y"), small)})
        easy = l.join(full, [key, "cx", "cy"], "left_semi")
        around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        hard = l.join(full, [key, "cx", "cy"], "left_anti").select(key, "x", "y", "n", F.explode(around).alias("d"))
        hard = hard.select(key, "x", "y", "n", (cell(F.col("x"), tolerance) + F.col("d.i")).alias("cx"), (cell(F.col("y"), tolerance) + F.col("d.j")).alias("cy"))
        cells = spots.select(key, "x2", "y2", cell(F.col("x2"), tolerance).alias("cx"), cell(F.col("y2"), tolerance).alias("cy"))
        close = F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2)) <= tolerance
        found = hard.join(cells, [key, "cx", "cy"]).where(close).select(key, "x", "y", "n").distinct()
        hit = easy.select(key, "n").unionByName(found.select(key, "n")).groupBy(key).agg(F.sum("n").alias("hit"))
        return left.groupBy(key).agg(F.count("*").alias("all")).join(hit, key, "left").select(key, (F.coalesce("hit", F.lit(0)) / F.col("all")).alias("share"))

    t, p = normal(truth), normal(predicted)
    both = near(p, t).withColumnRenamed("share", "precision").join(near(t, p).withColumnRenamed("share", "recall"), key, "full")
    return both.select(key, F.coalesce("precision", F.lit(0.0)).alias("precision"), F.coalesce("recall", F.lit(0.0)).alias("recall"))


def report(results: DataFrame, kind: str = "figure_type") -> DataFrame:
    """Per type and in total (type null): figures, passed, pass rate in percent, mean RMSE and R2 (0 if there are none). Where results have a column `skipped`, skipped figures count in
    the total only."""
    skipped = F.col("skipped") if "skipped" in results.columns else F.lit(False)
    r = results.withColumn("_skipped", skipped)
    n = F.when(F.grouping(kind) == 1, F.count("*")).otherwise(F.count_if(~F.col("_skipped")))
    return r.rollup(kind).agg(
        n.alias("n"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed") & ~F.col("_skipped")).alias("failed"), (100.0 * F.count_if("passed") / F.greatest(n, F.lit(1))).alias("pass_rate"),
        F.coalesce(F.avg("rmse"), F.lit(0.0)).alias("mean_rmse"), F.coalesce(F.avg("r2"), F.lit(0.0)).alias("mean_r2"),
    ).where(f"{kind} is null or n > 0")


def report_lines(results: DataFrame, threshold: float = RMSE_THRESHOLD) -> DataFrame:
    """The benchmark as text: ord and value, totals first, then the types in alphabetical order. One row a type, so the only ordering is that of a few rows."""
    r = report(results)
    total = r.where("figure_type is null").select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), x.alias("value")) for k, x in enumerate((
        F.format_string("Total figures : %d", "n"), F.format_string("Passed        : %d", "passed"), F.format_string("Failed        : %d", F.col("failed")),
        F.format_string("Pass rate     : %.1f%%", "pass_rate"), F.format_string("Mean RMSE     : %.4f  (threshold=%s)", "mean_rmse", F.lit(str(threshold))), F.format_string("Mean R²       : %.4f", "mean_r2"), F.lit("Results by figure type:"),
    ))])).alias("x")).select("x.k", F.lit("").alias("figure_type"), "x.value")
    kinds = r.where("figure_type is not null").select(F.lit(99).alias("k"), "figure_type", F.format_string("  %-20s %d/%d passed  RMSE=%.4f", "figure_type", "passed", "n", "mean_rmse").alias("value"))
    order = Window.orderBy("k", "figure_type")
    return total.unionByName(kinds).select((F.row_number().over(order) - 1).alias("ord"), "value")


def benchmark(truth: DataFrame, predicted: DataFrame, threshold: float = RMSE_THRESHOLD) -> DataFrame:
    """figure, figure_type, rmse, r2, passed. Inputs: (figure, figure_type, ord, series_name, ys array<double>); the type is that of a figure's first series. Series are matched by name
    and cut to the shorter of both; the range is that of the true values compared. Figures without a prediction get nulls and don't pass."""
    pack = lambda df, name: df.groupBy("figure").agg(F.array_sort(F.collect_list(F.struct("ord", "series_name", "ys"))).alias(name))
    kinds = truth.groupBy("figure").agg(F.min_by("figure_type", "ord").alias("figure_type"))
    joined = pack(truth.where("ord is not null"), "t").join(pack(predicted, "p"), "figure")
    pairs = joined.select("figure", "t.ys", F.col("p.ys").alias("zs"), F.explode(match_series(F.col("t.series_name"), F.col("p.series_name"))).alias("m"))
    a, b = F.get("ys", F.col("m.t")), F.get("zs", F.col("m.p"))
    n = F.least(F.size(a), F.size(b))
    rows = pairs.where(n > 0).select("figure", F.explode(F.arrays_zip(F.slice(a, F.lit(1), n).alias("y"), F.slice(b, F.lit(1), n).alias("z"))).alias("v"))
    scored = rows.groupBy("figure").agg(rmse(F.col("v.y"), F.col("v.z")).alias("rmse"), r2(F.col("v.y"), F.col("v.z")).alias("r2"))
    return kinds.join(scored, "figure", "left").select("figure", F.coalesce("figure_type", F.lit("unknown")).alias("figure_type"), "rmse", "r2", F.coalesce(F.col("rmse") <= threshold, F.lit(False)).alias("passed"))
