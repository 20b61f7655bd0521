"""Order-dependent operators: gap groups, medians, bands, cuts, budgets and numbering. Every order has a tie-break.

A window sorts all rows of a key in one task. Keys of more than HOT_ROWS rows are therefore cut into slices by range: each slice is worked on in a task of its own, one row a slice
tells what those behind it must know, and these rows are added up (carry) and joined back. Results are the same either way."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkquarry.staging import kept


#: Keys of more rows than this are cut into slices.
HOT_ROWS = 1_000_000


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join by all keys, in which nulls are equal; the right side's keys go."""
    other = right.select(*[F.col(k).alias(f"_same_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys]), how).drop(*[f"_same_{k}" for k in keys])


def hot_apart(df: DataFrame, keys: list[str], plain: Callable[[DataFrame], DataFrame], sliced: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """plain() of the keys that have at most `most` rows (HOT_ROWS) and sliced() of the others, if there are any."""
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > (HOT_ROWS if most is None else most)).drop("_n")
    if hot.isEmpty():
        return plain(df)
    hot = kept(hot, "hot")
    return plain(same_keys(df, hot, keys, "left_anti")).unionByName(sliced(same_keys(df, hot, keys, "left_semi")))


def slices(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds _part, the number of the row's slice: keys and order are dealt out by range, so slices of a key follow each other. Written, so that it is settled where a row lies."""
    return kept(df.repartitionByRange(*keys, *order, F.xxhash64(*df.columns)).withColumn("_part", F.spark_partition_id()), "slices")


def gap_groups(df: DataFrame, keys: list[str], x: str, ties: list[str], gap: float = 5, most: int | None = None) -> DataFrame:
    """Adds `grp`: a new group starts where x is more than `gap` beyond the previous one; gaps of exactly `gap` merge, in chains. Nulls come first and start no group."""

    def sliced(rows: DataFrame) -> DataFrame:
        r = kept(_runs(slices(rows, keys, [x, *ties]), [*keys, "_part"], x, ties, gap, "_run"), "runs")
        per = r.groupBy(*keys, "_part").agg(F.min(x).alias("_low"), F.max(x).alias("_high"), F.max("_run").alias("_runs"))
        w = Window.partitionBy(*keys).orderBy("_part")
        step = F.when(F.col("_low") - F.max("_high").over(w.rowsBetween(Window.unboundedPreceding, -1)) > gap, 1).otherwise(0)
        per = per.withColumn("_step", step).withColumn("_base", F.sum(F.col("_runs") + F.col("_step")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_runs"))
        joined = same_keys(r, kept(per.select(*keys, "_part", "_base"), "carry"), [*keys, "_part"], "inner")
        return joined.withColumn("grp", F.col("_run") + F.col("_base")).drop("_part", "_run", "_base")

    return hot_apart(df, keys, lambda rows: _runs(rows, keys, x, ties, gap, "grp"), sliced, most)


def _runs(df: DataFrame, by: list[str], x: str, ties: list[str], gap: float, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(x, *ties)
    starts = F.when(F.col(x) - F.lag(x).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", starts).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def medians(df: DataFrame, keys: list[str], columns: list[str], most: int | None = None) -> DataFrame:
    """Exact median of each column and n, the number of rows, of each key. An exact percentile holds all distinct values of a group; for groups of more than HOT_ROWS rows the middle ones are
    found by counts: of slices by range, only those that hold a middle place are looked into, at the place that the slices before leave."""

    def middle(rows: DataFrame, column: str) -> DataFrame:
        r = slices(rows.select(*keys, F.col(column).cast("double").alias(column)).where(F.col(column).isNotNull()), keys, [column])
        w = Window.partitionBy(*keys).orderBy("_part")
        sizes = r.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
        sizes = sizes.withColumn("_before", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
        place = F.explode(F.array(F.expr("(_all - 1) div 2"), F.expr("_all div 2")))
        wanted = sizes.withColumn("_place", place).where("_place >= _before and _place < _before + _n").select(*keys, "_part", (F.col("_place") - F.col("_before") + 1).alias("_row"))
        wanted = kept(wanted.groupBy(*keys, "_part").agg(F.collect_list("_row").alias("_rows")), "places")  # two at most
        inside = same_keys(r, wanted, [*keys, "_part"], "inner").withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(column)))
        found = inside.withColumn("_times", F.size(F.filter("_rows", lambda x: x == F.col("_row")))).where("_times > 0")
        return found.groupBy(*keys).agg((F.sum(F.col(column) * F.col("_times")) / F.sum("_times")).alias(column))

    def sliced(rows: DataFrame) -> DataFrame:
        out = rows.groupBy(*keys).agg(F.count("*").alias("n"))
        for c in columns:
            out = same_keys(out, middle(rows, c), keys, "left")
        return out.select(*keys, *columns, "n")

    return hot_apart(df, keys, lambda rows: _percentiles(rows, keys, columns), sliced, most)


def _percentiles(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(f"percentile(`{c}`, 0.5)").alias(c) for c in columns], F.count("*").alias("n"))


def group_medians(df: DataFrame, keys: list[str], x: str, y: str, ties: list[str], gap: float = 5, most: int | None = None) -> DataFrame:
    """One point per gap group: exact medians of x and y, and the group's size. A group can only be hot if its key is."""
    named, by = lambda g: g.select(*keys, "grp", F.col(x).alias("x"), F.col(y).alias("y")), [*keys, "grp"]
    plain = lambda rows: _percentiles(named(_runs(rows, keys, x, ties, gap, "grp")), by, ["x", "y"])
    return hot_apart(df, keys, plain, lambda rows: medians(named(gap_groups(rows, keys, x, ties, gap, most)), by, ["x", "y"], most), most)


def digitize(coords: DataFrame, calibration: DataFrame, keys: list[str] | None = None, gap: float = 5) -> DataFrame:
    """Pixels (image_id, series_id, px, py) to points (image_id, series_id, x, y), rounded to six places. calibration: per image one row for each axis ('x', 'y') of pixel_to_data's
    arguments; an image that lacks an axis gives no points."""
    from inkquarry.functions.geometry import pixel_to_data

    keys = keys or ["image_id"]
    fields = ("pixel_min", "pixel_max", "data_min", "data_max", "is_log")
    axes = calibration.groupBy(*keys).agg(*[F.first(F.when(F.col("axis") == a, F.struct(*fields)), ignorenulls=True).alias(f"_{a}") for a in ("x", "y")]).where("_x is not null and _y is not null")
    points = group_medians(coords, [*keys, "series_id"], "px", "py", ["py"], gap).join(axes, keys)
    return points.select(*keys, "series_id", *[F.bround(pixel_to_data(F.col(a), *[F.col(f"_{a}.{f}") for f in fields]), 6).alias(a) for a in ("x", "y")])


def bands(df: DataFrame, keys: list[str], position: str, gap: float = 5) -> DataFrame:
    """first, last, width of each run of positions."""
    return gap_groups(df, keys, position, [], gap).groupBy(*keys, "grp").agg(F.min(position).alias("first"), F.max(position).alias("last"), (F.max(position) - F.min(position)).alias("width"))


def widest(bands_df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n widest bands of each key (ties: the earlier), numbered by place."""
    top = bands_df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("width"), "first"))).where(F.col("_r") <= n)
    return top.withColumn("cut", ((F.col("first") + F.col("last")) / 2)).withColumn("no", F.row_number().over(Window.partitionBy(*keys).orderBy("first"))).drop("_r", "grp")


def cut_pairs(df: DataFrame, keys: list[str], position: str, end: Column | None = None, most: int | None = None) -> DataFrame:
    """Each position with the next one (the last with `end`, or dropped)."""

    def sliced(rows: DataFrame) -> DataFrame:
        r = slices(rows, keys, [position])
        per = r.groupBy(*keys, "_part").agg(F.min(position).alias("_low"))
        following = per.withColumn("_following", F.lead("_low").over(Window.partitionBy(*keys).orderBy("_part"))).drop("_low")
        nxt = F.lead(position).over(Window.partitionBy(*keys, "_part").orderBy(position))
        return same_keys(r.withColumn("next", nxt), kept(following, "carry"), [*keys, "_part"], "inner").withColumn("next", F.coalesce("next", "_following")).drop("_part", "_following")

    w = Window.partitionBy(*keys).orderBy(position)
    out = hot_apart(df, keys, lambda rows: rows.withColumn("next", F.lead(position).over(w)), sliced, most)
    return (out if end is None else out.withColumn("next", F.coalesce("next", end))).where("next is not null")


def within_budget(df: DataFrame, keys: list[str], order: list, size: str, most: int, slices: int = 64) -> DataFrame:
    """The rows, in order, while their running sum of sizes (none negative) stays within the budget.

    A row that is beyond the budget among the rows of its slice of a key is so among all of them. So each slice keeps what fits it and the first row that doesn't, which ends the list
    of the whole key where no other row does before; in tasks of their own, and what is left of a key, however many rows it has, is a few times the budget."""
    held = lambda *by: F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(slices))).withColumn("running", held(*keys, "_slice"))
    sliced = sliced.where(F.coalesce(F.col("running") - F.col(size), "running", F.lit(0)) <= most)
    return sliced.drop("_slice").withColumn("running", held(*keys)).where(F.col("running") <= most)


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "no") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def with_groups(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Adds aggregates of each row's key. Unlike a window these are partial sums first, and the join's sides both come from shuffles, so that a hot key's rows can be split."""
    per = kept(df.groupBy(*keys).agg(*[c.alias(name) for name, c in aggregates.items()]), "groups")
    return same_keys(df, per, keys, "inner")


def surrogate_ids(new: DataFrame, order: list[str], after: int, name: str = "id") -> DataFrame:
    """Dense ids after the largest in use, in the given order. Rows are dealt by range and sorted, and written with their partition and their place in it, so that both are settled; then
    only the partitions' sizes (one row each) are added up."""
    place = F.monotonically_increasing_id()
    ranged = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place)
    ranged = kept(ranged, "numbered").withColumns({"_part": F.shiftright("_place", 33), "_row": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_place")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.lit(after) + F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")
