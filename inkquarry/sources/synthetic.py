"""Labelled data of four plot types, drawn from spark.range: the same rows for the same seed, however they are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("line_plot", "bar_chart", "scatter_plot", "heatmap")


def uniform(*keys: Column | int) -> Column:
    """A number in [0, 1) that depends on the keys only."""
    return F.pmod(F.xxhash64(*[F.lit(k) if isinstance(k, int) else k for k in keys]), F.lit(1 << 52)) / float(1 << 52)


#: Axis labels of lines, and the instruction of fine-tuning.
X_LABELS = ("Time (s)", "Concentration (µM)", "Temperature (°C)", "Wavelength (nm)")
Y_LABELS = ("Absorbance (AU)", "Fluorescence (a.u.)", "Activity (%)", "Signal (mV)")
INSTRUCTION = "You are a scientific data extraction expert.\nExtract ALL numerical data from the provided scientific figure image.\nOutput a JSON array of data series objects.\n\nFigure Caption: "


def between(low: int, high: int, *keys: Column | int) -> Column:
    """A whole number from low to high - 1 that depends on the keys only."""
    return (F.lit(low) + F.floor(uniform(*keys) * (high - low))).cast("int")


def choice(values: tuple[str, ...], *keys: Column | int) -> Column:
    return F.get(F.array(*map(F.lit, values)), between(0, len(values), *keys))


def plots(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n plots as in plots_of()."""
    return plots_of(spark.range(n).withColumnRenamed("id", "plot_id"), seed)


def plots_of(ids: DataFrame, seed: int = 42) -> DataFrame:
    """For each plot_id: plot_id, stem, plot_type, n_series, n_points, caption: lines of 1-4 series of 5-29 points, bars of 1-3 conditions in 2-6 groups, scatters of 20-79 points, heat maps of 4-9 by 4-9 cells."""
    k = F.col("plot_id")
    p = ids.select("plot_id").withColumn("plot_type", choice(KINDS, k, seed))
    by_kind = lambda line, bar, scatter, heat: F.when(F.col("plot_type") == "line_plot", line).when(F.col("plot_type") == "bar_chart", bar).when(F.col("plot_type") == "scatter_plot", scatter).otherwise(heat)
    p = p.withColumn("n_series", by_kind(between(1, 5, k, seed + 1), between(1, 4, k, seed + 1), F.lit(1), between(4, 10, k, seed + 1)))
    p = p.withColumn("n_points", by_kind(between(5, 30, k, seed + 2), between(2, 7, k, seed + 2), between(20, 80, k, seed + 2), between(4, 10, k, seed + 2)))
    bare = lambda labels, j: F.trim(F.substring_index(choice(labels, k, seed + j), "(", 1))
    caption = by_kind(
        F.format_string("Effect of %s on %s for %d experimental conditions.", bare(X_LABELS, 3), bare(Y_LABELS, 4), "n_series"), F.format_string("Comparison of values across %d groups under %d experimental conditions.", "n_points", "n_series"),
        F.format_string("Scatter plot showing the relationship between Variable X and Variable Y (n=%d).", "n_points"), F.format_string("Heatmap of measurement values across %d conditions and %d replicates.", "n_series", "n_points"),
    )
    return p.withColumn("stem", F.format_string("%s_%05d", "plot_type", F.col("plot_id") + 1)).withColumn("caption", caption)


def points(plots_df: DataFrame, seed: int = 42) -> DataFrame:
    """plot_id, plot_type, series, i, x, y, err_y: lines have several series, bars categories, heat maps cells (row in series, column in x). Numbers have four places."""
    p = plots_df.withColumn("series", F.explode(F.sequence(F.lit(0), F.col("n_series") - 1)))
    p = p.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_points") - 1)))
    u = lambda k: uniform(F.col("plot_id"), F.col("series"), F.col("i"), seed + k)
    slope = uniform(F.col("plot_id"), F.col("series"), seed + 9) * 2 - 1
    kind = F.col("plot_type")
    x = F.when(kind == "scatter_plot", u(11) * 10).when(kind == "line_plot", F.col("i") * 10.0 / F.greatest(F.col("n_points") - 1, F.lit(1))).otherwise(F.col("i").cast("double"))
    y = F.when(kind == "heatmap", u(12)).when(kind == "bar_chart", 0.5 + u(12) * 4.5).otherwise(slope * x + F.col("series") + u(12))
    err = F.when(kind == "line_plot", 0.05 + u(13) * 0.25).when(kind == "bar_chart", 0.05 + u(13) * 0.45)
    return p.select("plot_id", "plot_type", "series", "i", *[F.round(c, 4).alias(n) for c, n in ((x, "x"), (y, "y"), (err, "err_y"))])


def ground_truth(points_df: DataFrame) -> DataFrame:
    """plot_id and answer, the JSON array of series that a model should give."""
    point = F.struct("i", F.struct("x", "y", F.lit(None).cast("double").alias("err_x"), "err_y").alias("p"))
    per = points_df.groupBy("plot_id", "series").agg(F.transform(F.array_sort(F.collect_list(point)), lambda q: q["p"]).alias("data_points"))
    one = F.struct("series", F.struct(F.concat(F.lit("Series "), F.char(65 + F.col("series"))).alias("series_name"), "data_points").alias("s"))
    return per.groupBy("plot_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda q: q["s"])).alias("answer"))


def save_pairs(plots_df: DataFrame, points_df: DataFrame, folder: str, images: bool = True) -> int:
    """Writes `<stem>.csv`, `<stem>_meta.json` (plot_type, caption, n_rows, ground_truth) and, unless images is False, `<stem>.png` of every plot, by the tasks; the number of files."""
    from inkquarry.operators.images import png_of
    from inkquarry.sources.exports import write_files

    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    name = F.concat(F.lit("Series "), F.char(65 + F.col("series")))
    kind = F.col("plot_type")
    head = F.when(kind == "line_plot", "series,x,y,err_y").when(kind == "bar_chart", "series,category,value,err").when(kind == "scatter_plot", "x,y").otherwise("row,col,value")
    line = (
        F.when(kind == "line_plot", F.concat_ws(",", name, cell("x"), cell("y"), cell("err_y"))).when(kind == "bar_chart", F.concat_ws(",", F.concat(F.lit("Condition "), F.col("series") + 1), F.concat(F.lit("Group "), "i"), cell("y"), cell("err_y")))
        .when(kind == "scatter_plot", F.concat_ws(",", cell("x"), cell("y"))).otherwise(F.concat_ws(",", "series", "i", cell("y")))
    )
    rows = points_df.groupBy("plot_id").agg(F.first(head).alias("head"), F.count("*").alias("n_rows"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("series", "i", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    j = plots_df.join(rows, "plot_id").join(ground_truth(points_df).withColumnRenamed("answer", "ground_truth"), "plot_id")
    csv = j.select(F.concat("stem", F.lit(".csv")).alias("name"), F.concat("head", F.lit("\n"), "body", F.lit("\n")).cast("binary").alias("content"))
    meta = j.select(F.concat("stem", F.lit("_meta.json")).alias("name"), F.to_json(F.struct("plot_type", "caption", "n_rows", "ground_truth")).cast("binary").alias("content"))
    n = write_files(csv.unionByName(meta), folder)
    if images:
        from inkquarry.sources.plots import plot_images

        pictures = png_of(plot_images(points_df).join(plots_df.select("plot_id", "stem"), "plot_id"), ["stem"])
        n += write_files(pictures.select(F.concat("stem", F.lit(".png")).alias("name"), F.col("png").alias("content")), folder)
    return n


def chat_samples(plots_df: DataFrame, answers: DataFrame) -> DataFrame:
    """plot_id and messages (role, content) of fine-tuning: the instruction with the caption and the answer. plots: plot_id, caption; answers: plot_id, answer."""
    j = plots_df.join(answers, "plot_id")
    user = F.concat(F.lit(INSTRUCTION), "caption", F.lit("\n\nOutput:"))
    return j.select("plot_id", F.array(F.struct(F.lit("user").alias("role"), user.alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))).alias("messages"))
