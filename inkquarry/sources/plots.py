"""Plots drawn as images: the rows of synthetic.points() rasterised, a plot a row, in Arrow batches.

A plot has a white ground, a dark frame with ticks, and its data in colours of its own series: lines with markers and error bars, bars in groups with error bars, markers alone, or cells
whose colour tells their value. Where each number lies is calibration()'s, so that what is digitised from an image can be held against the truth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkquarry.operators.images import IMAGE, image_of

#: Size of an image, and the frame's left, top, right and bottom line in it.
WIDTH, HEIGHT, FRAME = 640, 480, (70, 30, 610, 420)
#: Colours of series (blue, green, red), far from each other and from grey; the frame's and the error bars' colour.
COLOURS, INK, LINE = np.array([(200, 60, 40), (40, 120, 220), (60, 160, 40), (190, 40, 160)], dtype=np.uint8), 30, 25


def cell_colour(value: np.ndarray) -> np.ndarray:
    """The colour of a heat map's cell, from 0 to 1: blue falls, red rises, and green has its height in between."""
    v = np.clip(np.asarray(value, dtype=float), 0, 1)
    return np.stack((np.rint(230 - 200 * v), np.rint(200 - 400 * np.abs(v - 0.5)), np.rint(30 + 200 * v)), axis=-1).astype(np.uint8)


def cell_value(pixel: np.ndarray) -> np.ndarray:
    """The value that a cell's colour stands for."""
    p = np.asarray(pixel, dtype=float)
    return ((230 - p[..., 0]) + (p[..., 2] - 30)) / 400


class Canvas:
    def __init__(self, limits: tuple[float, float, float, float]):
        self.pixels = np.full((HEIGHT, WIDTH, 3), 255, dtype=np.uint8)
        self.x0, self.x1, self.y0, self.y1 = limits
        left, top, right, bottom = FRAME
        self.box(left, top, right, top + 1, INK), self.box(left, bottom, right, bottom + 1, INK), self.box(left, top, left + 1, bottom, INK), self.box(right, top, right + 1, bottom + 1, INK)
        for k in range(6):
            x, y = left + (right - left) * k // 5, bottom - (bottom - top) * k // 5
            self.box(x, bottom, x + 1, bottom + 5, INK), self.box(left - 4, y, left, y + 1, INK)

    def at(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pixels of data."""
        left, top, right, bottom = FRAME
        return left + (np.asarray(x) - self.x0) / (self.x1 - self.x0) * (right - left), bottom - (np.asarray(y) - self.y0) / (self.y1 - self.y0) * (bottom - top)

    def box(self, x0: float, y0: float, x1: float, y1: float, colour) -> None:
        """Pixels from (x0, y0) up to but without (x1, y1)."""
        self.pixels[max(0, round(y0)) : max(0, round(y1)), max(0, round(x0)) : max(0, round(x1))] = colour

    def line(self, x0: float, y0: float, x1: float, y1: float, colour, thick: int = 2) -> None:
        n = int(max(abs(x1 - x0), abs(y1 - y0))) + 1
        x, y = np.rint(np.linspace(x0, x1, n)).astype(int), np.rint(np.linspace(y0, y1, n)).astype(int)
        for dx in range(thick):
            for dy in range(thick):
                self.pixels[np.clip(y + dy - thick // 2, 0, HEIGHT - 1), np.clip(x + dx - thick // 2, 0, WIDTH - 1)] = colour

    def disc(self, x: float, y: float, radius: int, colour) -> None:
        dy, dx = np.mgrid[-radius : radius + 1, -radius : radius + 1]
        inside = dx**2 + dy**2 <= radius**2 + 1
        self.pixels[np.clip(round(y) + dy[inside], 0, HEIGHT - 1), np.clip(round(x) + dx[inside], 0, WIDTH - 1)] = colour

    def whisker(self, x: float, low: float, high: float) -> None:
        self.line(x, low, x, high, LINE, 1), self.line(x - 3, low, x + 3, low, LINE, 1), self.line(x - 3, high, x + 3, high, LINE, 1)


def limits_of(kind: str, x: np.ndarray, y: np.ndarray, err: np.ndarray) -> tuple[float, float, float, float]:
    """What the frame's sides stand for: data and error bars with a margin; bars start at 0, cells fill the frame."""
    if kind == "heatmap":
        return 0.0, float(x.max() + 1), 0.0, 1.0
    e = np.nan_to_num(err)
    low, high = float((y - e).min()), float((y + e).max())
    if kind == "bar_chart":
        return -0.5, float(x.max() + 0.5), 0.0, high * 1.05
    pad = lambda a, b: 0.05 * (b - a) or 0.5
    px, py = pad(float(x.min()), float(x.max())), pad(low, high)
    return float(x.min()) - px, float(x.max()) + px, low - py, high + py


def drawn(kind: str, series: np.ndarray, x: np.ndarray, y: np.ndarray, err: np.ndarray) -> tuple[np.ndarray, tuple[float, float, float, float]]:
    """The pixels of a plot and its limits. Rows are in the order of series and places."""
    limits = limits_of(kind, x, y, err)
    c = Canvas(limits)
    left, top, right, bottom = FRAME
    if kind == "heatmap":
        rows, columns = int(series.max()) + 1, int(x.max()) + 1
        colours = cell_colour(y)
        for s, k, colour in zip(series.astype(int), x.astype(int), colours):
            c.box(left + 1 + (right - left - 1) * k / columns, top + 1 + (bottom - top - 1) * s / rows, left + 1 + (right - left - 1) * (k + 1) / columns, top + 1 + (bottom - top - 1) * (s + 1) / rows, colour)
        return c.pixels, limits
    px, py = c.at(x, y)
    n = int(series.max()) + 1
    for s in range(n):
        mine, colour = np.flatnonzero(series == s), COLOURS[s % len(COLOURS)]
        for k in mine:
            low, high = (float(c.at(x[k], y[k] + d * np.nan_to_num(err[k]))[1]) for d in (-1, 1))
            if kind == "bar_chart":
                wide = 0.8 * (right - left) / (x.max() + 1) / n
                middle = px[k] + (s - (n - 1) / 2) * wide
                c.box(middle - wide / 2, py[k], middle + wide / 2, bottom, colour), c.whisker(middle, low, high)
            elif kind == "line_plot" and not np.isnan(err[k]):
                c.whisker(px[k], low, high)
        if kind == "line_plot":
            for a, b in zip(mine, mine[1:]):
                c.line(px[a], py[a], px[b], py[b], colour)
        if kind in ("line_plot", "scatter_plot"):
            for k in mine:
                c.disc(px[k], py[k], 3, colour)
    return c.pixels, limits


def plot_images(points_df: DataFrame) -> DataFrame:
    """plot_id, image and limits (x_min, x_max, y_min, y_max) of each plot. A plot's points come together in one row; their number is the plot's own."""
    point = F.struct("series", "i", "x", "y", "err_y")
    per = points_df.groupBy("plot_id", "plot_type").agg(F.array_sort(F.collect_list(point)).alias("p"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for plot_id, kind, rows in pdf.itertuples(index=False):
                s, x, y, e = (np.array([np.nan if r[f] is None else r[f] for r in rows], dtype=float) for f in ("series", "x", "y", "err_y"))
                pixels, limits = drawn(kind, s, x, y, e)
                yield pd.DataFrame({"plot_id": [plot_id], "image": [image_of(pixels)], **{n: [v] for n, v in zip(("x_min", "x_max", "y_min", "y_max"), limits)}})

    return per.mapInPandas(run, f"plot_id long, image {IMAGE}, x_min double, x_max double, y_min double, y_max double")


def calibration(images: DataFrame) -> DataFrame:
    """image_id and, for each axis, pixel_to_data()'s arguments."""
    left, top, right, bottom = FRAME
    axis = lambda a, p0, p1, lo, hi: F.struct(F.lit(a).alias("axis"), F.lit(float(p0)).alias("pixel_min"), F.lit(float(p1)).alias("pixel_max"), F.col(lo).alias("data_min"), F.col(hi).alias("data_max"), F.lit(False).alias("is_log"))
    return images.select(F.col("plot_id").cast("string").alias("image_id"), F.explode(F.array(axis("x", left, right, "x_min", "x_max"), axis("y", bottom, top, "y_min", "y_max"))).alias("a")).select("image_id", "a.*")
