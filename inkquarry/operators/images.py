"""Images: pixels as rows, colour clusters, plot areas, crops and panels.

An image is a struct with height, width, nChannels and data (rows of blue, green, red bytes), as Spark's image source gives it. What looks at all pixels of one image runs in Arrow batches;
what comes of it (bright lines, coordinates, cuts) are rows that DataFrame operators group, rank and join. No image meets another, whatever their number."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkquarry.functions import text as T
from inkquarry.functions.geometry import coloured, hsv
from inkquarry.operators.ordered import bands, digitize
from inkquarry.sources.exports import png

#: Brightness over which a pixel is white, the share of white of an empty line, the least side of an image, pixels of padding, and the bounds of colour clusters.
WHITE, EMPTY_SHARE, LEAST_SIDE, PAD, CLUSTERS, LEAST_PIXELS, LEAST_CLUSTER, ROUNDS = 245, 0.98, 100, 50, 5, 50, 20, 10
IMAGE = "struct<height:int,width:int,nChannels:int,data:binary>"
#: The gradients that an edge has to pass and to reach somewhere, and the tangent of 22.5 degrees, within which an edge counts as upright.
LOW_EDGE, HIGH_EDGE, TANGENT = 50, 150, 0.4142135623730951
DARK = 128


def array_of(image: dict) -> np.ndarray:
    """height x width x 3 bytes in the order blue, green, red; grey images are spread over the three."""
    n = image["nChannels"] or 3
    found = np.frombuffer(image["data"], dtype=np.uint8).reshape(image["height"], image["width"], n)
    return np.repeat(found, 3, axis=2) if n == 1 else found[:, :, :3]


def image_of(pixels: np.ndarray) -> dict:
    return {"height": pixels.shape[0], "width": pixels.shape[1], "nChannels": 3, "data": np.ascontiguousarray(pixels).tobytes()}


def grey_of(pixels: np.ndarray) -> np.ndarray:
    """Brightness 0-255 by the usual weights, rounded."""
    return np.rint(pixels @ np.array([0.114, 0.587, 0.299])).astype(np.int64)


def per_image(df: DataFrame, keys: list[str], f: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """Rows of f(row) for each row; the keys come first in the result. Images go one by one, so memory follows the largest of them."""
    names = [x.split(" ")[0] for x in schema.split(", ")]
    n, kinds = len(keys), {k: df.schema[k].dataType.simpleString() for k in keys}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                found = [(*[row[k] for k in keys], *x) for x in f(row)]
                if found:
                    yield pd.DataFrame(found, columns=[*keys, *names])

    return df.mapInPandas(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], schema])) if n else df.mapInPandas(run, schema)


def pixels_of(images: DataFrame) -> DataFrame:
    """image_id, x, y, b, g, r: one row per pixel."""
    schema = pa.schema([("image_id", pa.string()), *[(c, pa.int32()) for c in "xybgr"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pixels = array_of(image)
                y, x = np.divmod(np.arange(pixels.shape[0] * pixels.shape[1], dtype=np.int32), np.int32(max(1, pixels.shape[1])))
                flat = pixels.reshape(-1, 3).astype(np.int32)
                for lo in range(0, len(flat), 1 << 16):
                    part = [c[lo : lo + (1 << 16)] for c in (x, y, flat[:, 0], flat[:, 1], flat[:, 2])]
                    yield pa.RecordBatch.from_arrays([pa.array([image_id] * len(part[0]), pa.string()), *[pa.array(c) for c in part]], schema=schema)

    return images.where("image is not null").select(F.col("image_id").cast("string"), F.col("image").cast(IMAGE) if not _spark_image(images) else _plain(F.col("image"))).mapInArrow(run, "image_id string, x int, y int, b int, g int, r int")


def _spark_image(df: DataFrame) -> bool:
    return "origin" in df.schema["image"].dataType.names


def _plain(image: Column) -> Column:
    return F.struct(*[image[c].alias(c) for c in ("height", "width", "nChannels", "data")]).alias("image")


def usable_images(images: DataFrame) -> DataFrame:
    return images.where(usable(F.col("image")))


def usable(image: Column) -> Column:
    return F.coalesce((image["width"] > LEAST_SIDE) & (image["height"] > LEAST_SIDE), F.lit(False))


def in_colour_range(pixels: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """Pixels whose hue, saturation and value all lie in the (inclusive) range."""
    c = hsv(F.col("b"), F.col("g"), F.col("r"))
    return pixels.withColumn("_c", c).where(F.col("_c.h").between(low[0], high[0]) & F.col("_c.s").between(low[1], high[1]) & F.col("_c.v").between(low[2], high[2])).drop("_c")


def series_by_colour(pixels: DataFrame, ranges: list[tuple[tuple[int, int, int], tuple[int, int, int]]]) -> tuple[DataFrame, DataFrame]:
    """Coordinates (image_id, series_id, px, py) of the pixels in each range, and per series its representative colour (b, g, r): that of the pixel in the middle of them, which may lie
    outside the range."""
    found = [in_colour_range(pixels, low, high).select("image_id", F.lit(k).alias("series_id"), F.col("x").alias("px"), F.col("y").alias("py")) for k, (low, high) in enumerate(ranges)]
    coords = found[0]
    for more in found[1:]:
        coords = coords.unionByName(more)
    middle = coords.groupBy("image_id", "series_id").agg(F.floor(F.avg("px")).cast("int").alias("x"), F.floor(F.avg("py")).cast("int").alias("y"))
    return coords, middle.join(pixels, ["image_id", "x", "y"]).select("image_id", "series_id", "b", "g", "r")


def clusters(colours: np.ndarray, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The cluster of each colour and the clusters' colours: Lloyd's steps from centres far apart, the same for the same colours in any order."""
    distinct, back, weight = np.unique(colours, axis=0, return_inverse=True, return_counts=True)
    x, centres = distinct.astype(np.float64), [int(np.argmax(weight))]
    far = ((x - x[centres[0]]) ** 2).sum(axis=1)
    while len(centres) < min(k, len(x)):
        centres.append(int(np.argmax(far * np.sqrt(weight))))
        far = np.minimum(far, ((x - x[centres[-1]]) ** 2).sum(axis=1))
    means = x[centres]
    for _ in range(rounds):
        label = ((x[:, None, :] - means[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        size = np.bincount(label, weight, minlength=len(means))
        new = np.stack([np.bincount(label, weight * x[:, c], minlength=len(means)) for c in range(3)], axis=1) / np.maximum(size, 1)[:, None]
        new = np.where(size[:, None] > 0, new, means)
        if np.abs(new - means).max() < 1.0:
            break
        means = new
    label = ((x[:, None, :] - means[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
    return label[back.ravel()], means


def colour_clusters(pixels: DataFrame, k: int = CLUSTERS, least_pixels: int = LEAST_PIXELS, least_cluster: int = LEAST_CLUSTER) -> DataFrame:
    """image_id, x, y, b, g, r, series_id of coloured pixels, by clusters of their own image's colours. Small clusters go, and an image with too few coloured pixels gives none."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        label, _ = clusters(pdf[["b", "g", "r"]].to_numpy(), k) if len(pdf) >= least_pixels else (np.full(len(pdf), -1), None)
        size = np.bincount(label + 1, minlength=2)[1:]
        pdf = pdf.assign(series_id=label.astype("int32"))
        return pdf[(label >= 0) & (size[np.maximum(label, 0)] >= least_cluster)]

    c = pixels.where(coloured(F.col("b"), F.col("g"), F.col("r"))).select("image_id", *[F.col(x).cast("int").alias(x) for x in ("x", "y", "b", "g", "r")])
    return c.groupBy("image_id").applyInPandas(one, "image_id string, x int, y int, b int, g int, r int, series_id int")


def largest_dark_box(grey: np.ndarray, dark: int = DARK) -> tuple[int, int, int, int] | None:
    """x, y, width, height of the connected dark region (neighbours in eight directions) whose box is largest; None if nothing is dark.

    Runs of dark pixels of each row are nodes; runs of neighbouring rows that touch are joined."""
    mask = np.zeros((grey.shape[0], grey.shape[1] + 2), dtype=np.int8)
    mask[:, 1:-1] = grey < dark
    step = np.diff(mask, axis=1)
    row, start = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    if not len(row):
        return None
    first, up = np.searchsorted(row, np.arange(grey.shape[0] + 1)), np.arange(len(row))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for y in range(1, grey.shape[0]):
        a, b = first[y - 1], first[y]
        while a < first[y] and b < first[y + 1]:
            if start[a] <= end[b] and start[b] <= end[a]:
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
            if end[a] < end[b]:
                a += 1
            else:
                b += 1
    label = np.array([root(k) for k in range(len(row))])
    lo_x, hi_x, lo_y, hi_y = (np.full(len(row), v) for v in (1 << 30, -1, 1 << 30, -1))
    np.minimum.at(lo_x, label, start), np.maximum.at(hi_x, label, end), np.minimum.at(lo_y, label, row), np.maximum.at(hi_y, label, row + 1)
    area = np.where(hi_x > 0, (hi_x - lo_x) * (hi_y - lo_y), -1)
    best = int(np.argmax(area))
    return int(lo_x[best]), int(lo_y[best]), int(hi_x[best] - lo_x[best]), int(hi_y[best] - lo_y[best])


def edge_map(grey: np.ndarray, low: int = LOW_EDGE, high: int = HIGH_EDGE) -> np.ndarray:
    """Edges after Canny (1986): where the gradient (3 x 3 differences, sum of both directions) is largest across the edge and over `low`, and connected to one over `high`."""
    g = np.pad(grey.astype(np.int64), 1, mode="edge")
    rows, columns = g[:-2] + 2 * g[1:-1] + g[2:], g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]
    gx, gy = rows[:, 2:] - rows[:, :-2], columns[2:] - columns[:-2]
    size = np.abs(gx) + np.abs(gy)
    m = np.pad(size, 1)
    around = lambda dy, dx: m[1 + dy : m.shape[0] - 1 + dy, 1 + dx : m.shape[1] - 1 + dx]
    ax, ay, same = np.abs(gx), np.abs(gy), (gx < 0) == (gy < 0)
    flat, steep = ay < ax * TANGENT, ay > ax / TANGENT
    # of two equal neighbours across an edge, the first one counts
    peak = np.where(
        flat, (size > around(0, -1)) & (size >= around(0, 1)),
        np.where(steep, (size > around(-1, 0)) & (size >= around(1, 0)), np.where(same, (size > around(-1, -1)) & (size > around(1, 1)), (size > around(-1, 1)) & (size > around(1, -1)))),
    )
    weak = peak & (size > low)
    label, n = connected(weak)
    strong = np.zeros(n, dtype=bool)
    strong[label[weak & (size > high)]] = True
    return weak & strong[label]


def connected(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each pixel: 0 off the mask, else that of its region (neighbours in eight directions), and how many numbers there are."""
    at = np.flatnonzero(mask)
    place = np.full(mask.size + 1, -1, dtype=np.int64)
    place[at] = np.arange(len(at))
    h, w = mask.shape
    y, x = np.divmod(at, max(w, 1))
    up = np.arange(len(at))
    pairs = []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        inside = (y + dy < h) & (x + dx >= 0) & (x + dx < w)
        other = place[at[inside] + dy * w + dx]
        pairs.append(np.stack((np.flatnonzero(inside)[other >= 0], other[other >= 0])))
    u, v = np.concatenate(pairs, axis=1)
    while len(u):
        a, b = up[u], up[v]
        apart = a != b
        u, v = u[apart], v[apart]
        np.minimum.at(up, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up, higher := up[up]):
            up = higher
    roots, number = np.unique(up, return_inverse=True)
    label = np.zeros(mask.size, dtype=np.int64)
    label[at] = number + 1
    return label.reshape(mask.shape), len(roots) + 1


#: The eight neighbours of a pixel (down, right), clockwise from the left one.
CLOCKWISE = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def outer_border(label: np.ndarray, number: int, y: int, x: int) -> list[tuple[int, int]]:
    """The pixels around a region, from its first one (the leftmost of its top row) clockwise until the first step would be taken again."""
    h, w = label.shape
    mine = lambda a, b: 0 <= a < h and 0 <= b < w and label[a, b] == number
    border, start, came = [(y, x)], (y, x), 0
    first = None
    while True:
        for k in range(1, 9):
            d = (came + k) % 8
            if mine(y + CLOCKWISE[d][0], x + CLOCKWISE[d][1]):
                break
        else:
            return border
        if (y, x) == start:
            if first == d:
                return border[:-1]
            first = d if first is None else first
        y, x = y + CLOCKWISE[d][0], x + CLOCKWISE[d][1]
        border.append((y, x))
        came = (d + 4) % 8  # the neighbour that it was entered from


def polygon_area(border: list[tuple[int, int]]) -> float:
    p = np.array(border, dtype=np.int64)
    q = np.roll(p, -1, axis=0)
    return abs(int((p[:, 1] * q[:, 0] - q[:, 1] * p[:, 0]).sum())) / 2


def largest_outline(grey: np.ndarray) -> tuple[int, int, int, int] | None:
    """x, y, width, height of the edge whose outline encloses the largest area, of equal ones the first; None without edges. What lies inside another outline encloses less than it, so all edges may compete."""
    label, n = connected(edge_map(grey))
    if n == 1:
        return None
    numbers, first = np.unique(label, return_index=True)
    lo_y, lo_x, hi_y, hi_x = (np.full(n, v) for v in (1 << 30, 1 << 30, -1, -1))
    y, x = np.nonzero(label)
    of = label[y, x]
    np.minimum.at(lo_y, of, y), np.minimum.at(lo_x, of, x), np.maximum.at(hi_y, of, y), np.maximum.at(hi_x, of, x)
    best, most = 0, -1.0
    for number, at in sorted(zip(numbers[numbers > 0].tolist(), first[numbers > 0].tolist()), key=lambda k: -(hi_y[k[0]] - lo_y[k[0]]) * (hi_x[k[0]] - lo_x[k[0]])):
        if (hi_y[number] - lo_y[number]) * (hi_x[number] - lo_x[number]) < most:
            break  # an outline encloses no more than its box
        area = polygon_area(outer_border(label, number, *divmod(at, label.shape[1])))
        if area > most or (area == most and number < best):
            best, most = number, area
    return int(lo_x[best]), int(lo_y[best]), int(hi_x[best] - lo_x[best] + 1), int(hi_y[best] - lo_y[best] + 1)


def plot_areas(images: DataFrame, by: str = "dark") -> DataFrame:
    """image_id, x, y, w, h of each image's plot, as the frame of a plot is: the box of its largest dark connected region, or with by="edges" of the edge with the largest outline, which
    also finds frames that are tinted, pale or drawn on a dark ground. Images without any are left out."""
    largest = {"dark": largest_dark_box, "edges": largest_outline}[by]
    found = lambda row: [b for b in [largest(grey_of(array_of(row["image"])))] if b]
    return per_image(images.where("image is not null").select("image_id", _plain(F.col("image"))), ["image_id"], found, "x int, y int, w int, h int")


def auto_digitize(images: DataFrame, calibration: DataFrame, gap: float = 5, by: str = "dark") -> DataFrame:
    """image_id, series_id, x, y: colours inside the plot area (the whole image where there is none) as series, their columns of pixels as points."""
    p, area = pixels_of(images), plot_areas(images, by).select(F.col("image_id").cast("string").alias("image_id"), F.struct("x", "y", "w", "h").alias("box"))
    inside = F.col("box").isNull() | (F.col("x").between(F.col("box.x"), F.col("box.x") + F.col("box.w") - 1) & F.col("y").between(F.col("box.y"), F.col("box.y") + F.col("box.h") - 1))
    c = colour_clusters(p.join(area, "image_id", "left").where(inside).drop("box"))
    return digitize(c.select("image_id", "series_id", F.col("x").alias("px"), F.col("y").alias("py")), calibration, gap=gap)


def crop(image: dict, x0: float, y0: float, x1: float, y1: float) -> dict | None:
    """The part of an image inside a box, as far as it reaches; None if nothing is left."""
    pixels = array_of(image)
    h, w = pixels.shape[:2]
    x0, x1 = max(0, round(x0)), min(w, round(x1))
    y0, y1 = max(0, round(y0)), min(h, round(y1))
    return image_of(pixels[y0:y1, x0:x1]) if x1 > x0 and y1 > y0 else None


def cropped(df: DataFrame, keys: list[str], dpi: int = 300, pad: int = PAD) -> DataFrame:
    """keys and the part of `image`, a page rendered at dpi, inside `bounding_box` (x, y, w, h in points) with `pad` pixels around it."""
    scale = dpi / 72

    def one(row) -> list[tuple]:
        b = row["bounding_box"]
        found = crop(row["image"], b["x"] * scale - pad, b["y"] * scale - pad, (b["x"] + b["w"]) * scale + pad, (b["y"] + b["h"]) * scale + pad)
        return [(found,)] if found else []

    return per_image(df.where("image is not null and bounding_box is not null").select(*keys, _plain(F.col("image")), "bounding_box"), keys, one, f"image {IMAGE}")


def png_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and `png`, the image as a PNG file."""
    return per_image(df.where("image is not null").select(*keys, _plain(F.col("image"))), keys, lambda row: [(png(array_of(row["image"])),)], "png binary")


def bright_lines(images: DataFrame, key: str = "image_id") -> DataFrame:
    """key, axis and position of lines that are white but for 2 % at most: rows (axis 'y') and columns ('x')."""

    def one(row) -> list[tuple]:
        white = grey_of(array_of(row["image"])) > WHITE
        return [(axis, int(k)) for axis, n in (("y", 1), ("x", 0)) for k in np.flatnonzero(white.sum(axis=n) >= EMPTY_SHARE * white.shape[n])]

    return per_image(images.where("image is not null").select(key, _plain(F.col("image"))), [key], one, "axis string, position int")


def panel_cuts(lines: DataFrame, panels: DataFrame, key: str = "image_id") -> DataFrame:
    """key, axis and cuts (array, ascending) of images that can be cut into `panels` parts: at the middles of the widest runs of bright lines, rows first, else columns. panels: key, panels."""
    b = bands(lines, [key, "axis"], "position").join(panels, key)
    order = Window.partitionBy(key, "axis").orderBy(F.desc("width"), "first")
    top = b.withColumn("_r", F.row_number().over(order)).where("_r < panels").withColumn("cut", F.expr("cast((first + last) div 2 as int)"))
    found = top.groupBy(key, "axis", "panels").agg(F.sort_array(F.collect_list("cut")).alias("cuts")).where("size(cuts) = panels - 1")
    # of both ways the rows: 'y' is the larger name
    return found.groupBy(key).agg(F.max(F.struct("axis", "cuts")).alias("c")).select(key, "c.*")


def panels_of(figures: DataFrame, key: str = "figure_id") -> DataFrame:
    """key, panel_label, caption, image of the panels of figures (key, caption, image): one row without a label where the caption names fewer than two panels, or the image can't be cut
    into as many. Parts that are too small are dropped."""
    labelled = figures.select(key, F.coalesce("caption", F.lit("")).alias("caption"), "image", T.panel_labels(F.coalesce("caption", F.lit(""))).alias("labels"))
    several = labelled.where("size(labels) >= 2 and image is not null")
    cuts = panel_cuts(bright_lines(several, key), several.select(key, F.size("labels").alias("panels")), key)

    def one(row) -> list[tuple]:
        pixels = array_of(row["image"])
        ends = [0, *row["cuts"], pixels.shape[0] if row["axis"] == "y" else pixels.shape[1]]
        parts = [pixels[a:b] if row["axis"] == "y" else pixels[:, a:b] for a, b in zip(ends, ends[1:])]
        return [(label, image_of(part)) for label, part in zip(row["labels"], parts)]

    parts = per_image(several.join(cuts, key).select(key, _plain(F.col("image")), "labels", "axis", "cuts"), [key], one, f"panel_label string, image {IMAGE}")
    split = parts.where(usable(F.col("image"))).join(labelled.select(key, "caption"), key).select(key, "panel_label", T.panel_caption(F.col("caption"), F.col("panel_label")).alias("caption"), "image")
    whole = labelled.join(cuts.select(key), key, "left_anti").select(key, F.lit("").alias("panel_label"), "caption", F.when(F.col("image").isNotNull(), _plain(F.col("image"))).alias("image"))
    return whole.unionByName(split)
