"""Boxes, axes and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_of(corners: Column) -> Column:
    """[x1, y1, x2, y2] as struct(x, y, w, h); null unless there are four numbers."""
    x1, y1, x2, y2 = (F.get(corners, F.lit(k)) for k in range(4))
    return F.when(F.size(corners) == 4, F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h")))


def large_enough(w: Column, h: Column, dpi: int = 300, least: float = 10_000) -> Column:
    return w * h * (dpi / 72) ** 2 >= least


def source_confidence(source: Column, is_panel: Column) -> Column:
    return F.when(source == "pdffigures2", 0.95).otherwise(0.8) * F.when(is_panel, 0.95).otherwise(1.0)


def pixel_to_data(px: Column, pixel_min: Column, pixel_max: Column, data_min: Column, data_max: Column, is_log: Column) -> Column:
    """Linear or log10 interpolation; a degenerate axis gives data_min, a log axis without positive ends null."""
    t = (px - pixel_min) / F.nullif(pixel_max - pixel_min, F.lit(0.0))
    low, high = F.when(data_min > 0, F.log10(data_min)), F.when(data_max > 0, F.log10(data_max))
    return F.when(pixel_max == pixel_min, data_min).when(is_log, F.pow(F.lit(10.0), low + t * (high - low))).otherwise(data_min + t * (data_max - data_min))


def coloured(b: Column, g: Column, r: Column) -> Column:
    """Neither near white nor near black."""
    return (b < 230) & (g < 230) & (r < 230) & (b > 30) & (g > 30) & (r > 30)


def hsv(b: Column, g: Column, r: Column) -> Column:
    """Hue 0-180, saturation and value 0-255."""
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    d = F.nullif((top - low).cast("double"), F.lit(0.0))
    hue = F.when(top == r, F.pmod((g - b) / d, F.lit(6.0))).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 30
    return F.struct(F.coalesce(F.round(hue), F.lit(0.0)).cast("int").alias("h"), F.when(top > 0, F.round(255 * (top - low) / top)).otherwise(0).cast("int").alias("s"), top.cast("int").alias("v"))
