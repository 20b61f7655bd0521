"""What models answer, as text, into declared structs: from_json with fallbacks, then the rules of figure types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkquarry.functions.text import let

#: The taxonomy in order, the extraction strategy of each type, and what counts where an answer can't be read.
FIGURE_TYPES = ("line_plot", "bar_chart", "scatter_plot", "heatmap", "spectrum_nmr", "spectrum_ir", "spectrum_ms", "western_blot", "microscopy", "table", "diagram", "other")
STRATEGIES = {
    "line_plot": "plot_digitizer", "scatter_plot": "plot_digitizer", "bar_chart": "bar_extractor", "heatmap": "heatmap_extractor", "spectrum_nmr": "spectrum_extractor",
    "spectrum_ir": "spectrum_extractor", "spectrum_ms": "spectrum_extractor", "western_blot": "gel_extractor", "microscopy": "microscopy_extractor", "flowchart": "description_only",
    "other": "description_only",
}
FALLBACK_REASONING = "Classification failed — defaulting to 'other'."
LEAST_CONFIDENCE, SERIES_CONFIDENCE, THRESHOLD = 0.3, 0.5, 0.7
#: The taxonomy has no flow charts, the prompt and the strategies have: here they are diagrams.
ALIASES = {"flowchart": "diagram"}
NOT_QUANTITATIVE = ("microscopy", "diagram")
CLASS_SCHEMA = "struct<figure_type:string,confidence:string,reasoning:string,has_quantitative_data:boolean,sub_types:array<string>>"
POINT = "struct<x:double,y:double,err_x:double,err_y:double>"
SERIES_SCHEMA = (
    f"array<struct<series_name:string,x_label:string,x_unit:string,y_label:string,y_unit:string,data_points:array<{POINT}>,axis_scale_x:string,axis_scale_y:string,"
    "statistical_annotations:array<struct<marker:string,x:double,p_value:double>>,confidence:double>>"
)


def unfenced(raw: Column) -> Column:
    """Without code fences, and without white space and back quotes at the ends."""
    return F.regexp_replace(F.regexp_replace(raw, r"```(?:json)?", ""), r"^[\s`]+|[\s`]+$", "")


def parse_object(raw: Column, schema: str) -> Column:
    """A struct from an answer: as it stands, else its widest {...}; null if neither parses."""

    def parsed(s: Column) -> Column:
        direct = F.when(s.startswith("{"), F.from_json(s, schema))
        return F.coalesce(direct, F.from_json(F.nullif(F.regexp_extract(s, r"(?s)\{.*\}", 0), F.lit("")), schema))

    return let(unfenced(raw), parsed)


def parse_array(raw: Column, schema: str = SERIES_SCHEMA) -> Column:
    """An array from an answer's widest [...], without what is no object; empty if there is none. A lone object is no array."""
    found = F.from_json(F.nullif(F.regexp_extract(unfenced(raw), r"(?s)\[.*\]", 0), F.lit("")), "array<string>")
    objects = F.transform(F.filter(found, lambda x: x.startswith("{")), lambda x: F.from_json(x, schema.removeprefix("array<").removesuffix(">")))
    return F.coalesce(F.filter(objects, lambda x: x.isNotNull()), F.array().cast(schema))


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def known_type(raw: Column) -> Column:
    """The taxonomy's type: itself, an alias, else the first one that the answer contains, else other."""
    low = F.lower(F.trim(raw))
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    inside = F.get(F.filter(F.array(*map(F.lit, FIGURE_TYPES)), lambda t: F.contains(low, t)), F.lit(0))
    return F.coalesce(F.when(low.isin(*FIGURE_TYPES), low), F.try_element_at(alias, low), inside, F.lit("other"))


def classified(raw: Column, threshold: float = THRESHOLD) -> Column:
    """figure_type, confidence, reasoning, has_quantitative_data, sub_types of an answer; types under the threshold become other and keep their score. An answer that can't be read, an
    empty object, or a confidence that is no number gives the fallback: other, 0, not quantitative."""
    none = F.array().cast("array<string>")
    as_struct = lambda kind, score, why, data, sub: F.struct(kind.alias("figure_type"), score.alias("confidence"), why.alias("reasoning"), data.alias("has_quantitative_data"), sub.alias("sub_types"))
    fallback = as_struct(F.lit("other"), F.lit(0.0), F.lit(FALLBACK_REASONING), F.lit(False), none)

    def ruled(x: Column) -> Column:
        score = F.coalesce(clamp(x["confidence"].try_cast("double")), F.lit(LEAST_CONFIDENCE))
        unread = x.isNull() | (x["confidence"].isNotNull() & x["confidence"].try_cast("double").isNull())
        kind = F.when(score < threshold, "other").otherwise(known_type(x["figure_type"]))
        data = F.coalesce(x["has_quantitative_data"], ~kind.isin(*NOT_QUANTITATIVE))
        return F.when(unread, fallback).otherwise(as_struct(kind, score, F.coalesce(x["reasoning"], F.lit("")), data, F.coalesce(x["sub_types"], none)))

    empty = unfenced(raw).rlike(r"^\{\s*\}$")
    return let(F.when(~empty, parse_object(raw, CLASS_SCHEMA)), ruled)


def strategy(figure_type: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in STRATEGIES.items() for x in pair]), figure_type), F.lit("description_only"))
