"""Documents to stored papers, figures, series and errors: one lazy plan between the Python boundaries, written after each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkquarry.config import Settings
from inkquarry.functions.geometry import large_enough, source_confidence
from inkquarry.functions.model_json import SERIES_CONFIDENCE, classified, parse_array
from inkquarry.functions.text import let, safe_name, stem
from inkquarry.operators.context import build_contexts, papers_from_pages, surrounding_text, title_of_first_page
from inkquarry.operators.images import IMAGE, cropped, panels_of, png_of, usable
from inkquarry.schemas import ANNOTATION, POINT
from inkquarry.sources.files import first_source, infer, page_texts, parse, text_spans
from inkquarry.sources.store import Store, Transaction
from inkquarry.staging import kept

#: A page without figures and with more drawings than this is a figure itself.
VECTOR_PATHS = 30
#: What the model is told and asked of each figure's type, in words of our own; the types are those that classified() knows.
CLASS_SYSTEM = "You sort figures of scientific papers by their type. You reply with one JSON object and nothing else."
CLASS_PROMPT = """Which type is this figure of? Reply with one JSON object that has these keys:
  figure_type: one of line_plot, bar_chart, scatter_plot, heatmap, spectrum_nmr, spectrum_ir, spectrum_ms, western_blot, microscopy, flowchart, other
  confidence: how sure you are, from 0.0 to 1.0
  reasoning: one sentence that names what you see
  has_quantitative_data: true if numbers can be read off it, else false
  sub_types: a list of finer types, or an empty list

How to tell the types apart:
  line_plot has points joined by lines over two axes (courses over time, doses, rates); scatter_plot has two axes and unjoined points
  bar_chart has bars or columns, also grouped or stacked ones; heatmap is a grid of cells whose colours stand for values
  spectrum_nmr has a ppm axis and narrow peaks, spectrum_ir (also Raman) an axis of wavenumbers in cm-1, spectrum_ms an m/z axis with intensities
  western_blot shows dark bands in lanes and has no axes with numbers; microscopy is a picture of a specimen, perhaps with a scale bar
  flowchart is any drawing of steps or parts without numbers; other is all else, such as pies, boxes, violins, survival and ROC curves
Axes with numbers mean has_quantitative_data is true. Where two types seem possible, take the likelier and name the other in reasoning."""
METHOD = "gemma4_multimodal"


def figures_of(parsed: DataFrame, settings: Settings, primary: DataFrame | None = None) -> DataFrame:
    """paper_id, ord, figure_number, page_number, caption, x1, y1, x2, y2, source, image of the figures of parsed documents.

    Figures of the parser that are too small go; a page that then has none and many drawings is a figure as a whole. Where `primary`, parsed figures of another extractor, has any for a
    document, they take the place of the parser's. Figures without a number are counted in the order of pages."""
    of = lambda df: df.select(F.col("path").alias("paper_id"), F.posexplode("figures").alias("ord", "f")).select("paper_id", "ord", "f.*")
    size = large_enough(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), settings.image_dpi, settings.least_figure_area)
    raster = of(parsed).where(F.coalesce(size, F.lit(True)))
    pages = parsed.select(F.col("path").alias("paper_id"), F.posexplode("page_info").alias("page_idx", "i")).where(F.col("i.n_paths") > VECTOR_PATHS).withColumn("page_number", F.col("page_idx") + 1)
    vector = pages.join(raster.select("paper_id", "page_number").distinct(), ["paper_id", "page_number"], "left_anti").select(
        "paper_id", F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("figure_number"), "page_number", F.lit("").alias("caption"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"),
        F.col("i.width").alias("x2"), F.col("i.height").alias("y2"), F.lit("vector").alias("source"), F.col("i.image").alias("image"),
    )
    found = raster.unionByName(vector)
    if primary is not None:
        found = first_source(of(primary), found, "paper_id")
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("page_number", F.col("ord").asc_nulls_last(), "figure_number"))
    found = found.withColumn("ord", place - 1).withColumn("figure_number", F.coalesce("figure_number", place.cast("string")))
    return found.where(F.col("ord") < settings.most_figures) if settings.most_figures else found


def with_crops(figures: DataFrame, parsed: DataFrame, dpi: int) -> DataFrame:
    """Figures that come without an image get their part of the page's rendering, where there is one."""
    lacking = figures.where("image is null and x2 is not null").select("paper_id", "ord", "page_number", box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("bounding_box"))
    pages = parsed.select(F.col("path").alias("paper_id"), F.posexplode("page_info").alias("page_idx", "i")).select("paper_id", (F.col("page_idx") + 1).alias("page_number"), F.col("i.image").alias("image"))
    crops = cropped(lacking.join(pages.where("image is not null"), ["paper_id", "page_number"]), ["paper_id", "ord"], dpi).withColumnRenamed("image", "crop")
    return figures.join(crops, ["paper_id", "ord"], "left").withColumn("image", F.coalesce("image", "crop")).drop("crop")


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"))


def process(
    files: DataFrame, store: Store, parser: Callable, classify: Callable, extract: Callable, threshold: float | None = None, most_figures: int | None = None, mode: str = "rich",
    primary: Callable | DataFrame | None = None, settings: Settings | None = None, require_image: bool = False, batch: tuple[str, int] | None = None,
) -> dict[str, DataFrame]:
    """files: path, content. Every document that can't be parsed and every figure that a model gave no answer for is a row of errors.

    Figures are split into panels where their images allow it, and keyed by figure and panel through all steps, so panels never share their series. Images too small to be figures go;
    figures without an image take it from the page's rendering; without that too, they are asked about by their texts alone, or with require_image give no series. mode: as in
    build_contexts. primary: another figure extractor (bytes to a parser's dict, or its output as in extractor_output, or keyed by path), used where it gives figures; output under a stem
    that several documents have is nobody's. most_figures, if given, keeps only the first ones of a paper.

    Papers, figures, series and errors go into the store in one transaction; batch, as in Store.transact, is taken once."""
    spark = store.spark
    settings = settings or Settings.of(spark)
    if most_figures is not None:
        settings = Settings(**{**settings.__dict__, "most_figures": most_figures})
    threshold = settings.confidence_threshold if threshold is None else threshold
    store.init()
    if batch and store.has_batch(batch):
        now = store.snapshot()
        return {t: now.read(t) for t in ("papers", "figures", "series", "errors")}
    parsed = kept(parse(files, parser), "parsed")
    good = parsed.where("error is null")
    pages = page_texts(good)
    info = good.select(F.col("path").alias("paper_id"), "title", "author", "creator", "producer")
    titles = title_of_first_page(text_spans(good)).withColumnRenamed("title", "sniffed_title")
    papers = kept(papers_from_pages(pages, info.join(titles, "paper_id", "left")), "papers")
    if isinstance(primary, DataFrame):
        if "path" not in primary.columns:
            names = parsed.select("path", stem(F.col("path")).alias("stem")).groupBy("stem").agg(F.min("path").alias("path"), F.count("*").alias("n")).where("n = 1")
            primary = names.join(primary, "stem")
        better = good.select("path").join(primary.select("path", "figures"), "path")
    else:
        better = None if primary is None else kept(parse(files, primary), "primary")
    whole = with_crops(figures_of(good, settings, better), good, settings.image_dpi)
    whole = whole.where(F.col("image").isNull() | usable(F.col("image"))).withColumn("key", F.concat_ws("#", "paper_id", "ord"))
    parts = panels_of(whole.select(F.col("key").alias("figure_id"), "caption", F.col("image").cast(IMAGE).alias("image"))).select(F.col("figure_id").alias("key"), "panel_label", "caption", "image")
    raw = whole.drop("caption", "image").join(parts, "key").withColumn("figure_id", F.concat_ws("#", "key", F.nullif("panel_label", F.lit(""))))
    raw = kept(raw, "figures")
    files_png = png_of(raw, ["figure_id"])
    asked = raw.drop("image").join(files_png, "figure_id", "left").withColumn("prompt", F.concat(F.lit("Figure caption: "), F.coalesce("caption", F.lit("")), F.lit("\n\n" + CLASS_PROMPT)))
    how = {"image": "png", "attempts": settings.model_attempts, "memo": settings.answers_folder or None, "calls": settings.model_calls}
    asked = kept(infer(asked, classify, out="class_answer", **how), "classified")
    figures = asked.withColumn("c", classified(F.col("class_answer"), threshold)).withColumn("figure_type", F.col("c.figure_type")).drop("prompt", "class_answer", "class_answer_error")
    contexts = build_contexts(surrounding_text(figures, pages), papers, mode)
    worth = contexts.where("c.has_quantitative_data" + (" and png is not null" if require_image else ""))
    answered = kept(infer(worth, extract, **how), "extracted")

    problem = lambda df, kind, path, message: df.select(F.lit(kind).alias("error_type"), F.concat_ws(": ", path, message).alias("error_message"))
    errors = problem(parsed.where("error is not null"), "parse", "path", "error").unionByName(problem(asked.where("class_answer_error is not null"), "classify", "figure_id", "class_answer_error"))
    errors = kept(errors.unionByName(problem(answered.where("answer_error is not null"), "extract", "figure_id", "answer_error")).distinct(), "errors")
    series = kept(answered.where("answer is not null").select("figure_id", F.posexplode(let(F.col("answer"), lambda a: parse_array(a))).alias("ord", "s")), "series")

    def change(t: Transaction) -> None:
        t.upsert_papers(papers.select(F.col("paper_id").alias("pdf_path"), "doi", "title", "authors", "journal", "year"))
        ids = t.read("papers").select(F.col("id").alias("pid"), F.col("pdf_path").alias("paper_id")).join(papers.select("paper_id"), "paper_id")
        # each figure's id in the store is found by its place among those of its paper, never by a number that two may share
        rows = figures.join(ids, "paper_id").select(
            F.col("pid").alias("paper_id"), "figure_number", "panel_label", "page_number", "figure_type", "caption", F.when(F.col("png").isNotNull(), image_name(F.col("pid"), F.col("ord"), F.col("panel_label"))).alias("image_path"),
            box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("bounding_box"), source_confidence(F.col("source"), F.col("panel_label") != "").alias("confidence_score"),
            F.current_timestamp().alias("processed_at"), F.col("figure_id").alias("source_key"),
        )
        t.replace_figures_of(ids.select(F.col("pid").alias("paper_id")), rows)
        keys = t.read("figures").select(F.col("id").alias("figure_key"), "source_key")
        t.append("series", series.join(keys, F.col("figure_id") == F.col("source_key")).select(
            F.col("figure_key").alias("figure_id"), "ord", *[F.coalesce(f"s.{c}", F.lit("")).alias(c) for c in ("series_name", "x_label", "x_unit", "y_label", "y_unit")],
            F.coalesce("s.data_points", F.array().cast(f"array<{POINT}>")).alias("data_points"), *[F.coalesce(f"s.{c}", F.lit("linear")).alias(c) for c in ("axis_scale_x", "axis_scale_y")],
            F.coalesce("s.statistical_annotations", F.array().cast(f"array<{ANNOTATION}>")).alias("statistical_annotations"), F.lit(METHOD).alias("extraction_method"), F.coalesce("s.confidence", F.lit(SERIES_CONFIDENCE)).alias("confidence_score"),
        ), ["figure_id", "ord"])
        # a batch that is run again names the same errors, which are there already
        fresh = errors.join(t.read("errors").select("error_type", "error_message"), ["error_type", "error_message"], "left_anti")
        t.append("errors", fresh.select(F.lit(None).cast("long").alias("figure_id"), "error_type", "error_message", F.current_timestamp().alias("timestamp")), ["error_type", "error_message"])

    store.transact(change, batch)
    now = store.snapshot()
    return {t: now.read(t) for t in ("papers", "figures", "series", "errors")} | {"images": files_png}


def image_name(paper: Column, ord: Column, panel: Column) -> Column:
    """Where a figure's image lies below the folder of outputs: papers apart, by the figure's place in its paper and its panel."""
    return F.concat(F.lit("figures/"), paper, F.lit("/"), F.lpad(ord.cast("string"), 4, "0"), F.when(panel != "", F.concat(F.lit("_"), safe_name(panel))).otherwise(F.lit("")), F.lit(".png"))
