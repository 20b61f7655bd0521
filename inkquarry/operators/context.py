"""Figures in their text: mentions, sections, scored sentences, summaries and prompts. One plan for all figures of all papers."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkquarry.functions import text as T

#: Limits in characters, names of sections, labels of the summary and lines of the prompt.
REFS, REF_WINDOW, SECTION_CHARS, SUMMARY_CHARS, SURROUNDING_CHARS, PART_CHARS = 3, 300, 1000, 3000, 1500, 500
METHODS = ("methods", "method", "materials and methods", "materials & methods", "experimental", "experimental section")
RESULTS = ("results", "results and discussion")
#: What mentions of figures start with, whatever follows; T.figure_pattern() decides.
MAY_MENTION = re.compile(r"Fig(?:ure|s)?\.{0,2}\s*", re.IGNORECASE)
LABELS = ("FIGURE CAPTION: ", "IN-TEXT DESCRIPTION: ", "METHODS CONTEXT: ", "RESULTS CONTEXT: ")
TASK = """=== TASK ===
Extract ALL numerical data from this figure image.
For each data series output a JSON object with keys:
  series_name, x_label, x_unit, y_label, y_unit,
  axis_scale_x (linear|log), axis_scale_y (linear|log),
  data_points ([{x, y, err_x, err_y},...]),
  statistical_annotations ([{marker, x, p_value},...]).
Output a JSON array of series objects. No extra text."""


def papers_from_pages(pages: DataFrame, info: DataFrame) -> DataFrame:
    """One row per paper from pages (paper_id, page_idx, text) and info (paper_id, title, author, creator, producer; sniffed_title if there is one): metadata with fallbacks from the text."""
    full = pages.groupBy("paper_id").agg(F.count("*").alias("page_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "text"))), lambda p: p["text"]), "\n\n").alias("full_text"))
    j = full.join(info, "paper_id", "left")
    return j.select(
        "paper_id", F.coalesce(F.nullif("title", F.lit("")), F.col("sniffed_title") if "sniffed_title" in info.columns else F.lit(None)).alias("title"), F.coalesce(T.authors(F.col("author")), F.array().cast("array<string>")).alias("authors"), T.journal(F.col("creator"), F.col("producer")).alias("journal"),
        T.doi(F.col("full_text")).alias("doi"), T.mode_first_seen(T.years(F.col("full_text"))).alias("year"), T.abstract(F.col("full_text")).alias("abstract"), "page_count", "full_text",
    )


def mention_windows(text: Column, longest: int) -> Column:
    """Places that may mention a figure, found in one pass over a text: array of (tail, gap, window). tail: the character before "Fig" (a newline at the start of the text) and what follows
    it, as far as a number of `longest` characters and one more may reach; window: the text from REF_WINDOW before to REF_WINDOW behind that, and gap: where "Fig" is in it."""

    def one(t: str) -> list[tuple]:
        out = []
        for m in MAY_MENTION.finditer(t):
            lo, end = max(m.start() - REF_WINDOW, 0), m.end() + longest + 1
            out.append(((t[m.start() - 1] if m.start() else "\n") + t[m.start() : end], m.start() - lo, t[lo : end + REF_WINDOW]))
        return out

    return T.scanned(F.coalesce(text, F.lit("")), {"tail": pa.string(), "gap": pa.int32(), "window": pa.string()}, one)


def mention_length(tail: Column, number: Column) -> Column:
    """How long the mention of a figure at a place is; 0 if it is of another one. number must be a column, so the pattern is made per row."""
    return F.length(F.call_function("regexp_extract", tail, F.concat(F.lit("(?s)^."), T.figure_pattern(number)), F.lit(0))) - 1


def mentions(windows: Column, number: Column) -> Column:
    """Snippets around all mentions of a figure, longest first, without near repeats, at most REFS."""
    snippet = lambda w: F.regexp_replace(T.strip(F.substring(w["window"], F.lit(1), w["gap"] + mention_length(w["tail"], number) + REF_WINDOW)), "\n", " ")
    return T.let(F.transform(F.filter(windows, lambda w: mention_length(w["tail"], number) > 0), snippet), lambda s: T.greedy_distinct(s, 0.6, REFS))


def scored_sentences(text: Column, caption: Column, number: Column, most: int = SECTION_CHARS) -> Column:
    """Sentences by keyword hits (plus 2 for a mention of the figure), best first, while they fit the budget."""
    return best_sentences(T.sentences(text), caption, number, most)


def best_sentences(sentences: Column, caption: Column, number: Column, most: int = SECTION_CHARS) -> Column:
    """The same for an array of sentences. A sentence that doesn't fit ends the list."""

    def rank(words: Column) -> Column:
        return F.transform(sentences, lambda s, i: F.struct((-(T.keyword_hits(s, words) + F.when(F.rlike(s, T.figure_pattern(number)), 2).otherwise(0))).alias("score"), i.alias("i"), s.alias("s")))

    ranked = F.array_sort(F.filter(T.let(T.keywords(caption), rank), lambda r: r["score"] < 0))
    fold = F.aggregate(
        ranked, F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("out")),
        lambda acc, r: F.when(acc["full"] | (acc["n"] + F.length(r["s"]) > most), F.struct(acc["n"].alias("n"), F.lit(True).alias("full"), acc["out"].alias("out"))).otherwise(
            F.struct((acc["n"] + F.length(r["s"])).alias("n"), F.lit(False).alias("full"), F.array_append(acc["out"], r["s"]).alias("out"))
        ),
    )
    return T.strip(F.array_join(fold["out"], " "))


def section_body(sections: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.get(F.filter(sections, lambda s: F.lower(s["name"]).isin(*names)), F.lit(0))["body"], F.lit(""))


def mention_paragraphs(text: Column, paragraphs: Column, number: Column) -> Column:
    """Paragraphs that mention the figure, else the beginning, within SECTION_CHARS."""
    chosen = lambda hit: F.when(F.size(hit) > 0, F.array_join(F.transform(hit, T.strip), "\n\n")).otherwise(text)
    return T.strip(F.substring(T.let(F.filter(paragraphs, lambda p: F.rlike(p, T.figure_pattern(number))), chosen), 1, SECTION_CHARS))


def figure_contexts(figures: DataFrame, papers: DataFrame) -> DataFrame:
    """paper_id, figure_id, in_text_references, methods_context and results_context of figures (paper_id, figure_id, figure_number, caption; figure_id is unique).

    The figures of a paper come together in one row with its text, which is read once: for places that may mention a figure, and for its sections. Each figure then looks at those
    places, sentences and paragraphs only; no figure has a copy of the text."""
    longest = figures.agg(F.max(F.length("figure_number"))).first()[0] or 0
    of = figures.groupBy("paper_id").agg(F.collect_list(F.struct("figure_id", F.coalesce("figure_number", F.lit("")).alias("number"), F.coalesce("caption", F.lit("")).alias("caption"))).alias("_figures"))
    text = papers.select("paper_id", F.coalesce("full_text", F.lit("")).alias("full_text")).join(of, "paper_id")
    read = text.select("paper_id", "_figures", mention_windows(F.col("full_text"), longest).alias("w"), T.sections(F.col("full_text")).alias("_sections"))
    read = read.select("paper_id", "_figures", "w", section_body(F.col("_sections"), METHODS).alias("m"), section_body(F.col("_sections"), RESULTS).alias("r"))
    parts = F.array(F.struct("w", T.sentences(F.col("m")).alias("sentences"), "r", F.split("r", r"\n{2,}").alias("paragraphs")))
    one = lambda t, f: F.struct(
        f["figure_id"].alias("figure_id"), mentions(t["w"], f["number"]).alias("in_text_references"), best_sentences(t["sentences"], f["caption"], f["number"]).alias("methods_context"),
        mention_paragraphs(t["r"], t["paragraphs"], f["number"]).alias("results_context"),
    )
    return read.select("paper_id", F.explode(F.flatten(F.transform(parts, lambda t: F.transform("_figures", lambda f: one(t, f))))).alias("x")).select("paper_id", "x.*")


def surrounding_text(figures: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds surrounding_text: around the first mention on the pages before, of and after the figure, else the own page's first 1500 characters, else ''."""
    near = figures.select("paper_id", "figure_id", "figure_number", F.explode(F.sequence(F.col("page_number") - 1, F.col("page_number") + 1)).alias("page_number"), F.col("page_number").alias("own"))
    text = pages.select("paper_id", (F.col("page_idx") + 1).alias("page_number"), "text")
    g = near.join(text, ["paper_id", "page_number"]).groupBy("figure_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), "\n").alias("window"), F.max(F.when(F.col("page_number") == F.col("own"), F.col("text"))).alias("own_text"), F.first("figure_number").alias("_number")
    )
    found = F.call_function("regexp_extract", F.col("window"), T.page_figure_pattern(F.col("_number")), F.lit(0))
    gap = F.length(F.get(F.split(F.col("window"), T.page_figure_pattern(F.col("_number")), 2), F.lit(0)))
    lo = F.greatest(gap - SURROUNDING_CHARS // 2, F.lit(0))
    around = F.when(found != "", T.strip(F.substring("window", lo + 1, gap + F.length(found) + SURROUNDING_CHARS // 2 - lo)))
    return figures.join(g.select("figure_id", F.coalesce(around, T.strip(F.substring("own_text", 1, SURROUNDING_CHARS)), F.lit("")).alias("surrounding_text")), "figure_id", "left").fillna("", ["surrounding_text"])


def context_summary(caption: Column, references: Column, methods: Column, results: Column) -> Column:
    """What is known of a figure, labelled, in parts divided by blank lines, within SUMMARY_CHARS."""
    some = lambda label, c: F.when(F.length(c) > 0, F.concat(F.lit(label), c))
    parts = caption, F.array_join(F.slice(references, 1, 2), "; "), F.substring(methods, 1, PART_CHARS), F.substring(results, 1, PART_CHARS)
    return T.strip(F.substring(F.concat_ws("\n\n", *[some(label, c) for label, c in zip(LABELS, parts, strict=True)]), 1, SUMMARY_CHARS))


def extraction_prompt(title: Column, doi: Column, number: Column, figure_type: Column, context: Column, caption: Column) -> Column:
    """The text that goes to the model with the figure's image. Without a context the caption stands in its place."""
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown"))
    head = F.concat(F.lit("Figure "), number, F.coalesce(F.concat(F.lit(" ("), F.nullif(figure_type, F.lit("")), F.lit(")")), F.lit("")))
    block = F.coalesce(F.concat(F.lit("=== CONTEXT ===\n"), F.nullif(context, F.lit(""))), F.concat(F.lit("=== CAPTION ===\n"), F.coalesce(F.nullif(caption, F.lit("")), F.lit("(no caption available)"))))
    return F.concat_ws("\n", F.concat(F.lit("Paper: "), known(title)), F.concat(F.lit("DOI: "), known(doi)), head, F.lit(""), block, F.lit(""), F.lit(TASK))


def build_contexts(figures: DataFrame, papers: DataFrame, mode: str = "rich") -> DataFrame:
    """figures (paper_id, figure_id, figure_number, caption; figure_type and surrounding_text if there are) with in_text_references, methods_context, results_context, context_summary and
    prompt. mode "rich": the summary of caption, mentions, methods and results, else the surrounding text; mode "surrounding": the surrounding text alone, after the caption."""
    j = figures.join(papers.select("paper_id", F.col("title").alias("paper_title"), "doi"), "paper_id", "left")
    number, caption = F.col("figure_number"), F.coalesce("caption", F.lit(""))
    around = F.coalesce("surrounding_text", F.lit("")) if "surrounding_text" in figures.columns else F.lit("")
    if mode == "rich":
        j = j.join(figure_contexts(figures, papers), ["paper_id", "figure_id"], "left").fillna("", ["methods_context", "results_context"])
        j = j.withColumn("in_text_references", F.coalesce("in_text_references", F.array().cast("array<string>")))
        j = j.withColumn("context_summary", F.coalesce(F.nullif(context_summary(caption, F.col("in_text_references"), F.col("methods_context"), F.col("results_context")), F.lit("")), around))
        context = F.col("context_summary")
    elif mode == "surrounding":
        j = j.withColumns({"in_text_references": F.array().cast("array<string>"), "methods_context": F.lit(""), "results_context": F.lit(""), "context_summary": around})
        context = F.when(around != "", F.concat_ws("\n\n", F.nullif(caption, F.lit("")), around))
    else:
        raise ValueError(f"no mode {mode}")
    kind = F.col("figure_type") if "figure_type" in figures.columns else F.lit(None)
    return j.withColumn("prompt", extraction_prompt(F.col("paper_title"), F.col("doi"), number, kind, context, caption))


def title_of_first_page(spans: DataFrame) -> DataFrame:
    """The largest text (over 10 characters) of page 0, of equal ones the first. spans: paper_id, page, ord, text, font_size."""
    ok = spans.where("page = 0 and length(text) > 10")
    return ok.groupBy("paper_id").agg(F.max_by("text", F.struct("font_size", -F.col("ord"))).alias("title"))


def captions_below(figures: DataFrame, blocks: DataFrame, strip: float = 80) -> DataFrame:
    """Adds caption: of the blocks within `strip` points under a figure, the first that starts like a caption, else all of them in order. blocks: paper_id, page, y0, text."""
    starts = F.col("text").rlike(T.CAPTION_START)
    j = figures.select("figure_id", "paper_id", "page", "y1").join(blocks, ["paper_id", "page"]).where((F.col("y0") >= F.col("y1")) & (F.col("y0") <= F.col("y1") + strip))
    g = j.groupBy("figure_id").agg(
        F.min(F.when(starts, F.struct("y0", "text"))).alias("_first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "text"))), lambda b: b["text"]), " ").alias("_all"),
    )
    return figures.join(g, "figure_id", "left").withColumn("caption", F.coalesce("_first.text", "_all", F.lit(""))).drop("_first", "_all")
