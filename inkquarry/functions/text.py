"""Text rules as Column -> Column functions, all in the JVM but for figure_references(). Patterns and plain functions are compiled with their stage; transform, filter and aggregate over arrays are interpreted."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

#: Patterns, words and limits of the document rules.
DOI_PREFIXED = r"(?i)(?:doi[:\s]*|https?://(?:dx\.)?doi\.org/)(10\.\d{4,9}/[-._;()/:A-Z0-9a-z]+)"
DOI_BARE = r"(?i)\b(10\.\d{4,9}/[-._;()/:A-Z0-9a-z]+)"
YEAR = r"\b(19\d{2}|20\d{2})\b"
SECTION = r"(?imd)^\s*(abstract|introduction|methods?|materials?\s+and\s+methods?|results?|discussion|conclusions?|acknowledgements?|references?)\s*$"
FIGURE_REFERENCE = r"(?i)\b(?:Fig(?:ure|s?\.?)?)\s*\.?\s*([A-Z]?\d+[a-z]?(?:\s*[–-]\s*\d+)?)\b"
ABSTRACT = r"(?is)\bAbstract\b(.{50,3000}?)\b(?:Introduction|Keywords?|Background)\b"
PANEL_LABEL = r"(?i)[\(\[]([A-H])[\)\]]|(?<!\w)([A-H])\)|(?<!\w)([A-H])\.\s"
CAPTION_START = r"(?i)^(Figure|Fig\.|FIGURE|Supplementary\s+Figure|Supp\.?\s*Fig\.?)\s*[\dS]"
WORD = r"\b[a-zA-Z]{4,}\b"
STOP_WORDS = (
    "figure", "shows", "shown", "panel", "panels", "data", "with", "from", "each", "this", "that", "their", "were", "have", "been", "also", "upon",
    "using", "used", "left", "right", "upper", "lower", "scale", "bars", "images", "image", "error", "mean", "median", "total", "values",
)
DOI_CHARS, YEAR_CHARS, REFERENCE_WINDOW, SCANNED_CHARS, LEAST_FONT = 6000, 4000, 200, 100, 4


def head(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def doi(text: Column) -> Column:
    """The first DOI of the first 6000 characters, a prefixed one first; trailing full stops go; null if there is none."""
    s = head(text, DOI_CHARS)
    found = lambda p: F.nullif(F.regexp_extract(s, p, 1), F.lit(""))
    return F.nullif(F.regexp_replace(F.coalesce(found(DOI_PREFIXED), found(DOI_BARE)), r"\.+$", ""), F.lit(""))


def years(text: Column) -> Column:
    """All years of the first 4000 characters, in order."""
    return F.transform(F.regexp_extract_all(head(text, YEAR_CHARS), F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))


def mode_first_seen(values: Column) -> Column:
    """The most frequent element of an array, of equally frequent ones the first seen; null for an empty array."""
    scored = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-F.array_position(values, v)).alias("p"), v.alias("v")))
    return F.array_max(scored)["v"]


def abstract(text: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(text, ABSTRACT, 1)), F.lit(""))


#: What counts as white space at the ends of a text.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"


def strip(text: Column) -> Column:
    """Without white space at either end, newlines and tabs too."""
    return F.btrim(text, F.lit(SPACES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value evaluated once: the optimizer would copy the expression into each of its uses, but leaves a lambda's variable alone."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column, chunk: int = 64) -> Column:
    """The running sums of an array of whole numbers: by chunks, as a fold that appends copies what it has at every step."""
    none, append = F.array().cast("array<long>"), lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.array_append(acc["out"], acc["at"] + v).alias("out"))
    fold = lambda x: F.aggregate(x, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), append, lambda acc: acc["out"])
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / chunk).cast("int")), lambda c: fold(F.slice(numbers, c * chunk + 1, chunk)))

    def joined(parts: Column) -> Column:
        before = fold(F.transform(parts, lambda x: F.element_at(x, -1)))
        return let(before, lambda ends: F.flatten(F.transform(parts, lambda x, i: F.transform(x, lambda v: v + F.when(i > 0, F.get(ends, i - 1)).otherwise(0)))))

    return F.when(F.size(numbers) > 0, let(chunks, joined)).otherwise(none)


def match_spans(text: Column, pattern: Column | str) -> Column:
    """0-based places and lengths (s, n) of all matches: the lengths of what lies between and of the matches, added up."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    cut = F.struct(F.transform(F.split(text, pattern, -1), F.length).alias("gaps"), F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("hits"))

    def spans(x: Column) -> Column:
        sums = running_sums(F.transform(x["hits"], lambda n, i: n + F.get(x["gaps"], i)))
        return F.zip_with(sums, x["hits"], lambda end, n: F.struct((end - n).cast("int").alias("s"), n.alias("n")))

    return let(cut, spans)


def match_starts(text: Column, pattern: Column | str) -> Column:
    """0-based places of all matches."""
    return F.transform(match_spans(text, pattern), lambda m: m["s"])


def window_around(text: Column, start: Column, length: Column, n: int) -> Column:
    """The characters from n before a match (0-based start) to n after its end, newlines as spaces."""
    lo = F.greatest(start - n, F.lit(0))
    return F.regexp_replace(F.substring(text, lo + 1, start + length + n - lo), "\n", " ")


def snippet_around(text: Column, start: Column, length: Column, n: int) -> Column:
    """window_around() without white space at the ends, before newlines become spaces."""
    lo = F.greatest(start - n, F.lit(0))
    return F.regexp_replace(strip(F.substring(text, lo + 1, start + length + n - lo)), "\n", " ")


def literal(text: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.regexp_replace(text, r"([^A-Za-z0-9])", r"\\$1")


def figure_pattern(number: Column) -> Column:
    """A pattern for mentions of a figure: Fig, Fig., Figs, Figs., Figure and its number, as a whole word."""
    return F.concat(F.lit(r"(?i)\b(?:Fig(?:ure|s?\.?)?)\.?\s*"), literal(F.trim(number)), F.lit(r"\b"))


def page_figure_pattern(number: Column) -> Column:
    """The same for the text around a figure's page: Fig, Fig. and Figure only."""
    return F.concat(F.lit(r"(?i)\bFig(?:ure)?\.?\s*"), literal(number), F.lit(r"\b"))


#: FIGURE_REFERENCE for Python: letters, digits and white space are those of ASCII, as in Java; word borders are those of all letters in both.
_REFERENCE = re.compile(r"\b[Ff][Ii][Gg](?:[Uu][Rr][Ee]|[Ss]?\.?)?[ \t-\r]*\.?[ \t-\r]*[A-Za-z]?[0-9]+[A-Za-z]?(?:[ \t-\r]*[–-][ \t-\r]*[0-9]+)?\b")


#: Texts of an Arrow batch that a scan takes at a time, and characters of them (one text at least).
SCAN_TEXTS, SCAN_CHARS = 256, 1 << 20


def in_parts(batches: Iterator[pa.Array], kind: pa.DataType, one: Callable[[str], list[tuple]]) -> Iterator[pa.Array]:
    """What scanned() hands on for the texts of Arrow batches: arrays of some SCAN_TEXTS rows."""
    names = [f.name for f in kind.value_type]
    for batch in batches:
        part, chars = [], 0
        for x in batch:
            t = x.as_py()
            if part and (len(part) >= SCAN_TEXTS or chars + len(t or "") > SCAN_CHARS):
                yield pa.array(part, kind)
                part, chars = [], 0
            part.append(None if t is None else [dict(zip(names, found, strict=True)) for found in one(t)])
            chars += len(t or "")
        yield pa.array(part, kind)


def scanned(text: Column, fields: dict[str, pa.DataType], one: Callable[[str], list[tuple]]) -> Column:
    """An array of structs of each text (null: null) by a function of the text, in Python. What is found can be many times the texts, so it is handed on a part at a time: beside its batch
    of texts, a worker holds what was found in one part, or in one text that is longer than a part."""
    kind = pa.list_(pa.struct(list(fields.items())))

    @F.arrow_udf(from_arrow_type(kind))
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from in_parts(batches, kind, one)

    return scan(text)


def figure_references(text: Column) -> Column:
    """Array of (figure_ref, context) of all references to figures in a page, in order, with what is around them. One pass over the text in an Arrow batch: cutting a piece out of a text costs
    its length there, and its place in the JVM."""
    around = lambda t, m: t[max(m.start() - REFERENCE_WINDOW, 0) : m.end() + REFERENCE_WINDOW].strip(SPACES)
    return scanned(text, {"figure_ref": pa.string(), "context": pa.string()}, lambda t: [(m[0].strip(SPACES), around(t, m)) for m in _REFERENCE.finditer(t)])


def maybe_scanned(text: Column) -> Column:
    """Pages with hardly any text."""
    return F.length(strip(text)) < SCANNED_CHARS


def keywords(caption: Column) -> Column:
    """Distinct lower-case words of four letters and more, without stop words, in order."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(caption), F.lit(WORD), F.lit(0))), F.array(*map(F.lit, STOP_WORDS)))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def keyword_hits(sentence: Column, words: Column) -> Column:
    low = F.lower(sentence)
    return F.size(F.filter(words, lambda k: F.contains(low, k)))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Characters of the shorter that occur anywhere in the longer, over the longer's length; 0 if either is empty."""
    swap = F.length(a) > F.length(b)
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    hits = F.size(F.filter(F.split(short, ""), lambda c: (c != "") & F.contains(long, c)))
    return F.when(F.length(short) == 0, 0.0).otherwise(hits / F.length(long))


def greedy_distinct(snippets: Column, ratio: float = 0.6, most: int = 3) -> Column:
    """Longest first (stable), each kept if it overlaps every kept one by at most `ratio`, at most `most`."""
    ranked = F.array_sort(F.transform(snippets, lambda s, i: F.struct((-F.length(s)).alias("n"), i.alias("i"), s.alias("s"))))
    fresh = lambda kept, s: F.forall(kept, lambda k: overlap_ratio(s, k) <= ratio)
    return F.aggregate(
        ranked, F.array().cast("array<string>"), lambda kept, x: F.when((F.size(kept) < most) & fresh(kept, x["s"]), F.array_append(kept, x["s"])).otherwise(kept)
    )


def section_name(heading: Column) -> Column:
    """Title case; all kinds of "materials and methods" are Methods."""
    h = strip(heading)
    return F.when(F.rlike(h, F.lit(r"(?i)^materials?\s+and\s+methods?$")), "Methods").otherwise(F.initcap(h))


def sections(text: Column, swallow_next: bool = False) -> Column:
    """Array of (ord, name, body): each body runs to the next heading (with swallow_next, to its end), without white space around it; bodies of
    repeated headings are joined by a blank line, in the place of the first."""
    heads = F.regexp_extract_all(text, F.lit(SECTION), F.lit(0))
    bodies = F.slice(F.split(text, SECTION, -1), F.lit(2), F.size(heads))
    tail = lambda i: F.when(F.lit(swallow_next), F.coalesce(F.get(heads, i + 1), F.lit(""))).otherwise("")
    each = F.transform(F.arrays_zip(heads.alias("h"), bodies.alias("b")), lambda x, i: F.struct(section_name(x["h"]).alias("name"), strip(F.concat(x["b"], tail(i))).alias("body")))
    # through a fold, so that the array of all sections is made once and not for every name
    return F.aggregate(
        F.array(each), F.array().cast("array<struct<ord:int,name:string,body:string>>"),
        lambda _, all_: F.transform(
            F.array_distinct(F.transform(all_, lambda s: s["name"])),
            lambda name, i: F.struct(i.alias("ord"), name.alias("name"), F.array_join(F.transform(F.filter(all_, lambda s: s["name"] == name), lambda s: s["body"]), "\n\n").alias("body")),
        ),
    )


def panel_labels(caption: Column) -> Column:
    """Distinct panel labels A-H in order, upper case."""
    hits = F.regexp_extract_all(caption, F.lit(PANEL_LABEL), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.upper(F.regexp_extract(h, "(?i)([A-H])", 1)))))


def panel_caption(caption: Column, label: Column) -> Column:
    """From a label in brackets to the next one or the end; the whole caption if the label isn't there."""
    pattern = F.concat(F.lit(r"(?is)[\(\[]"), literal(label), F.lit(r"[\)\]].*?(?=[\(\[][A-H][\)\]]|$)"))
    return F.coalesce(F.nullif(strip(F.call_function("regexp_extract", caption, pattern, F.lit(0))), F.lit("")), caption)


def safe_name(*parts: Column) -> Column:
    return F.translate(F.concat_ws("_", *parts), " /", "_-")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)


def authors(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, "[;,]"), lambda a: F.trim(a)), lambda a: a != "")


def journal(creator: Column, producer: Column) -> Column:
    """The creator, else the producer, unless it names an office program."""
    name = F.coalesce(F.nullif(creator, F.lit("")), F.nullif(producer, F.lit("")))
    return F.when(~name.rlike("Microsoft|Adobe"), head(name, 120))
