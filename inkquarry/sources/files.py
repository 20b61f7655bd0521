"""Files as DataFrames, and the two plug-in boundaries: parsing documents and asking models."""

from __future__ import annotations

import base64
import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.error import HTTPError, URLError

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from inkquarry.functions.text import LEAST_FONT, figure_references, maybe_scanned, stem, strip
from inkquarry.operators.images import IMAGE

#: The model server's address and model, seconds of one call and number of attempts.
URL, MODEL, TIMEOUT, ATTEMPTS = "http://localhost:11434", "gemma4:4b", 120, 3

#: What a parser plug-in gives of a document (all parts may be missing): texts of pages, metadata, spans of text, pages' sizes, number of drawings and renderings, and figures.
FIGURE = f"figure_number:string,page_number:int,caption:string,x1:double,y1:double,x2:double,y2:double,source:string,image:{IMAGE}"
SPAN = "page:int,type:int,text:string,x0:double,y0:double,x1:double,y1:double,font_size:double"
PAGE = f"width:double,height:double,n_paths:int,image:{IMAGE}"
PARSED = (
    f"path string, pages array<string>, title string, author string, creator string, producer string, spans array<struct<{SPAN}>>, page_info array<struct<{PAGE}>>, "
    f"figures array<struct<{FIGURE}>>, error string"
)
PARTS = ("pages", "title", "author", "creator", "producer", "spans", "page_info", "figures")


def documents(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """path, content of each file; streaming readers take the same options."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder).select("path", "content")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Decodable images as (image_id, image); files that can't be decoded are dropped."""
    i = spark.read.format("image").option("dropInvalid", True).load(folder)
    return i.select(stem(F.col("image.origin")).alias("image_id"), "image")


def encoded(files: DataFrame) -> DataFrame:
    return files.withColumn("base64", F.base64("content"))


def parse(files: DataFrame, parser: Callable[[bytes], dict]) -> DataFrame:
    """PARSED rows by a plug-in; what it raises becomes the row's error, never the job's. Documents go one by one."""
    schema = StructType.fromDDL(PARSED)
    fields = {f.name: f.dataType for f in schema}

    def whole(kind: DataType, value):
        """With every field that the schema has; those that a plug-in leaves out are null."""
        if isinstance(kind, ArrayType):
            return None if value is None else [whole(kind.elementType, x) for x in value]
        if isinstance(kind, StructType):
            return None if value is None else {f.name: whole(f.dataType, value.get(f.name)) for f in kind.fields}
        return value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = dict.fromkeys(fields)
                try:
                    found = parser(content)
                    row |= {k: whole(fields[k], found.get(k)) for k in PARTS}
                except Exception as e:  # a plug-in may raise anything; the row says what
                    row["error"] = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([row | {"path": path}], schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def page_texts(parsed: DataFrame) -> DataFrame:
    """paper_id, page_idx (from 0), text, maybe_scanned of every page."""
    pages = parsed.select(F.col("path").alias("paper_id"), F.posexplode("pages").alias("page_idx", "text"))
    return pages.withColumn("maybe_scanned", maybe_scanned(F.col("text")))


def page_text(pages: DataFrame, number: int) -> DataFrame:
    """paper_id and text of one page, counted from 1."""
    return pages.where(F.col("page_idx") == number - 1).select("paper_id", "text")


def text_spans(parsed: DataFrame) -> DataFrame:
    """paper_id, page, ord, text, bbox, font_size of the spans of text, without tiny and blank ones."""
    s = parsed.select(F.col("path").alias("paper_id"), F.posexplode("spans").alias("ord", "s")).withColumn("text", strip(F.col("s.text")))
    ok = s.where((F.col("s.type") == 0) & (F.col("s.font_size") >= LEAST_FONT) & (F.col("text") != ""))
    return ok.select("paper_id", F.col("s.page").alias("page"), "ord", "text", F.array("s.x0", "s.y0", "s.x1", "s.y1").alias("bbox"), F.col("s.font_size").alias("font_size"))


def references(pages: DataFrame) -> DataFrame:
    """paper_id, page, figure_ref, context of every reference to a figure, page by page."""
    return pages.select("paper_id", F.col("page_idx").alias("page"), F.explode(figure_references(F.col("text"))).alias("r")).select("paper_id", "page", "r.*")


def render(files: DataFrame, renderer: Callable[[bytes], list]) -> DataFrame:
    """path, page_idx and png of every page by a plug-in that gives one PNG file a page; documents that it can't read give no page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    pages = renderer(content)
                except Exception:  # as any broken document; parse() has the error
                    pages = []
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(pages), pa.string()), pa.array(range(len(pages)), pa.int32()), pa.array([bytes(x) for x in pages], pa.binary())], ["path", "page_idx", "png"])

    return files.select("path", "content").mapInArrow(run, "path string, page_idx int, png binary")


def extracted_figures(raw: Column) -> Column:
    """Figures (as FIGURE) from the JSON output of a figure extractor: its type, name or number, caption, page (from 0) and region, else the caption's region; null if it is no array."""
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    found = F.from_json(raw, f"array<struct<name:string,number:string,caption:string,page:int,regionBoundary:{box},captionBoundary:{box}>>")

    def one(f: Column, k: Column) -> Column:
        corner = lambda c: F.coalesce(F.coalesce(f["regionBoundary"], f["captionBoundary"])[c], F.lit(0.0)).alias(c)
        return F.struct(
            F.coalesce(f["name"], f["number"], (k + 1).cast("string")).alias("figure_number"), (F.coalesce(f["page"], F.lit(0)) + 1).alias("page_number"), F.coalesce(f["caption"], F.lit("")).alias("caption"),
            *[corner(c) for c in ("x1", "y1", "x2", "y2")], F.lit("pdffigures2").alias("source"), F.lit(None).cast(IMAGE).alias("image"),
        )

    return F.transform(found, one)


def extractor_output(spark: SparkSession, folder: str) -> DataFrame:
    """stem and figures of a folder of an extractor's `<stem>.json` files; process() takes it as its primary source."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return found.select(stem(F.col("path")).alias("stem"), extracted_figures(F.decode("content", "utf-8")).alias("figures")).where("figures is not null")


def extractor_available(jar: str) -> bool:
    """Whether the extractor's program and Java are there, on this machine."""
    import shutil
    from pathlib import Path

    return Path(jar).is_file() and shutil.which("java") is not None


def first_source(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Rows of the primary source, and for keys that it has nothing of those of the secondary one."""
    return primary.unionByName(secondary.join(primary.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def text_parser(content: bytes) -> dict:
    """The stand-in parser: UTF-8 text, pages divided by form feeds; `%PDF-ENCRYPTED` is refused, as are empty files."""
    text = content.decode("utf-8")
    if not text or text.startswith("%PDF-ENCRYPTED"):
        raise ValueError("encrypted or empty document")
    pages = text.split("\f")
    title = next((x.strip() for x in pages[0].splitlines() if len(x.strip()) > 10), None)
    return {"pages": pages, "title": title, "author": "", "creator": "", "producer": "", "figures": []}


class Memo:
    """Answers of a model in a folder that all tasks reach: a file an answer, named by the hash of model, prompt and image. A task that runs again, or a job, asks for nothing twice."""

    def __init__(self, folder: str, model: Callable):
        from pyarrow import fs as afs

        self.fs, root = afs.FileSystem.from_uri(folder) if "://" in folder else (afs.LocalFileSystem(), folder)
        self.root, self.name = root.rstrip("/"), repr(sorted(vars(model).items())) if hasattr(model, "__dict__") and vars(model) else getattr(model, "__qualname__", type(model).__qualname__)

    def path(self, text: str, data: bytes | None) -> str:
        key = hashlib.sha256(b"\0".join((self.name.encode(), hashlib.sha256(text.encode()).digest(), b"-" if data is None else hashlib.sha256(data).digest()))).hexdigest()
        return f"{self.root}/{key[:2]}/{key}"

    def get(self, path: str) -> str | None:
        from pyarrow import fs as afs

        if self.fs.get_file_info(path).type != afs.FileType.File:
            return None
        with self.fs.open_input_stream(path) as f:
            return f.read().decode()

    def put(self, path: str, answer: str) -> None:
        """By a file beside it and a move, so that no one reads half an answer."""
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as f:
            f.write(answer.encode())
        self.fs.move(part, path)


def infer(
    df: DataFrame, model: Callable[[str, bytes | None], str], prompt: str = "prompt", image: str | None = None, attempts: int = ATTEMPTS, wait: float = 2.0, out: str = "answer", memo: str | None = None, calls: int = 4,
) -> DataFrame:
    """Adds the model's answer, and in `<out>_error` why there is none. What can't be reached or takes too long is asked again, after wait, 2 wait, 4 wait ... seconds; a refusal by the
    server or an error of the model is not. No failure ends the job. Filter rows before this boundary and write its result, as answers are dear.

    Each task has up to `calls` questions under way at once. memo: a folder (see Memo) in which answers last, so that a task that is lost or a job that runs again asks only what
    has no answer yet; refusals and failures are not kept."""
    schema = StructType([*df.schema.fields, StructField(out, StringType()), StructField(f"{out}_error", StringType())])
    columns = [prompt, *([image] if image else [])]
    where = [df.columns.index(c) for c in columns]

    def ask(text: str, data: bytes | None) -> tuple[str | None, str | None]:
        for n in range(attempts):
            try:
                return model(text, data), None
            except HTTPError as e:
                return None, f"HTTP {e.code}: {e.reason}"
            except (TimeoutError, ConnectionError, URLError) as e:
                last = f"{type(e).__name__}: {e}"
                time.sleep(wait * 2**n if n + 1 < attempts else 0)
            except Exception as e:  # a plug-in may raise anything; the row says what
                return None, f"{type(e).__name__}: {e}"
        return None, f"unreachable after {attempts} attempts: {last}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Memo(memo, model) if memo else None

        def answer(text: str, data: bytes | None) -> tuple[str | None, str | None]:
            if held is None or text is None:
                return ask(text, data)
            path = held.path(text, data)
            known = held.get(path)
            if known is not None:
                return known, None
            found = ask(text, data)
            if found[0] is not None:
                held.put(path, found[0])
            return found

        with ThreadPoolExecutor(max_workers=max(1, calls)) as pool:
            for batch in batches:
                texts, data = batch.column(where[0]).to_pylist(), batch.column(where[1]).to_pylist() if image else [None] * batch.num_rows
                asked = dict.fromkeys(zip(texts, data))  # a question that comes twice in a batch is asked once
                asked.update(zip(asked, pool.map(lambda q: answer(*q), list(asked))))
                answers = [asked[q] for q in zip(texts, data)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([a[k] for a in answers], pa.string()) for k in range(2)]], [*batch.schema.names, out, f"{out}_error"])

    return df.mapInArrow(run, schema)


class HttpModel:
    """A model server's endpoints; connections are opened in the workers, not on the driver. context: the server's window, larger where an image goes along."""

    def __init__(self, url: str = URL, name: str = MODEL, context: int = 4096, text_context: int = 2048, timeout: float = TIMEOUT, temperature: float = 0.1, system: str | None = None):
        self.url, self.name, self.context, self.text_context, self.timeout, self.temperature, self.system = url.rstrip("/"), name, context, text_context, timeout, temperature, system

    def payload(self, prompt: str, image: bytes | None) -> dict:
        options = {"temperature": self.temperature, "num_ctx": self.context if image is not None else self.text_context}
        body = {"model": self.name, "prompt": prompt, "stream": False, "options": options} | ({"system": self.system} if self.system else {})
        return body | ({"images": [base64.b64encode(image).decode()], "format": "json"} if image is not None else {})

    def chat_payload(self, messages: list[dict]) -> dict:
        """messages: role, content, and for the user's turns images as base64."""
        return {"model": self.name, "messages": messages, "stream": False, "options": {"temperature": self.temperature, "num_ctx": self.text_context}}

    def _open(self, path: str, body: dict | None, timeout: float) -> dict:
        from urllib.request import Request, urlopen

        data = None if body is None else json.dumps(body).encode()
        with urlopen(Request(f"{self.url}{path}", data, {"Content-Type": "application/json"}), timeout=timeout) as r:
            return json.loads(r.read())

    def __call__(self, prompt: str, image: bytes | None = None) -> str:
        return self._open("/api/generate", self.payload(prompt, image), self.timeout).get("response", "")

    def chat(self, messages: list[dict]) -> str:
        return self._open("/api/chat", self.chat_payload(messages), self.timeout).get("message", {}).get("content", "")

    def available(self) -> bool:
        """Whether the server can be reached and has a model whose name contains ours."""
        try:
            return any(self.name in m.get("name", "") for m in self._open("/api/tags", None, 10).get("models", []))
        except (OSError, ValueError):
            return False


def pairs_by_stem(truth: DataFrame, images_df: DataFrame, suffix: str = "_ground_truth") -> DataFrame:
    """truth (path, ...) with the image of the same stem; those without one are dropped."""
    t = truth.withColumn("stem", F.regexp_replace(stem(F.col("path")), f"{suffix}$", ""))
    return t.join(images_df.select(stem(F.col("path")).alias("stem"), F.col("path").alias("image_path")), "stem")


def first_pair(files: DataFrame) -> DataFrame:
    """article_id with its first image and first CSV, where both exist. files: article_id, ord, name, url."""
    low = F.lower("name")
    image, csv = low.rlike(r"\.(png|jpg|tif)$"), low.rlike(r"\.csv$")
    g = files.groupBy("article_id").agg(F.min_by(F.when(image, F.col("url")), F.when(image, F.col("ord"))).alias("image_url"), F.min_by(F.when(csv, F.col("url")), F.when(csv, F.col("ord"))).alias("csv_url"))
    return g.where("image_url is not null and csv_url is not null")


def training_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """stem, image_path, caption, ground_truth of every `*_meta.json` below a folder that has its PNG beside it; files that aren't JSON objects are left out."""
    found = lambda pattern: spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    meta = found("*_meta.json").select(F.regexp_replace("path", r"_meta\.json$", "").alias("base"), F.from_json(F.decode("content", "utf-8"), "caption string, ground_truth string").alias("m"), F.rlike(F.decode("content", "utf-8"), F.lit(r"(?s)^\s*\{.*\}\s*$")).alias("whole"))
    images = found("*.png").select(F.regexp_replace("path", r"\.png$", "").alias("base"), F.col("path").alias("image_path"))
    j = meta.where("whole").join(images, "base")
    return j.select(stem(F.col("image_path")).alias("stem"), "image_path", F.coalesce("m.caption", F.lit("")).alias("caption"), F.coalesce("m.ground_truth", F.lit("[]")).alias("ground_truth"))


def benchmark_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """figure, ord, figure_type, series_name, ys and image_path of every `*_ground_truth.json`: null image_path without the PNG of its stem, and null ord where the file is no array."""
    read = lambda pattern: spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    schema = "array<struct<figure_type:string,series_name:string,data_points:array<struct<x:double,y:double>>>>"
    truth = read("*_ground_truth.json").select(F.regexp_extract("path", r"([^/]+)_ground_truth\.json$", 1).alias("figure"), F.from_json(F.decode("content", "utf-8"), schema).alias("s"))
    images = read("*.png").select(F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("figure"), F.col("path").alias("image_path"))
    rows = truth.select("figure", F.posexplode_outer("s").alias("ord", "s")).join(images, "figure", "left")
    return rows.select("figure", "ord", F.coalesce("s.figure_type", F.lit("unknown")).alias("figure_type"), "s.series_name", F.transform("s.data_points", lambda p: p["y"]).alias("ys"), "image_path")
