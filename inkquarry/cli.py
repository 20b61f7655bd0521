"""Command line: process, process-batch, search, export, benchmark. The parser and the models are plug-ins, named as module:function."""

from __future__ import annotations

import argparse
import importlib
import logging
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkquarry.config import Settings
from inkquarry.operators.metrics import benchmark, report_lines
from inkquarry.plans.process import CLASS_SYSTEM, process
from inkquarry.sources import files
from inkquarry.sources.exports import write_files
from inkquarry.sources.store import Store, csv_text, series_files, text_report
from inkquarry.staging import dropping

logger = logging.getLogger("inkquarry")


def plugin(name: str | None, default: Callable) -> Callable:
    """The function that module:function names."""
    if not name:
        return default
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def write_outputs(store: Store, tables: dict[str, DataFrame], papers: DataFrame, out: str) -> None:
    """CSV of points (a file a series, below its paper's id), JSON, reports and figures' metadata of papers below a folder, and their images as PNG files where their image_path says."""
    figures = tables["figures"].join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    series = series_files(figures, tables["series"])
    write_files(series.select(F.concat_ws("/", F.lit("csv"), "paper_id", F.concat("file", F.lit(".csv"))).alias("name"), F.encode(csv_text(F.col("data_points")), "utf-8").alias("content")), out)
    store.figures_of(papers).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{out}/json")
    # a paper's lines stay in one file and in order
    text_report(papers, figures, tables["series"]).repartition("paper_id").sortWithinPartitions("paper_id", "ord").select("paper_id", "value").write.mode("overwrite").partitionBy("paper_id").text(f"{out}/report")
    figures.repartition("paper_id").sortWithinPartitions("paper_id", "page_number", "figure_number").write.mode("overwrite").partitionBy("paper_id").option("ignoreNullFields", "false").json(f"{out}/metadata")
    if "images" in tables:
        named = figures.where("image_path is not null").select(F.col("source_key").alias("figure_id"), F.col("image_path").alias("name"))
        write_files(tables["images"].join(named, "figure_id").select("name", F.col("png").alias("content")), out)


def run_process(spark: SparkSession, a: argparse.Namespace, pattern: str | None) -> int:
    settings = Settings.of(spark)
    model = lambda system: files.HttpModel(settings.model_url, settings.model_name, timeout=settings.model_timeout, system=system)
    classify, extract = plugin(a.classify, model(CLASS_SYSTEM)), plugin(a.extract, model(None))
    if not (a.classify and a.extract) and not model(None).available():
        logger.error("the model server at %s can't be reached, or lacks the model %s", settings.model_url, settings.model_name)
        return 1
    found = files.documents(spark, a.path, pattern) if pattern else spark.read.format("binaryFile").load(a.path).select("path", "content")
    n = found.select("path").count()
    if not n:
        logger.warning("no documents in %s", a.path)
        return 0
    store = Store(spark, a.store)
    with dropping(spark):
        tables = process(found, store, plugin(a.parser, files.text_parser), classify, extract, mode=a.mode)
        papers = tables["papers"].join(found.select(F.col("path").alias("pdf_path")), "pdf_path", "left_semi")
        write_outputs(store, tables, papers, a.output)
        good = papers.count()
    print(f"{good}/{n} succeeded; results in {a.output}")
    return 0 if good == n else 1


def run_search(spark: SparkSession, a: argparse.Namespace) -> int:
    found = Store(spark, a.store).search(a.doi).toJSON().collect()
    print(found[0] if found else f"no paper with DOI {a.doi}")
    return 0 if found else 1


def run_export(spark: SparkSession, a: argparse.Namespace) -> int:
    store, path = Store(spark, a.store), f"{a.output}/paper_{a.paper_id}"
    try:
        {"csv": store.export_points, "json": store.export_json, "xlsx": lambda i, p: store.export_xlsx(i, f"{p}_all.xlsx")}[a.format](a.paper_id, path)
    except ValueError as e:
        print(e)
        return 1
    print(f"exported {a.format} to {a.output}")
    return 0


def run_benchmark(spark: SparkSession, a: argparse.Namespace) -> int:
    settings = Settings.of(spark)
    results = benchmark_folder(spark, a.test_set, plugin(a.extract, files.HttpModel(settings.model_url, settings.model_name, timeout=settings.model_timeout)), settings)
    print("\n".join(r["value"] for r in report_lines(results, settings.rmse_threshold).orderBy("ord").collect()))
    return 0


def benchmark_folder(spark: SparkSession, folder: str, extract: Callable, settings: Settings | None = None) -> DataFrame:
    """Results per figure of a folder of `<stem>.png` and `<stem>_ground_truth.json`; pairs without an image or with an unreadable truth are skipped, and count as such."""
    from inkquarry.functions.model_json import parse_array
    from inkquarry.functions.text import let
    from inkquarry.operators.context import extraction_prompt
    from inkquarry.staging import kept

    settings = settings or Settings.of(spark)
    pairs = kept(files.benchmark_pairs(spark, folder), "truth")
    ok = pairs.where("image_path is not null and ord is not null")
    images = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder).select(F.col("path").alias("image_path"), "content")
    none = F.lit(None).cast("string")
    asked = ok.select("figure", "image_path").distinct().join(images, "image_path").withColumn("prompt", extraction_prompt(none, none, F.col("figure"), none, none, none))
    answered = kept(files.infer(asked, extract, image="content", attempts=settings.model_attempts, memo=settings.answers_folder or None, calls=settings.model_calls).drop("content"), "answers")
    predicted = answered.select("figure", F.posexplode(let(F.col("answer"), lambda a: parse_array(a))).alias("ord", "s")).select("figure", "ord", F.coalesce("s.series_name", F.lit("")).alias("series_name"), F.transform("s.data_points", lambda p: p["y"]).alias("ys"))
    scored = benchmark(ok.select("figure", "figure_type", "ord", "series_name", "ys"), predicted, settings.rmse_threshold).withColumn("skipped", F.lit(False))
    lost = pairs.join(ok.select("figure").distinct(), "figure", "left_anti").select("figure").distinct()
    return scored.unionByName(lost.withColumns({"skipped": F.lit(True), "passed": F.lit(False), "figure_type": F.lit("unknown")}), allowMissingColumns=True)


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkquarry", description="Numeric data from scientific documents.")
    p.add_argument("--log-level", choices=["DEBUG", "INFO", "WARNING", "ERROR"], help="instead of the setting log_level")
    p.add_argument("--store", default="store", help="folder of the stored tables")
    sub = p.add_subparsers(dest="command", required=True)
    for name, of in (("process", "document"), ("process-batch", "folder of documents")):
        c = sub.add_parser(name)
        c.add_argument("path", help=of)
        c.add_argument("--output", "-o", default="outputs")
        c.add_argument("--mode", default="rich", choices=["rich", "surrounding"])
        for option in ("--parser", "--classify", "--extract"):
            c.add_argument(option, help="module:function")
    c = sub.add_parser("search")
    c.add_argument("--doi", required=True)
    c = sub.add_parser("export")
    c.add_argument("--paper-id", required=True, type=int)
    c.add_argument("--format", default="csv", choices=["csv", "json", "xlsx"])
    c.add_argument("--output", "-o", default="outputs")
    c = sub.add_parser("benchmark")
    c.add_argument("--test-set", required=True)
    c.add_argument("--extract", help="module:function")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """The exit code: 0 if all went well, 1 if something failed or wasn't found."""
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("inkquarry").getOrCreate()
    logging.basicConfig()
    logger.setLevel(a.log_level or Settings.of(spark).log_level)
    run = {"process": lambda: run_process(spark, a, None), "process-batch": lambda: run_process(spark, a, "*.pdf"), "search": lambda: run_search(spark, a), "export": lambda: run_export(spark, a), "benchmark": lambda: run_benchmark(spark, a)}
    return run[a.command]()


if __name__ == "__main__":
    sys.exit(main())
