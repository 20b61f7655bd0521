"""Collections behind a paged interface: a streaming source whose offset is the page, read in rounds until enough is kept.

Each round is one run of a stream (availableNow) over the next pages, a partition a page, whose checkpoint remembers which pages are done; its batch lands in a folder of its own, so a round that
is run again after a failure replaces itself. After a round, what is kept of all pages so far is counted, and the next one asks for as many pages as the yield so far suggests. Rounds end
when enough is kept or a page is empty. A page that fails is a row with its error, never silence; such pages are asked again, and the first one that fails for good ends the
collection before it, with a warning. A collection in the same folder goes on where it ended."""

from __future__ import annotations

import importlib
import json
import logging
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from inkquarry.sources.files import first_pair
from inkquarry.staging import shared_folder

logger = logging.getLogger("inkquarry")
#: ord is the place of an item on its page; null in the one row that tells how the page went: error is null if it was had.
PAGES = "page int, ord int, item string, error string"
#: Pages of one round at most, and how often a page that fails is asked in all.
MOST_PAGES, ATTEMPTS = 64, 3


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


def page_rows(fetch: str, number: int) -> Iterator[tuple[int, int | None, str | None, str | None]]:
    module, _, function = fetch.partition(":")
    try:
        items = [json.dumps(x) for x in getattr(importlib.import_module(module), function)(number)]
    except (OSError, TimeoutError, ValueError) as e:
        yield number, None, None, f"{type(e).__name__}: {e}"
        return
    yield number, None, None, None
    for k, item in enumerate(items):
        yield number, k, item, None


class PagedReader(DataSourceReader):
    def __init__(self, fetch: str, pages: list[int]):
        self.fetch, self.numbers = fetch, pages

    def partitions(self) -> list[Page]:
        return [Page(k) for k in self.numbers]

    def read(self, partition: Page):
        return page_rows(self.fetch, partition.number)


class PagedStream(DataSourceStreamReader):
    def __init__(self, fetch: str, until: int):
        self.fetch, self.until = fetch, until

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": self.until}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(k) for k in range(start["page"] + 1, end["page"] + 1)]

    def read(self, partition: Page):
        return page_rows(self.fetch, partition.number)


class Paged(DataSource):
    """Options: fetch (module:function, page number to a list of dicts); for a batch numbers (pages, with commas), for a stream until (the last page it may ask for)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options["fetch"], [int(x) for x in self.options["numbers"].split(",")])

    def streamReader(self, schema) -> PagedStream:
        return PagedStream(self.options["fetch"], int(self.options["until"]))


def asked_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of each page of a collection as of the last time it was asked."""
    rows = spark.read.schema(f"{PAGES}, round int").parquet(f"{folder}/pages")
    last = rows.groupBy("page").agg(F.max("round").alias("round"))
    return rows.join(last, ["page", "round"]).select("page", "ord", "item", "error")


def failed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """page and error of those that could not be had."""
    return asked_pages(spark, folder).where("error is not null").select("page", "error")


def had_items(pages: DataFrame) -> DataFrame:
    """page, ord, item of the pages before the first that failed or is empty."""
    state = pages.groupBy("page").agg(F.count("ord").alias("n"), F.max("error").alias("error"))
    end = state.where("error is not null or n = 0").agg(F.min("page").alias("end"))
    return pages.where("ord is not null").join(F.broadcast(end)).where("end is null or page < end").select("page", "ord", "item")  # one row: an aggregate without keys


def collected(spark: SparkSession, fetch: str, keep: Callable[[DataFrame], DataFrame], most: int, per_page: int, folder: str | None = None, attempts: int = ATTEMPTS) -> DataFrame:
    """The first `most` rows, by page and ord, of keep(items), where items are page, ord and item (JSON) and keep() gives rows with page and ord.

    per_page is a guess of what a page yields, for the first round. folder: where the collection lies; a new one in the shared folder if not given."""
    spark.dataSource.register(Paged)
    folder = folder or f"{shared_folder(spark)}/collection-{uuid.uuid4().hex[:12]}"

    def save(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/pages/round={number}")

    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/pages")
    there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    done = spark.read.schema(f"{PAGES}, round int").parquet(f"{folder}/pages").agg(F.max("page")).first()[0] or 0 if there else 0
    ask = -(-most // per_page)
    while True:
        if there:
            pages = asked_pages(spark, folder)
            kept, empty = keep(pages.where("ord is not null").select("page", "ord", "item")).limit(most).count(), not pages.groupBy("page").agg(F.count("ord").alias("n"), F.max("error").alias("e")).where("n = 0 and e is null").isEmpty()
            if kept >= most or empty or not most:
                break
            ask = -(-(most - kept) * done // kept) if kept else 2 * ask
        done += min(ask, MOST_PAGES)
        stream = spark.readStream.format("paged").option("fetch", fetch).option("until", done).load()
        # batches of a stream are even rounds behind all repeats of earlier ones, so the last answer of a page is the one that counts
        query = stream.writeStream.foreachBatch(lambda df, n: save(df, n * (attempts + 1))).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        there = True
        first = (query.lastProgress or {}).get("batchId", 0) * (attempts + 1)
        for again in range(1, attempts):
            lost = [r["page"] for r in failed_pages(spark, folder).collect()]  # at most MOST_PAGES: those of one round, as a collection ends at a page that fails
            if not lost:
                break
            save(spark.read.format("paged").option("fetch", fetch).option("numbers", ",".join(map(str, sorted(lost)))).load(), first + again)
        lost = failed_pages(spark, folder).orderBy("page").first()
        if lost:
            logger.warning("page %d of %s failed %d times, the collection ends before it: %s", lost["page"], fetch, attempts, lost["error"])
            break
    rows = keep(had_items(asked_pages(spark, folder)))
    return rows.orderBy("page", "ord").limit(most)


def article_rows(items: DataFrame) -> DataFrame:
    """page, ord, doi and item of those that have a DOI."""
    doi = F.get_json_object("item", "$.doi")
    return items.where(doi.isNotNull() & (doi != "")).select("page", "ord", doi.alias("doi"), "item")


def pair_rows(items: DataFrame) -> DataFrame:
    """page, ord, article_id, image_url and csv_url of data sets with an image and a CSV file, each at its first place. Items: id and files (name, url)."""
    item = F.from_json("item", "id long, files array<struct<name:string,url:string>>")
    found = items.select("page", "ord", item.alias("a")).where("a.id is not null")
    place = F.row_number().over(Window.partitionBy("a.id").orderBy("page", "ord"))
    first = found.withColumn("_place", place).where("_place = 1").select("page", "ord", F.col("a.id").alias("article_id"), F.col("a.files").alias("files"))
    urls = first_pair(first.select("article_id", F.posexplode("files").alias("ord", "f")).select("article_id", "ord", "f.name", "f.url"))
    return first.drop("files").join(urls, "article_id").select("page", "ord", "article_id", "image_url", "csv_url")


def articles(spark: SparkSession, fetch: str, most: int, per_page: int = 10, folder: str | None = None) -> DataFrame:
    """doi and item of the first `most` articles that have a DOI, in the order of pages."""
    return collected(spark, fetch, article_rows, most, per_page, folder).select("doi", "item")


def dataset_pairs(spark: SparkSession, fetch: str, most: int, per_page: int = 25, folder: str | None = None) -> DataFrame:
    """article_id, image_url and csv_url of the first `most` data sets that have an image and a CSV file. Items: id and files (name, url)."""
    return collected(spark, fetch, pair_rows, most, per_page, folder).select("article_id", "image_url", "csv_url")
