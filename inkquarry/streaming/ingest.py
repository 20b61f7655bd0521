"""Watches a folder: new documents are parsed and upserted batch by batch; a path that was seen is not taken again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inkquarry.plans.process import process
from inkquarry.sources.files import text_parser
from inkquarry.sources.store import Store
from inkquarry.staging import dropping


def watch(spark: SparkSession, folder: str, store: Store, checkpoint: str, classify: Callable, extract: Callable, parser: Callable = text_parser, pattern: str = "*.pdf") -> StreamingQuery:
    """Takes what is there now and ends (availableNow); run it again for what came since. Each batch is the batch plan in one transaction that holds the batch's number, so a batch that
    is run again after a failure changes nothing; its tables between steps are deleted when it ends. A lost checkpoint numbers batches anew; give it another folder, and papers are
    upserted again."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def take(df: DataFrame, number: int) -> None:
        with dropping(df.sparkSession):
            process(df, store, parser, classify, extract, batch=(checkpoint, number))

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
