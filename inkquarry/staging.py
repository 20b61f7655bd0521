"""Tables between the steps of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one on a local master, and an error on a cluster, as other machines would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-inkquarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/inkquarry-{spark.sparkContext.applicationId}"


_open = threading.local()


@contextmanager
def dropping(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all that kept() wrote within it, in this thread; results must be written by then."""
    before, _open.paths = getattr(_open, "paths", None), []
    try:
        yield
    finally:
        for path in _open.paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _open.paths = before


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: what a plug-in answered, or where a row lay, is settled once, also when an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_kept(spark: SparkSession) -> None:
    """Deletes all that kept() of this application has written; call it when the results are written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
