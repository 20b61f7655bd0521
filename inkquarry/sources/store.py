"""The stored tables (papers, figures, series, errors) as Parquet, under one log of numbered commits for the whole store.

A commit is a small JSON file that names every table's folders, its last id and the stream batches that are in. A transaction writes new folders first and then the next commit, by a
rename that never replaces a file. So a reader sees all tables before or after a transaction and never between, whenever a writer dies; of two writers of one version the second
finds the file there, and runs its transaction again on what the first one wrote.

Rows are never rewritten in place (merge on read): a change adds a folder of new rows, and a folder of the keys whose older rows are dead. Folders carry a number that grows with each
change, and a row is dead if a later folder names its key. What a transaction writes therefore grows with what it changes; a table of more than MOST_FOLDERS folders is
compacted by the next transaction that adds to it."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkquarry.functions.text import safe_name
from inkquarry.operators.ordered import surrogate_ids
from inkquarry.schemas import TABLES
from inkquarry.staging import kept

#: A table of more folders than this is written anew by the next transaction that adds to it.
MOST_FOLDERS = 64
#: How often a transaction is run again because another writer was faster.
MOST_TRIES = 20

T = TypeVar("T")


class Snapshot:
    """All tables as of one commit."""

    def __init__(self, spark: SparkSession, root: str, state: dict, schemas: dict[str, str] = TABLES):
        self.spark, self.root, self.state, self.schemas = spark, root, state, schemas

    def _empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], self.schemas[table])

    def read(self, table: str) -> DataFrame:
        """The live rows. Deleted keys are grouped before they are joined, so each is one row, whatever its number of rows in the table."""
        held = self.state["tables"][table]
        if not held["rows"]:
            return self._empty(table)
        rows = self.spark.read.schema(self.schemas[table]).parquet(*[f"{self.root}/{table}/{x}" for x in held["rows"]])
        for column in sorted({c for c, _ in held["gone"]}):
            folders = [f"{self.root}/{table}/{x}" for c, x in held["gone"] if c == column]
            number = F.regexp_extract("_metadata.file_path", r"/[rd]-(\d+)-", 1).cast("long")
            gone = self.spark.read.schema("key long").parquet(*folders).select("key", number.alias("_gone")).groupBy("key").agg(F.max("_gone").alias("_gone"))
            rows = rows.withColumn("_at", number) if "_at" not in rows.columns else rows
            rows = rows.join(gone, (F.col(column) == F.col("key")) & (F.col("_at") < F.col("_gone")), "left_anti")
        return rows.select(*self._empty(table).columns)


class Transaction(Snapshot):
    """Changes to a snapshot, which reads of the same transaction see; nobody else does before the commit."""

    def _next(self, table: str) -> int:
        return self.state["tables"][table]["last"]

    def _written(self, table: str, df: DataFrame, kind: str = "r") -> str:
        self.state["changes"] += 1
        folder = f"{kind}-{self.state['changes']}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{table}/{folder}")
        return folder

    def _add(self, table: str, df: DataFrame) -> DataFrame:
        """Adds rows with ids in a folder of their own; what was written."""
        held = self.state["tables"][table]
        if len(held["rows"]) + len(held["gone"]) >= MOST_FOLDERS:
            held["rows"], held["gone"] = [self._written(table, self.read(table))], []
        folder = self._written(table, df.select(*self._empty(table).columns))
        held["rows"].append(folder)
        added = self.spark.read.schema(self.schemas[table]).parquet(f"{self.root}/{table}/{folder}")
        held["last"] = max(held["last"], added.agg(F.max("id")).first()[0] or 0)
        return added

    def _drop(self, table: str, column: str, keys: DataFrame) -> None:
        """Rows that are there now and whose column has one of the keys (one column of longs) are dead."""
        if self.state["tables"][table]["rows"]:
            self.state["tables"][table]["gone"].append([column, self._written(table, keys.toDF("key").distinct(), "d")])

    def write(self, table: str, df: DataFrame) -> None:
        """Replaces a table."""
        rows = self._written(table, df.select(*self._empty(table).columns))
        self.state["tables"][table] = {"rows": [], "gone": [], "last": self._next(table)}
        last = self.spark.read.schema(self.schemas[table]).parquet(f"{self.root}/{table}/{rows}").agg(F.max("id")).first()[0] or 0
        self.state["tables"][table] = {"rows": [rows], "gone": [], "last": max(self._next(table), last)}

    def upsert_papers(self, new: DataFrame) -> None:
        """By pdf_path: known papers keep id and processed_at and take every other value, nulls too; new ones get ids. Of rows with one path, the one with the largest values counts."""
        one = kept(one_per_key(new, "pdf_path"), "upsert")
        known = kept(self.read("papers").join(one.select("pdf_path"), "pdf_path", "left_semi"), "known")
        rows = kept(self._empty("papers").unionByName(upserted(known, one, self._next("papers")), allowMissingColumns=True), "upserted")
        self._drop("papers", "id", known.select("id"))
        self._add("papers", rows)

    def replace_rows(self, table: str, rows: DataFrame) -> None:
        """Rows take the place of those of their ids, which they bring along; one row an id."""
        settled = kept(rows, "replace")
        self._drop(table, "id", settled.select("id"))
        self._add(table, settled)

    def remove_rows(self, table: str, ids: DataFrame) -> None:
        """Rows of these ids (one column) go."""
        self._drop(table, "id", kept(ids.distinct(), "remove"))

    def append(self, table: str, rows: DataFrame, order: list[str]) -> None:
        """Adds rows with dense ids in the given order, in a new folder."""
        with_ids, empty = surrogate_ids(rows.drop("id"), order, self._next(table)), self._empty(table)
        self._add(table, empty.unionByName(with_ids.select(*[c for c in with_ids.columns if c in empty.columns]), allowMissingColumns=True))

    def replace_figures(self, figures: DataFrame) -> None:
        """Figures of the same papers give way to the new ones, with their series (cascade)."""
        self.replace_figures_of(figures.select("paper_id").distinct(), figures)

    def replace_figures_of(self, gone: DataFrame, figures: DataFrame) -> None:
        """Figures of the given papers (paper_id) give way, also where a paper has no new ones: their series go too, and errors keep no figure."""
        dropped = kept(self.read("figures").join(gone, "paper_id", "left_semi").select(F.col("id").alias("figure_id")), "dropped")
        if not dropped.isEmpty():
            errors = kept(self.read("errors").join(dropped, "figure_id", "left_semi"), "errors")
            if not errors.isEmpty():
                self._drop("errors", "id", errors.select("id"))
                self._add("errors", errors.withColumn("figure_id", F.lit(None).cast("long")))
            self._drop("series", "figure_id", dropped)
            self._drop("figures", "id", dropped)
        self.append("figures", figures, ["paper_id", "page_number", "figure_number"])


class Store:
    """schemas: the tables, each with an `id long`; those of the document engine if not given."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str] = TABLES):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _commits(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/commits")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(p) if x.getPath().getName().isdigit()) if fs.exists(p) else []

    def _newest(self) -> int:
        """The number of the newest commit; 0 without any."""
        return max(self._commits(), default=0)

    def _state(self, number: int) -> dict:
        if not number:
            return {"changes": 0, "tables": {t: {"rows": [], "gone": [], "last": 0} for t in self.schemas}, "batches": {}}
        lines = self.spark.read.option("wholetext", True).text(f"{self.root}/commits/{number:012d}").first()
        return json.loads(lines[0])

    def _folders(self, table: str) -> list[str]:
        held = self._state(self._newest())["tables"][table]
        return held["rows"] + [x for _, x in held["gone"]]

    def _commit(self, number: int, state: dict) -> bool:
        """Makes `state` the commit `number`; False if there is one of that number."""
        jvm, name = self.spark._jvm, f"{self.root}/commits/{number:012d}"
        fs, new = self._fs(f"{name}.{uuid.uuid4().hex}")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        _, last = self._fs(name)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(new).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(new), fs.makeQualified(last), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            fs.delete(new, False)
            return False
        return True

    def snapshot(self) -> Snapshot:
        """All tables as of the newest commit; later transactions don't change what it reads."""
        return Snapshot(self.spark, self.root, self._state(self._newest()), self.schemas)

    def transact(self, change: Callable[[Transaction], T], batch: tuple[str, int] | None = None) -> T | None:
        """All that `change` does to a transaction, in one commit. It runs again from the start where another writer was faster, so what it reads must be settled (kept) before.

        batch: (name of a stream, number of its batch). A batch whose number is in already does nothing and gives None, so each takes effect once."""
        for _ in range(MOST_TRIES):
            number = self._newest()
            state = self._state(number)
            if batch and state["batches"].get(batch[0], -1) >= batch[1]:
                return None
            out = change(Transaction(self.spark, self.root, state, self.schemas))
            if batch:
                state["batches"][batch[0]] = batch[1]
            if self._commit(number + 1, state):
                return out
        raise RuntimeError(f"other writers were faster {MOST_TRIES} times")

    def has_batch(self, batch: tuple[str, int]) -> bool:
        return self._state(self._newest())["batches"].get(batch[0], -1) >= batch[1]

    def read(self, table: str) -> DataFrame:
        return self.snapshot().read(table)

    def write(self, table: str, df: DataFrame) -> None:
        """Replaces a table."""
        self.transact(lambda t: t.write(table, df))

    def upsert_papers(self, new: DataFrame) -> None:
        self.transact(lambda t: t.upsert_papers(new))

    def append(self, table: str, rows: DataFrame, order: list[str]) -> None:
        self.transact(lambda t: t.append(table, rows, order))

    def replace_figures(self, figures: DataFrame) -> None:
        self.transact(lambda t: t.replace_figures(figures))

    def replace_figures_of(self, gone: DataFrame, figures: DataFrame) -> None:
        self.transact(lambda t: t.replace_figures_of(gone, figures))

    def vacuum(self, keep: int = 2, older_than: float = 0) -> None:
        """Deletes folders that none of the last `keep` commits names and that are `older_than` seconds old, and the older commits. Readers of those versions must be done, and
        transactions that are under way must be younger."""
        commits, latest = self._commits(), (time.time() - older_than) * 1000
        used = {f for c in commits[-keep:] for t in self._state(c)["tables"].values() for f in t["rows"] + [x for _, x in t["gone"]]}
        for table in self.schemas:
            fs, folder = self._fs(f"{self.root}/{table}")
            for x in fs.listStatus(folder) if fs.exists(folder) else []:
                if x.getPath().getName()[:2] in ("r-", "d-") and x.getPath().getName() not in used and x.getModificationTime() <= latest:
                    fs.delete(x.getPath(), True)
        for c in commits[:-keep]:
            fs, path = self._fs(f"{self.root}/commits/{c:012d}")
            fs.delete(path, False)

    def init(self) -> None:
        """Makes a store where there is none; one that is there stays as it is."""
        if not self._newest():
            self._commit(1, self._state(0))

    def figures_of(self, papers: DataFrame) -> DataFrame:
        """Papers with their figures and series; only the rows of these papers are grouped."""
        now = self.snapshot()
        figures = now.read("figures").join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
        return nested(papers, figures, now.read("series").join(figures.select(F.col("id").alias("figure_id")), "figure_id", "left_semi"))

    def search(self, doi: str) -> DataFrame:
        return self.figures_of(self.read("papers").where(F.col("doi") == doi).orderBy("id").limit(1))

    def recent(self, n: int | None = None) -> DataFrame:
        out = self.read("papers").orderBy(F.desc("processed_at"), F.desc("id"))
        return out if n is None else out.limit(n)

    def export_json(self, paper_id: int, path: str) -> None:
        papers = self.read("papers").where(F.col("id") == paper_id)
        if papers.isEmpty():
            raise ValueError(f"no paper {paper_id}")
        self.figures_of(papers).write.option("ignoreNullFields", "false").json(path)

    def export_points(self, paper_id: int, path: str) -> None:
        """CSV, one folder per series: figure, panel and series name are in its path, and the series' id where names repeat."""
        now = self.snapshot()
        points_of(now.read("figures").where(F.col("paper_id") == paper_id), now.read("series")).drop("paper_id").write.partitionBy("file").option("header", True).csv(path)

    def export_xlsx(self, paper_id: int, path: str) -> None:
        """One workbook with a sheet per series that has points; a paper's points go through one task and the driver."""
        from inkquarry.sources.exports import workbook

        now = self.snapshot()
        rows = points_of(now.read("figures").where(F.col("paper_id") == paper_id), now.read("series")).orderBy("file", "ord").collect()
        sheets: dict[str, list] = {}
        for r in rows:
            sheets.setdefault(r["file"], []).append([r["x"], r["y"], r["err_x"], r["err_y"]])
        fs, p = self._fs(path)
        out = fs.create(p, True)
        out.write(bytearray(workbook({name: [["x", "y", "err_x", "err_y"], *points] for name, points in sheets.items()})))
        out.close()


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """What export_points() wrote: file, ord, x, y, err_x, err_y."""
    return spark.read.option("header", True).schema("ord int, x double, y double, err_x double, err_y double, file string").csv(path)


def one_per_key(rows: DataFrame, key: str) -> DataFrame:
    """One row a key, that with the largest values by the order of columns (nulls are smallest); rows without a key count as rows of one key. Partial sums, so a hot key is one row a task."""
    values = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(*values)).alias("_v")).select(key, "_v.*") if values else rows.distinct()


def upserted(old: DataFrame, new: DataFrame, last_id: int, key: str = "pdf_path") -> DataFrame:
    """Full outer join on the key: values of new win, ids and processed_at of old stay. Of new rows with one key, the one with the largest values counts."""
    new = one_per_key(new, key)
    fresh = surrogate_ids(new.join(old.select(key), key, "left_anti").drop("id"), [key], last_id)
    kept = ["id", "processed_at"] if "processed_at" in old.columns else ["id"]
    values = [c for c in old.columns if c not in (*kept, key)]
    n = new.select(key, F.lit(True).alias("_in"), *[(F.col(c) if c in new.columns else F.lit(None)).alias(f"_{c}") for c in values])
    changed = old.join(n, key, "left").select(key, *kept, *[F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values])
    if "processed_at" in kept:
        fresh = fresh.withColumn("processed_at", F.current_timestamp())
    return changed.unionByName(fresh, allowMissingColumns=True)


def set_null(errors: DataFrame, dropped: DataFrame) -> DataFrame:
    d = dropped.select(F.col("figure_id").alias("_gone")).distinct()
    return errors.join(d, F.col("figure_id") == F.col("_gone"), "left").withColumn("figure_id", F.when(F.col("_gone").isNull(), F.col("figure_id"))).drop("_gone")


def nested(papers: DataFrame, figures: DataFrame, series: DataFrame) -> DataFrame:
    """Papers with figures (by page and figure number, as text) with series (by id): two left joins instead of a query per row."""
    s = series.groupBy("figure_id").agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in series.columns if c not in ("id", "figure_id")]))).alias("series"))
    f = figures.join(s, figures["id"] == s["figure_id"], "left").drop("figure_id")
    order = ["page_number", "figure_number", "id"]
    f = f.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in f.columns if c not in (*order, "paper_id")]))).alias("figures"))
    return papers.join(f, papers["id"] == f["paper_id"], "left").drop("paper_id")


def series_files(figures: DataFrame, series: DataFrame) -> DataFrame:
    """paper_id, file and data_points of each series that has any. Names count within their paper: series of one paper whose names are equal get their ids into the name, so no two share a
    file, and no name depends on other papers."""
    f = figures.select(F.col("id").alias("figure_id"), "paper_id", "figure_number", "panel_label")
    j = series.where(F.size("data_points") > 0).join(f, "figure_id")
    name = safe_name(F.concat(F.lit("fig"), "figure_number", F.coalesce("panel_label", F.lit(""))), F.coalesce(F.nullif("series_name", F.lit("")), F.lit("series")))
    named = j.select("paper_id", name.alias("name"), "id", "data_points")
    times = named.groupBy(F.col("paper_id").alias("_paper"), F.col("name").alias("_name")).agg(F.count("*").alias("times"))
    file = F.when(F.col("times") > 1, F.concat_ws("_", "name", "id")).otherwise(F.col("name"))
    return named.join(times, F.col("paper_id").eqNullSafe(F.col("_paper")) & (F.col("name") == F.col("_name"))).select("paper_id", file.alias("file"), "data_points")


def points_of(figures: DataFrame, series: DataFrame) -> DataFrame:
    """paper_id, file and the points of each series that has any."""
    return series_files(figures, series).select("paper_id", "file", F.posexplode("data_points").alias("ord", "p")).select("paper_id", "file", "ord", "p.*")


def csv_text(points: Column) -> Column:
    """A series' points as the text of a CSV file; what is not known is empty."""
    cell = lambda v: F.coalesce(v.cast("string"), F.lit(""))
    line = lambda p: F.concat_ws(",", *[cell(p[c]) for c in ("x", "y", "err_x", "err_y")])
    return F.concat(F.lit("x,y,err_x,err_y\n"), F.array_join(F.transform(points, line), "\n"), F.lit("\n"))


def figure_counts(figures: DataFrame, series: DataFrame) -> DataFrame:
    """Per figure its number of series and of points."""
    per = series.groupBy("figure_id").agg(F.count("*").alias("n"), F.sum(F.size("data_points")).alias("points"))
    j = figures.join(per, figures["id"] == per["figure_id"], "left")
    return j.select("paper_id", figures["id"].alias("id"), "figure_number", "panel_label", "page_number", "figure_type", F.coalesce("n", F.lit(0)).alias("n_series"), F.coalesce("points", F.lit(0)).alias("n_points"))


def text_report(papers: DataFrame, figures: DataFrame, series: DataFrame) -> DataFrame:
    """paper_id, ord and value, the lines of each paper's report: heading, a line per figure in the order of pages and numbers, and totals."""
    unknown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown"))
    counts = figure_counts(figures, series)
    line = F.format_string("  Fig %-5s | %-20s | %d series | %d data points", F.concat("figure_number", F.coalesce("panel_label", F.lit(""))), F.coalesce("figure_type", F.lit("unknown")), "n_series", "n_points")
    per = counts.groupBy("paper_id").agg(
        F.count("*").alias("figures"), F.sum("n_series").alias("n"), F.sum("n_points").alias("points"),
        F.transform(F.array_sort(F.collect_list(F.struct("page_number", "figure_number", "id", line.alias("line")))), lambda x: x["line"]).alias("lines"),
    )
    j = papers.join(per, papers["id"] == per["paper_id"], "left").drop("paper_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    rule = F.lit("=" * 60)
    lines = F.concat(
        F.array(rule, F.lit("Extraction Report"), rule, F.concat(F.lit("Paper   : "), unknown("title")), F.concat(F.lit("DOI     : "), unknown("doi")), F.concat(F.lit("PDF     : "), F.col("pdf_path")), F.concat(F.lit("Figures : "), zero("figures")), F.lit("")),
        F.coalesce("lines", F.array().cast("array<string>")),
        F.array(F.lit(""), F.concat(F.lit("Total series extracted : "), zero("n")), F.concat(F.lit("Total data points      : "), zero("points")), rule),
    )
    return j.select(F.col("id").alias("paper_id"), F.posexplode(lines).alias("ord", "value"))


def error_split(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rows whose error column isn't null."""
    e = df.withColumn("error_message", error)
    return e.where("error_message is null").drop("error_message"), e.where("error_message is not null")
