"""Stores, ids, images, panels, plug-in boundaries, the whole process and the command line."""

import io
import json
import random
import re
import tempfile
import zipfile
import zlib
from pathlib import Path
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkquarry import cli
from inkquarry.config import Settings
from inkquarry.functions import model_json as J
from inkquarry.functions import text as T
from inkquarry.operators import context as C
from inkquarry.operators import images as I
from inkquarry.operators import metrics as M
from inkquarry.operators import ordered as O
from inkquarry.plans import catalog
from inkquarry.plans.process import process
from inkquarry.sources import collect, exports, files, synthetic
from inkquarry.sources.store import Store, read_points, upserted
from inkquarry.streaming.ingest import watch

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# Ids and stores


def wide(spark, n):
    return spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("/p/"), F.sha2(F.col("id").cast("string"), 256)).alias("pdf_path"), F.repeat(F.lit("payload "), 12).alias("title"), (F.col("id") % 2000).cast("int").alias("year"))


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_surrogate_ids_are_dense_and_unique(spark, adaptive):
    n = 1_000_000 if adaptive == "true" else 200_000
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = O.surrogate_ids(wide(spark, n).repartition(7), ["pdf_path"], 1000).agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id"), F.countDistinct("k")).first()
        assert tuple(got) == (n, n, 1001, 1000 + n, n)
        ordered = O.surrogate_ids(wide(spark, 3000), ["year", "k"], 0).select("year", "k", "id").collect()
        assert [r["id"] for r in sorted(ordered, key=lambda r: (r["year"], r["k"]))] == list(range(1, 3001))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert O.surrogate_ids(wide(spark, 0), ["k"], 5).isEmpty()


def test_upsert_of_many_papers(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.init()
    store.upsert_papers(wide(spark, 100_000).drop("k"))
    store.upsert_papers(wide(spark, 150_000).drop("k").withColumn("title", F.lit("new")))
    got = store.read("papers").agg(F.count("*"), F.countDistinct("id"), F.max("id"), F.countDistinct("pdf_path"), F.count_if(F.col("title") == "new")).first()
    assert tuple(got) == (150_000, 150_000, 150_000, 150_000, 150_000)
    old = spark.createDataFrame([(3, "a", 1), (9, "b", 2)], "id long, name string, v long")
    new = spark.createDataFrame([("b", None), ("c", 5)], "name string, v long")
    assert sorted(map(tuple, upserted(old, new, 9, "name").select("name", "id", "v").collect())) == [("a", 3, 1), ("b", 9, None), ("c", 10, 5)]


def test_store_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("papers").isEmpty()
    store.init()
    row = lambda k: spark.createDataFrame([(None, "x", f"m{k}")], "figure_id long, error_type string, error_message string")
    for k in range(3):
        store.append("errors", row(k), ["error_message"])
    assert [r["id"] for r in store.read("errors").orderBy("id").collect()] == [1, 2, 3] and len(store._folders("errors")) == 3
    held = store.read("errors")
    store.init()
    assert held.count() == 3 and store.read("errors").count() == 3
    assert not store._commit(store._newest(), store._state(0))  # a second writer of the same version
    assert store.read("errors").count() == 3
    store.write("errors", store.read("errors").where("id = 2"))
    store.vacuum(keep=1)
    assert [r["error_message"] for r in store.read("errors").collect()] == ["m1"]
    assert len([p for p in (tmp_path / "errors").iterdir() if p.name[:2] == "r-"]) == 1
    store.append("errors", row(9), ["error_message"])
    assert store.read("errors").agg(F.max("id")).first()[0] == 4  # ids of rows that are gone aren't given again


PAPER, FIGURE = "pdf_path string, doi string", "paper_id long, figure_number string, panel_label string, page_number int"


def state_of(store):
    now = store.snapshot()
    papers = {r["pdf_path"]: (r["id"], r["doi"]) for r in now.read("papers").collect()}
    figures = {(r["paper_id"], r["figure_number"]): r["id"] for r in now.read("figures").collect()}
    series = sorted((r["figure_id"], r["series_name"]) for r in now.read("series").collect())
    return papers, figures, series, sorted((r["figure_id"] or 0, r["error_message"]) for r in now.read("errors").collect())


def filled(spark, path):
    store = Store(spark, str(path))
    store.upsert_papers(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], PAPER))
    store.replace_figures(spark.createDataFrame([(1, "1", "", 1), (1, "2", "", 1), (2, "1", "", 1)], FIGURE))
    store.append("series", spark.createDataFrame([(1, "s1"), (1, "s2"), (2, "s3"), (3, "s4")], "figure_id long, series_name string"), ["figure_id", "series_name"])
    store.append("errors", spark.createDataFrame([(1, "e1"), (3, "e3"), (None, "e0")], "figure_id long, error_message string"), ["error_message"])
    return store


def test_merge_on_read(spark, tmp_path):
    store = filled(spark, tmp_path)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    # a key that comes twice has the row of the largest values
    store.upsert_papers(spark.createDataFrame([("b", "9"), ("b", "5"), ("d", "4"), ("d", None)], PAPER))
    store.replace_figures(spark.createDataFrame([(1, "7", "", 1)], FIGURE))
    papers, figures, series, errors = state_of(store)
    assert papers == {"a": (1, "1"), "b": (2, "9"), "c": (3, "3"), "d": (4, "4")}
    assert figures == {(2, "1"): 3, (1, "7"): 4} and series == [(3, "s4")] and errors == [(0, "e0"), (0, "e1"), (3, "e3")]
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())  # nothing that was there is written again
    added = [r[0] for p in tmp_path.rglob("*.parquet") if p not in before for r in [spark.read.parquet(str(p)).agg(F.count("*")).first()]]
    assert sum(added) <= 12
    store.replace_figures_of(spark.createDataFrame([(2,), (99,)], "paper_id long"), spark.createDataFrame([], FIGURE))
    assert state_of(store)[1:] == ({(1, "7"): 4}, [], [(0, "e0"), (0, "e1"), (0, "e3")])


def test_compaction_keeps_all(spark, tmp_path, monkeypatch):
    from inkquarry.sources import store as module

    monkeypatch.setattr(module, "MOST_FOLDERS", 5)
    store = filled(spark, tmp_path)
    for k in range(6):
        store.upsert_papers(spark.createDataFrame([("b", str(k)), (f"n{k}", "n")], PAPER))
        store.replace_figures(spark.createDataFrame([(2, str(k), "", 1)], FIGURE))
    papers, figures, series, errors = state_of(store)
    assert papers["b"] == (2, "5") and len(papers) == 9 and figures.keys() == {(1, "1"), (1, "2"), (2, "5")} and series == [(1, "s1"), (1, "s2"), (2, "s3")] and errors == [(0, "e0"), (0, "e3"), (1, "e1")]
    assert len(store._folders("papers")) <= 7


def test_transactions(spark, tmp_path):
    store = filled(spark, tmp_path)
    old = state_of(store)
    change = lambda t, doi: (t.upsert_papers(spark.createDataFrame([("a", doi), (doi, doi)], PAPER)), t.replace_figures(spark.createDataFrame([(1, doi, "", 1)], FIGURE)))

    class Killed(Exception):
        pass

    from inkquarry.sources.store import Transaction

    writes = Transaction._written
    for k in range(1, 30):  # a writer that dies after any of its writes leaves the old state
        count = iter(range(1, 100))

        def dying(self, *a, k=k, count=count):
            out = writes(self, *a)
            if next(count) == k:
                raise Killed
            return out

        Transaction._written = dying
        try:
            store.transact(lambda t: change(t, "x"))
            break
        except Killed:
            assert state_of(store) == old
        finally:
            Transaction._written = writes
    assert 4 < k < 29
    papers, figures, series, errors = state_of(store)
    assert papers["a"] == (1, "x") and papers["x"] == (4, "x") and set(figures) == {(1, "x"), (2, "1")} and series == [(3, "s4")] and errors == [(0, "e0"), (0, "e1"), (3, "e3")]

    other = Store(spark, str(tmp_path))
    runs = []

    def slow(t):
        runs.append(1)
        change(t, "slow")
        if len(runs) == 1:  # another writer commits in between
            other.transact(lambda u: u.upsert_papers(spark.createDataFrame([("quick", "q")], PAPER)))

    store.transact(slow)
    papers = state_of(store)[0]
    assert len(runs) == 2 and papers["quick"] == (5, "q") and papers["slow"] == (6, "slow") and papers["a"] == (1, "slow")
    assert store.transact(lambda t: t.upsert_papers(spark.createDataFrame([("s1", "1")], PAPER)) or 1, batch=("stream", 3)) == 1
    assert store.transact(lambda t: t.upsert_papers(spark.createDataFrame([("s2", "1")], PAPER)) or 1, batch=("stream", 3)) is None
    assert store.has_batch(("stream", 3)) and not store.has_batch(("stream", 4)) and not store.has_batch(("other", 0)) and "s2" not in state_of(store)[0]


def test_exports(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.init()
    store.upsert_papers(spark.createDataFrame([("/a.pdf", "10.1/x", None)], "pdf_path string, doi string, title string"))
    store.replace_figures(spark.createDataFrame([(1, "1", "A", 2), (1, "10", "", 1), (1, "2", "", 1)], "paper_id long, figure_number string, panel_label string, page_number int"))
    ids = {r["figure_number"] + r["panel_label"]: r["id"] for r in store.read("figures").collect()}
    point = "array<struct<x:double,y:double,err_x:double,err_y:double>>"
    rows = [(ids["1A"], "Same / name", [(0.0, 1.5, None, None), (1.0, 2.5, None, 0.1)]), (ids["1A"], "Same / name", [(9.0, 9.0, None, None)]), (ids["2"], "", [(1.0, 1.0, None, None)]), (ids["2"], "none", [])]
    store.append("series", spark.createDataFrame(rows, f"figure_id long, series_name string, data_points {point}"), ["figure_id", "series_name"])
    assert [f["figure_number"] for f in store.search("10.1/x").first()["figures"]] == ["10", "2", "1"]
    store.export_points(1, str(tmp_path / "csv"))
    points = read_points(spark, str(tmp_path / "csv")).collect()
    names = {p["file"] for p in points}
    assert len(points) == 4 and len(names) == 3 and "fig2_series" in names and {re.sub(r"_\d+$", "", n) for n in names} == {"fig2_series", "fig1A_Same_-_name"}
    store.export_xlsx(1, str(tmp_path / "p.xlsx"))
    with zipfile.ZipFile(tmp_path / "p.xlsx") as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        assert {s.get("name") for s in book.iter("{%s}sheet" % exports.MAIN)} == names
        cells = [v.text for v in ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).iter("{%s}v" % exports.MAIN)]
        assert {"1.5", "0.1"} <= set(cells) or len(cells) in (2, 4)
    assert exports.sheet_names(["a" * 40, "a" * 35, "b/c", ""]) == ["a" * 31, "a" * 29 + "_2", "b_c", "sheet"]
    with zipfile.ZipFile(io.BytesIO(exports.workbook({}))) as z:
        assert "xl/worksheets/sheet1.xml" in z.namelist()
    n = exports.write_files(spark.createDataFrame([("a/b.bin", b"xy"), ("c.bin", b""), ("none", None)], "name string, content binary"), str(tmp_path / "files"))
    assert n == 2 and (tmp_path / "files/a/b.bin").read_bytes() == b"xy"


def test_vector_collection(spark, tmp_path):
    from inkquarry.sources.vectors import Vectors

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    vectors = spark.createDataFrame(rows, "id long, vector array<float>")
    held = Vectors(spark, str(tmp_path / "v"))
    held.build(vectors.where("id < 1500"), lists=32)
    bad = [(-1, None), (-2, []), (-3, [0.0] * 64), (-4, [None] * 64), (-5, [float("nan")] * 64), (-6, [float("inf")] * 64), (None, rows[0][1]), (7, rows[7][1]), (7, rows[7][1])]
    held.upsert(vectors.where("id >= 1500").unionByName(spark.createDataFrame(bad, "id long, vector array<float>")))
    now = held.store.read("vectors")
    assert now.count() == len(rows) and now.agg(F.count_distinct("id")).first()[0] == len(rows)
    x = np.array([r[1] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, mine = np.array([r[0] for r in rows]), [k for k, r in enumerate(rows) if r[0] % 50 == 0]
    sims = x[mine] @ x.T
    sims[np.arange(len(mine)), mine] = -2
    want = {int(ids[m]): set(ids[np.argsort(-s)[:5]].tolist()) for m, s in zip(mine, sims)}
    found = held.search(vectors.where("id % 50 = 0"), 5, probes=22).collect()
    recall = sum(r["id"] in want[r["query_id"]] for r in found) / (5 * len(want))
    assert recall >= 0.95 and any(r["id"] >= 1500 for r in found)  # added ones are found without a rebuild
    held.remove(vectors.where("id >= 1500").select("id"))
    assert all(r["id"] < 1500 for r in held.search(vectors.where("id % 50 = 0"), 3, probes=4).collect())
    alone = Vectors(spark, str(tmp_path / "none"))
    alone.build(vectors.limit(0))
    assert alone.search(vectors.limit(3), 5, probes=3).isEmpty()


# Images


def image(pixels):
    return I.image_of(np.asarray(pixels, dtype=np.uint8))


def blank(h, w, value=255):
    return np.full((h, w, 3), value, dtype=np.uint8)


def panels_image(side_by_side):
    """Two dark panels with a wide white gap and narrower ones elsewhere."""
    p = blank(240, 300) if not side_by_side else blank(240, 420)
    if side_by_side:
        p[:, 5:190] = 40
        p[:, 230:415] = 90
        p[50:60, 60:80] = 255
    else:
        p[5:105] = 40
        p[135:235] = 90
        p[20:22] = 250
    return p


def frame(spark, rows, key="image_id"):
    return spark.createDataFrame(rows, f"{key} string, image {I.IMAGE}")


def test_pixels_and_png(spark):
    rng = np.random.default_rng(3)
    a, grey = rng.integers(0, 256, (7, 5, 3)), rng.integers(0, 256, (3, 4))
    rows = [("a", image(a)), ("g", {"height": 3, "width": 4, "nChannels": 1, "data": grey.astype(np.uint8).tobytes()}), ("n", None)]
    got = I.pixels_of(frame(spark, rows)).collect()
    assert len(got) == 35 + 12 and all([r["b"], r["g"], r["r"]] == a[r["y"], r["x"]].tolist() for r in got if r["image_id"] == "a") and all(r["b"] == r["r"] == grey[r["y"], r["x"]] for r in got if r["image_id"] == "g")
    data = I.png_of(frame(spark, [("a", image(a)), ("n", None)]), ["image_id"]).collect()
    assert len(data) == 1
    raw, at, parts = bytes(data[0]["png"]), 8, {}
    while at < len(raw):
        n, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        parts[kind] = raw[at + 8 : at + 8 + n]
        assert int.from_bytes(raw[at + 8 + n : at + 12 + n], "big") == zlib.crc32(kind + parts[kind])
        at += 12 + n
    back = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(7, 16)[:, 1:].reshape(7, 5, 3)[:, :, ::-1]
    assert (back == a).all()


def test_panels(spark):
    up, side, lone = panels_image(False), panels_image(True), blank(200, 200, 50)
    rows = [("up", "Figure 1. (A) one. (b) two", image(up)), ("side", "[A] x [B] y", image(side)), ("lone", "(A) x (B) y", image(lone)), ("single", "Figure. (A) only", image(up)), ("none", "(A) x (B) y", None), ("three", "(A) (B) (C)", image(up))]
    figures = spark.createDataFrame(rows, f"figure_id string, caption string, image {I.IMAGE}")
    cuts = {r["figure_id"]: (r["axis"], r["cuts"]) for r in I.panel_cuts(I.bright_lines(figures.where("image is not null"), "figure_id"), spark.createDataFrame([("up", 2), ("side", 2), ("lone", 2)], "figure_id string, panels int"), "figure_id").collect()}
    assert cuts == {"up": ("y", [(105 + 134) // 2]), "side": ("x", [(190 + 229) // 2])}
    got = {(r["figure_id"], r["panel_label"]): r for r in I.panels_of(figures).collect()}
    # rows 20 and 21 are bright as well: 'three' has enough runs for two cuts
    assert sorted(k for k in got if k[0] != "three") == [("lone", ""), ("none", ""), ("side", "A"), ("side", "B"), ("single", ""), ("up", "A"), ("up", "B")]
    assert got["up", "A"]["caption"] == "(A) one." and got["up", "B"]["caption"] == "(b) two" and got["none", ""]["image"] is None and got["single", ""]["caption"] == "Figure. (A) only"
    first, second = (I.array_of(got["up", x]["image"].asDict()) for x in "AB")
    assert (first == up[:119]).all() and (second == up[119:]).all() and (I.array_of(got["side", "B"]["image"].asDict()) == side[:, 209:]).all()


def test_crops_and_plot_areas(spark):
    page = blank(400, 300)
    page[100:200, 60:180] = 7
    rows = [("a", image(page), (60.0, 100.0, 120.0, 100.0)), ("b", image(page), (250.0, 380.0, 100.0, 100.0)), ("c", image(page), (900.0, 900.0, 10.0, 10.0)), ("d", None, (0.0, 0.0, 5.0, 5.0))]
    df = spark.createDataFrame(rows, f"figure_id string, image {I.IMAGE}, bounding_box struct<x:double,y:double,w:double,h:double>")
    got = {r["figure_id"]: I.array_of(r["image"].asDict()) for r in I.cropped(df, ["figure_id"], dpi=72, pad=10).collect()}
    assert (got["a"] == page[90:210, 50:190]).all() and got["b"].shape == (30, 60, 3) and sorted(got) == ["a", "b"]

    def brute(grey):
        """Flood fill."""
        left, boxes = {(y, x) for y, x in zip(*np.nonzero(grey < I.DARK))}, []
        while left:
            stack, seen = [left.pop()], []
            while stack:
                y, x = stack.pop()
                seen.append((y, x))
                for q in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                    if q in left:
                        left.remove(q)
                        stack.append(q)
            ys, xs = [p[0] for p in seen], [p[1] for p in seen]
            boxes.append((int(min(xs)), int(min(ys)), int(max(xs) - min(xs) + 1), int(max(ys) - min(ys) + 1)))
        return boxes

    rng = np.random.default_rng(8)
    for _ in range(30):
        grey = np.where(rng.random((14, 17)) < rng.choice([0.2, 0.4, 0.6]), 0, 255)
        boxes, found = brute(grey), I.largest_dark_box(grey)
        assert found in boxes and found[2] * found[3] == max(b[2] * b[3] for b in boxes)
    assert I.largest_dark_box(np.full((3, 3), 255)) is None
    plot = blank(120, 160)
    plot[20:100, 30] = plot[20:100, 130] = plot[20, 30:131] = plot[99, 30:131] = 0
    plot[5:8, 5:8] = 0
    got = I.plot_areas(frame(spark, [("p", image(plot)), ("w", image(blank(9, 9)))])).collect()
    assert [tuple(r) for r in got] == [("p", 30, 20, 101, 80)]


def test_colours_image_by_image(spark):
    """Two images with the same colours in different shares, one with too few coloured pixels; grey belongs to none."""
    rows, want = [], {}
    for name, counts in (("a", (200, 90, 25, 10)), ("b", (60, 60, 60, 0)), ("c", (20, 20, 5, 0))):
        x = 0
        for colour, n in zip(((200, 60, 60), (60, 200, 60), (60, 60, 200), (120, 120, 60)), counts):
            for k in range(n):
                rows.append((name, x, k % 50, *colour))
                x += 1
            if name != "c" and n >= 20:
                want.setdefault(name, []).append(n)
        rows += [(name, 1000 + k, 0, 255, 255, 255) for k in range(40)] + [(name, 2000 + k, 0, 0, 0, 0) for k in range(40)]
    pixels = spark.createDataFrame(rows, "image_id string, x int, y int, b int, g int, r int").repartition(3)
    got = {}
    for r in I.colour_clusters(pixels).collect():
        got.setdefault(r["image_id"], {}).setdefault(r["series_id"], set()).add((r["b"] // 40, r["g"] // 40, r["r"] // 40))
    assert {k: len(v) for k, v in got.items()} == {"a": 3, "b": 3} and all(len(c) == 1 for v in got.values() for c in v.values())
    sizes = I.colour_clusters(pixels).groupBy("image_id", "series_id").count().collect()
    assert {k: sorted(r["count"] for r in sizes if r["image_id"] == k) for k in want} == {k: sorted(v) for k, v in want.items()}
    # every colour goes to the nearest of the final centres
    colours = np.random.default_rng(1).integers(31, 230, (4000, 3))
    label, means = I.clusters(colours)
    assert (((colours[:, None, :] - means[None]) ** 2).sum(axis=2).argmin(axis=1) == label).all() and len(set(label.tolist())) == 5
    assert (I.clusters(colours[::-1])[0] == label[::-1]).all()


def test_digitizing(spark):
    """A red line and a blue line inside a frame come back as their points, each image by its own axes."""
    plot = blank(200, 300)
    plot[10:190, 20] = plot[189, 20:290] = plot[10, 20:290] = plot[10:190, 289] = 0
    for x in range(40, 280, 20):
        plot[100 - x // 4 : 103 - x // 4, x : x + 3] = (40, 40, 220)
        plot[150:153, x : x + 3] = (220, 40, 40)
    axes = [(i, a, *v) for i, scale in (("p", 1.0), ("q", 2.0)) for a, v in (("x", (0.0, 300.0, 0.0, 300.0 * scale, False)), ("y", (200.0, 0.0, 0.0, 200.0 * scale, False)))]
    calibration = spark.createDataFrame(axes, "image_id string, axis string, pixel_min double, pixel_max double, data_min double, data_max double, is_log boolean")
    rows = I.auto_digitize(frame(spark, [("p", image(plot)), ("q", image(plot)), ("r", image(plot))]), calibration).collect()
    flat = lambda i: sorted({round(r["y"], 3) for r in rows if r["image_id"] == i})
    assert {r["image_id"] for r in rows} == {"p", "q"} and len([r for r in rows if r["image_id"] == "p"]) == 24
    assert 49.0 in flat("p") and 98.0 in flat("q") and len(flat("p")) == 13
    pixels = I.pixels_of(frame(spark, [("p", image(plot))]))
    coords, colours = I.series_by_colour(pixels, [((0, 100, 100), (10, 255, 255)), ((110, 100, 100), (130, 255, 255)), ((60, 250, 250), (61, 255, 255))])
    got = {r["series_id"]: r["count"] for r in coords.groupBy("series_id").count().collect()}
    assert got == {0: 108, 1: 108}
    assert {r["series_id"]: (r["b"], r["g"], r["r"]) for r in colours.collect()} == {k: tuple(int(v) for v in plot[int(np.mean(ys)), int(np.mean(xs))]) for k, colour in ((0, (40, 40, 220)), (1, (220, 40, 40))) for ys, xs in [np.nonzero((plot == colour).all(axis=2))]}


# Rules of texts and answers


def test_fixed_rules(spark):
    for raw, want in (("see [10.1234/abc] ok", "10.1234/abc"), ("https://dx.doi.org/10.5555/Ab-c_(1);x..", "10.5555/Ab-c_(1);x"), ("DOI: 10.4321/q then 10.1111/first", "10.4321/q"), ("10.1/short", None)):
        assert one(spark, T.doi(F.lit(raw))) == want
    text = "Title. ABSTRACT: " + "we did things " * 10 + "Keywords: a. Introduction"
    assert one(spark, T.abstract(F.lit(text))) == re.search(r"(?is)\bAbstract\b(.{50,3000}?)\b(?:Introduction|Keywords?|Background)\b", text)[1].strip()
    assert one(spark, T.abstract(F.lit("Abstract too short Introduction"))) is None
    pattern = re.compile(r"[\(\[]([A-H])[\)\]]|(?<!\w)([A-H])\)|(?<!\w)([A-H])\.\s", re.I)
    for caption in ("(a) first (b) second", "A) x, B) y [h]", "E. coli and c. elegans. xB) no aA. no", "", "(I) none (Z)", "A. x\nB.\ty C.end"):
        want = sorted({(m[1] or m[2] or m[3]).upper() for m in pattern.finditer(caption)})
        assert one(spark, T.panel_labels(F.lit(caption))) == want, caption
        for label in "AB":
            found = re.search(rf"[\(\[]{label}[\)\]].*?(?=[\(\[][A-H][\)\]]|$)", caption, re.I | re.S)
            assert one(spark, T.panel_caption(F.lit(caption), F.lit(label))) == (found[0].strip() if found else caption)
    for text, hit in (("Fig. 1", True), ("Figs 1", True), ("figure1", True), ("FIG 12", False), ("Figures 1", False), ("config 1", False), ("Figure\n1a", False), ("(Fig.1)", True)):
        assert one(spark, F.rlike(F.lit(text), T.figure_pattern(F.lit("1")))) == bool(re.search(r"\b(?:Fig(?:ure|s?\.?)?)\.?\s*1\b", text, re.I)) == hit
    for start in ("Figure 3", "Fig. S2", "Supp. Fig. 4", "supplementary  figure 1", "Supp Fig 2"):
        assert one(spark, F.rlike(F.lit(start), F.lit(T.CAPTION_START))), start
    for start in ("see Fig. 2", "Fig x", "Figure a"):
        assert not one(spark, F.rlike(F.lit(start), F.lit(T.CAPTION_START))), start
    assert one(spark, T.keywords(F.lit("Figure shows the Growth of cells, growth1 growth panel"))) == ["growth", "cells"]
    assert one(spark, T.journal(F.lit(""), F.lit("Elsevier"))) == "Elsevier" and one(spark, T.journal(F.lit(None).cast("string"), F.lit("Adobe X"))) is None


def test_places_of_matches(spark):
    rng = random.Random(3)
    texts = ["", "none", "ab" * 700, None] + ["".join(rng.choices("ab  x\n", k=rng.randint(0, 900))) for _ in range(20)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.match_spans(F.col("t"), "a b?|ab").alias("m"), T.running_sums(F.transform(F.split("t", ""), lambda c: F.length(c) + 1)).alias("r"))
    for row in df.collect():
        t = texts[row["k"]]
        if t is not None:
            assert [tuple(m) for m in row["m"]] == [(m.start(), m.end() - m.start()) for m in re.finditer("a b?|ab", t)]
            assert row["r"] == [2 * (i + 1) for i in range(len(t))] if t else True


@pytest.mark.parametrize("raw,kind,score,data", [('{"figure_type":"western_blot","confidence":"0.9"}', "western_blot", 0.9, True), ('{"figure_type":"microscopy","confidence":0.9}', "microscopy", 0.9, False), ('{"figure_type":"microscopy","confidence":0.5}', "other", 0.5, True), ('{"figure_type":"heatmap"}', "other", 0.3, True), ("{}", "other", 0.0, False), ('{"figure_type":"heatmap","confidence":"sure"}', "other", 0.0, False), ('{"figure_type":"box_plot","confidence":1}', "other", 1.0, True), ("[1]", "other", 0.0, False), (None, "other", 0.0, False)])
def test_answers(spark, raw, kind, score, data):
    got = one(spark, J.classified(F.lit(raw).cast("string")))
    assert (got["figure_type"], got["confidence"], got["has_quantitative_data"]) == (kind, score, data)
    assert (got["reasoning"] == J.FALLBACK_REASONING) == (score == 0.0)


def test_answers_are_parsed_once(spark):
    df = spark.range(3).select(F.concat(F.lit('{"figure_type":"heatmap","confidence":'), F.col("id"), F.lit("}")).alias("a")).select(J.classified(F.col("a")).alias("c")).select("c.*")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 2 * 6 and df._jdf.queryExecution().executedPlan().toString().count("Python") == 0


def test_contexts(spark):
    filler = "Cells were grown in medium. Unrelated things happened. " * 30
    text = f"Intro\nMethods\nWe measured viability of cells. {filler}Figure 2 was made by hand.\nResults\nFirst paragraph.\n\nAs Fig. 2 shows, viability fell.\nIt did.\n\nOther text.\nDiscussion\nFigs. 2 again."
    papers = spark.createDataFrame([("p", "T", None, text)], "paper_id string, title string, doi string, full_text string")
    figures = spark.createDataFrame([("p", "p#0", "2", "Figure 2. Viability of cells", "heatmap", "around it"), ("q", "q#0", "1", None, None, None)], "paper_id string, figure_id string, figure_number string, caption string, figure_type string, surrounding_text string")
    rich = {r["figure_id"]: r for r in C.build_contexts(figures, papers).collect()}

    def brute_sentences(text, caption, number, most=1000):
        words = [w for w in re.findall(r"\b[a-zA-Z]{4,}\b", caption.lower()) if w not in T.STOP_WORDS]
        mention = re.compile(rf"\b(?:Fig(?:ure|s?\.?)?)\.?\s*{number}\b", re.I)
        scored = [(sum(k in s.lower() for k in set(words)) + (2 if mention.search(s) else 0), s) for s in re.split(r"(?<=[.!?])\s+", text)]
        out, total = [], 0
        for n, s in sorted((x for x in scored if x[0] > 0), key=lambda x: -x[0]):
            if total + len(s) > most:
                break
            out.append(s)
            total += len(s)
        return " ".join(out).strip()

    methods = text.split("Methods\n")[1].split("\nResults")[0].strip()
    r = rich["p#0"]
    assert r["methods_context"] == brute_sentences(methods, "Figure 2. Viability of cells", "2") and len(r["methods_context"]) <= 1000 + 60
    assert r["results_context"] == "As Fig. 2 shows, viability fell.\nIt did."
    assert all("2" in x for x in r["in_text_references"]) and len(r["in_text_references"]) <= 3
    assert r["context_summary"].startswith("FIGURE CAPTION: Figure 2. Viability of cells\n\nIN-TEXT DESCRIPTION: ") and "\n\nMETHODS CONTEXT: " in r["context_summary"] and "\n\nRESULTS CONTEXT: " in r["context_summary"]
    assert r["prompt"].startswith("Paper: T\nDOI: Unknown\nFigure 2 (heatmap)\n\n=== CONTEXT ===\nFIGURE CAPTION: ") and r["prompt"].endswith("Output a JSON array of series objects. No extra text.")
    assert "=== CAPTION ===\n(no caption available)" in rich["q#0"]["prompt"] and rich["q#0"]["prompt"].startswith("Paper: Unknown\n")
    near = {r["figure_id"]: r for r in C.build_contexts(figures, papers, "surrounding").collect()}
    assert "Viability of cells\n\naround it" in near["p#0"]["prompt"] and near["p#0"]["in_text_references"] == []
    with pytest.raises(ValueError):
        C.build_contexts(figures, papers, "other")
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r["context"] for r in catalog.QUERIES["scored_context"](spark, SF).collect()}
    assert got == {r["doc_id"]: brute_sentences(r["text"], "Then there were others with this thing", "3") for r in docs}


def test_figure_references_with_contexts(spark):
    """The JVM's own matches of the pattern, and what is around them."""
    rng = random.Random(23)
    parts = ["Fig. 1", "Figure 2a", "FIGS. S3 – 5", "figs 4-6", "fig.. 7", "Fig\u00a08", "xFig. 9", "Fig. 10é", "éFig. 11", "Fig. 12_", "Fig.13b", "Ｆig. 1", "ſ Figſ 2", "Fig. ٣", " word ", "\n", "\u2028", ", ", "text " * 60]
    texts = [None, ""] + ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", T.figure_references(F.col("t")).alias("r"), T.match_spans(F.col("t"), T.FIGURE_REFERENCE).alias("spans")).collect():
        t, spans = r["t"], [(x["s"], x["s"] + x["n"]) for x in r["spans"] or ()]
        got = None if r["r"] is None else [tuple(x) for x in r["r"]]
        assert got == (None if t is None else [(t[a:b].strip(T.SPACES), t[max(a - 200, 0) : b + 200].strip(T.SPACES)) for a, b in spans])


def test_scans_hand_on_part_by_part():
    """What is found in a batch of texts never comes as one array, whatever their number or length; nothing is lost between parts."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("s", pa.string()), ("n", pa.int32())]))
    one = lambda t: [(t[:3], k) for k in range(len(t) % 4)]
    texts = [None, "", "x" * (T.SCAN_CHARS + 2), *["word " * (k % 7) for k in range(2000)], None]
    parts = list(T.in_parts(iter([pa.array(texts), pa.array([], pa.string()), pa.array(["abcde"])]), kind, one))
    assert max(map(len, parts)) <= T.SCAN_TEXTS and len(parts[0]) == 2 and len(parts[1]) == 1
    assert [x for part in parts for x in part.to_pylist()] == [None if t is None else [{"s": s, "n": n} for s, n in one(t)] for t in [*texts, "abcde"]]


def test_workers_dont_hold_all_that_is_found(spark):
    """Texts whose references are some 40 times as long as they are: the memory of the worker that scans them."""
    script = """if True:
        import resource, sys
        from pyspark.sql import SparkSession, functions as F
        from inkquarry.functions import text as T
        from inkquarry.operators.context import mention_windows
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
        t = spark.range(0, 4000, 1, 1).select(F.concat(F.repeat(F.lit("Fig. 1, "), 500), F.col("id").cast("string")).alias("t"))
        found = t.select(F.size(T.figure_references(F.col("t"))).alias("a"), F.size(mention_windows(F.col("t"), 2)).alias("b"))
        print("counts", found.agg(F.sum("a"), F.sum("b")).first()[:])
        peak = lambda batches: ([b for b in batches], __import__("pandas").DataFrame({"kb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss]}))[1:]
        print("kb", spark.range(0, 1, 1, 1).mapInPandas(lambda b: iter(peak(b)), "kb long").first()[0])
    """
    import os
    import subprocess
    import sys

    env = {k: v for k, v in os.environ.items() if k != "PYSPARK_GATEWAY_PORT"}
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, env=env, timeout=300, cwd=Path(__file__).parent.parent).stdout
    assert "counts (2000000, 2000000)" in out and int(out.split("kb ")[1]) < 700_000, out


def brute_mentions(text, number):
    snippets = []
    for m in re.finditer(rf"\b(?:Fig(?:ure|s?\.?)?)\.?\s*{re.escape(number.strip())}\b", text, re.I):
        snippets.append(text[max(m.start() - 300, 0) : m.end() + 300].strip().replace("\n", " "))
    kept = []
    for s in sorted(snippets, key=len, reverse=True):

        def near(a, b):
            short, long = sorted((a, b), key=len)
            return sum(c in long for c in short) / len(long) if short else 0.0

        if len(kept) < 3 and all(near(s, k) <= 0.6 for k in kept):
            kept.append(s)
    return kept


def test_mentions_of_many_figures(spark):
    """The index of mentions against one search of the whole text per figure."""
    import random

    rng = random.Random(17)
    forms = ["Fig. {}", "Figure {}", "Figs.{}", "FIGS {}", "fig.. {}", "Figure  \n{}", "figs.. {}", "Fig{}", "Config 1 {}", "Figures {}", "Fig. {}-9", "(Fig. {}a)"]
    numbers = ["1", "2", "12", "S3", "1a", " 4 ", "3.1", "(2)", "no"]
    papers, figures = [], []
    for p in range(12):
        text = "".join(("".join(rng.choices("abcdefgh \n", k=rng.choice([3, 40, 700]))) + " " + rng.choice(forms).format(rng.choice(numbers).strip()) + rng.choice([" ", ".", ", "])) for _ in range(rng.choice([0, 1, 5, 40])))
        papers.append((f"p{p}", None, None, text if p else None))
        figures += [(f"p{p}", f"p{p}#{k}", n, "Caption about viability") for k, n in enumerate(numbers)]
    figures.append(("gone", "gone#0", "1", None))
    papers_df = spark.createDataFrame(papers, "paper_id string, title string, doi string, full_text string")
    figures_df = spark.createDataFrame(figures, "paper_id string, figure_id string, figure_number string, caption string")
    got = {r["figure_id"]: r["in_text_references"] for r in C.build_contexts(figures_df, papers_df).collect()}
    texts = {p: t or "" for p, _, _, t in papers}
    assert got == {f: brute_mentions(texts.get(p, ""), n) for p, f, n, _ in figures} and sum(map(len, got.values())) > 20


def test_greedy_choices(spark):
    def ratio(a, b):
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        return sum(c in long for c in short) / len(long) if short else 0.0

    def brute(snippets):
        kept = []
        for s in sorted(snippets, key=len, reverse=True):
            if len(kept) < 3 and all(ratio(s, k) <= 0.6 for k in kept):
                kept.append(s)
        return kept

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert {r["doc_id"]: r["kept"] for r in catalog.QUERIES["greedy_dedupe"](spark, SF).collect()} == {r["doc_id"]: brute(r["text"].split("\n")) for r in docs}

    def match(truth, predicted):
        left, out, norm = list(enumerate(predicted)), [], lambda x: x.strip().lower()
        for t, name in enumerate(map(norm, truth)):
            for test in (lambda p: p == name, lambda p: name in p or p in name, lambda p: True):
                hit = next((e for e in left if test(norm(e[1]))), None)
                if hit:
                    left.remove(hit)
                    out.append((t, hit[0]))
                    break
        return out

    names = {}
    for r in spark.read.parquet(f"{SF}/nation.parquet").collect():
        names.setdefault(r["n_regionkey"], []).append(r["n_name"])
    want = {k: match(sorted(v), [x[:4].lower() for x in sorted(v)][::-1]) for k, v in names.items()}
    assert {r["n_regionkey"]: [tuple(p) for p in r["pairs"]] for r in catalog.QUERIES["greedy_match"](spark, SF).collect()} == want
    rng = random.Random(7)
    for _ in range(12):
        pick = lambda: [rng.choice(["a", "A ", "ab", "b", "", "abc", "x"]) for _ in range(rng.randint(0, 5))]
        t, p = pick(), pick()
        arr = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
        assert [tuple(x) for x in one(spark, M.match_series(arr(t), arr(p)))] == match(t, p)


def test_clusters_and_generated_rows(spark):
    rows = catalog.QUERIES["kmeans_clusters"](spark, SF).collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert len(rows) == len(vectors) and len({r["cluster"] for r in rows}) == 10
    means = {c: np.mean([vectors[r["vec_id"]] for r in rows if r["cluster"] == c], axis=0) for c in {r["cluster"] for r in rows}}
    inside = sum(((vectors[r["vec_id"]] - means[r["cluster"]]) ** 2).sum() for r in rows)
    total = np.mean(list(vectors.values()), axis=0)
    assert inside < sum(((v - total) ** 2).sum() for v in vectors.values())
    part = spark.read.parquet(f"{SF}/part.parquet").collect()
    pixels = [(k % 97, k % 89, k * 7 % 256, k * 13 % 256, k * 29 % 256) for k in (r["p_partkey"] for r in part)]
    bright = [p for p in pixels if all(30 < c < 230 for c in p[2:])]
    label, _ = I.clusters(np.array([p[2:] for p in bright]))
    want = sorted((*p, int(k)) for p, k in zip(bright, label) if (label == k).sum() >= 20)
    assert sorted((r["x"], r["y"], r["b"], r["g"], r["r"], r["series_id"]) for r in catalog.QUERIES["colour_series"](spark, SF).collect()) == want
    made = catalog.QUERIES["synth_rows"](spark, SF).collect()
    parts = spark.read.parquet(f"{SF}/part.parquet").select(F.col("p_partkey").alias("plot_id"))
    plots = {r["plot_id"]: r for r in synthetic.plots_of(parts).collect()}
    assert len(plots) == parts.count() and {r["plot_id"]: r for r in synthetic.plots(spark, 9).collect()}[5] == plots[5]
    by_plot = {}
    for r in made:
        by_plot.setdefault(r["plot_id"], []).append(r)
    for k, p in plots.items():
        mine = by_plot[k]
        assert len(mine) == p["n_series"] * p["n_points"] and all(r["plot_type"] == p["plot_type"] for r in mine)
        low, high = {"line_plot": (1, 4), "bar_chart": (1, 3), "scatter_plot": (1, 1), "heatmap": (4, 9)}[p["plot_type"]]
        assert low <= p["n_series"] <= high and str(p["n_points"] if p["plot_type"] == "scatter_plot" else p["n_series"]) in p["caption"]


# Boundaries and the whole process


class Flaky:
    """Fails the first calls of each prompt, each in its way."""

    def __init__(self, path):
        self.path = path

    def __call__(self, prompt, image):
        from urllib.error import HTTPError, URLError

        mark = self.path + "/" + prompt.replace(" ", "_")
        with open(mark, "a") as f:
            f.write("x")
        with open(mark) as f:
            calls = len(f.read())
        if prompt == "refused" and calls < 3:
            raise URLError(ConnectionRefusedError(111, "refused"))
        if prompt == "never":
            raise TimeoutError("slow")
        if prompt == "bad":
            raise HTTPError("http://x", 400, "no such model", None, None)
        if prompt == "bug":
            raise KeyError("oops")
        return f"{prompt} {len(image or b'')}"


def test_infer_retries(spark, tmp_path):
    df = spark.createDataFrame([("fine", b"abc"), ("refused", None), ("never", b""), ("bad", b"x"), ("bug", b"x"), (None, b"")], "prompt string, image binary").coalesce(1)
    got = {r["prompt"]: (r["answer"], r["answer_error"]) for r in files.infer(df.where("prompt is not null"), Flaky(str(tmp_path)), image="image", wait=0.01).collect()}
    assert got["fine"] == ("fine 3", None) and got["refused"] == ("refused 0", None)
    assert got["never"][0] is None and "3 attempts" in got["never"][1] and got["bad"] == (None, "HTTP 400: no such model") and "oops" in got["bug"][1]
    calls = {p.name: len(p.read_text()) for p in tmp_path.iterdir()}
    assert calls == {"fine": 1, "refused": 3, "never": 3, "bad": 1, "bug": 1}


class Counted:
    """A model that notes each question, and dies at one of them until told not to."""

    def __init__(self, folder, dies_at):
        self.folder, self.dies_at = folder, dies_at

    def __call__(self, prompt, image=None):
        with open(f"{self.folder}/{prompt}", "a") as f:
            f.write("x")
        if prompt == self.dies_at and not Path(self.folder, "mended").exists():
            import os

            os._exit(1)  # the worker is gone, as on a lost executor
        if prompt == "refused":
            raise KeyError("no")
        return f"answer to {prompt}"


def test_answers_outlive_lost_workers(spark, tmp_path):
    marks, memo = tmp_path / "marks", str(tmp_path / "memo")
    marks.mkdir()
    questions = spark.createDataFrame([(f"q{k}", bytes([k % 3]) if k % 2 else None) for k in range(12)] + [("refused", None), ("q1", bytes([1])), (None, None)], "prompt string, image binary").where("prompt is not null").coalesce(1)
    model = Counted(str(marks), "q9")
    run = lambda calls: {(r["prompt"]): (r["answer"], r["answer_error"]) for r in files.infer(questions, model, image="image", memo=memo, calls=calls).collect()}
    with pytest.raises(Exception):  # noqa: B017
        run(1)
    before = {p.name for p in marks.iterdir()}
    assert {"q0", "q8", "q9"} <= before and "q10" not in before
    (marks / "mended").write_text("")
    got = run(3)
    assert all(got[f"q{k}"] == (f"answer to q{k}", None) for k in range(12)) and got["refused"][0] is None
    calls = {p.name: len(p.read_text()) for p in marks.iterdir() if p.name != "mended"}
    assert all(calls[f"q{k}"] == 1 for k in range(12) if k != 9) and calls["q9"] == 2  # what was answered before the loss is not asked again
    again = run(3)
    assert again == got and {p.name: len(p.read_text()) for p in marks.iterdir() if p.name != "mended"} == calls | {"refused": calls["refused"] + 1}
    other = Counted(str(marks), "none")  # another model has answers of its own
    files.infer(questions, other, image="image", memo=memo).collect()
    assert len((marks / "q0").read_text()) == 2


def test_http_model(spark):
    import http.server
    import threading

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self.answer({"models": [{"name": "library/gemma4:4b-it"}]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body))
            self.answer({"message": {"content": "hi"}} if self.path.endswith("chat") else {"response": "out"})

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        model = files.HttpModel(f"http://127.0.0.1:{server.server_port}", system="be brief")
        assert model("ask", b"\x89PNG\r\n\x1a\n") == "out" and model("ask") == "out" and model.chat([{"role": "user", "content": "x"}]) == "hi" and model.available()
        assert not files.HttpModel(f"http://127.0.0.1:{server.server_port}", "other").available()
    finally:
        server.shutdown()
    (path, first), (_, second), (chat, third) = seen
    assert path == "/api/generate" and first["images"] == ["iVBORw0KGgo="] and first["options"]["num_ctx"] == 4096 and first["format"] == "json" and first["system"] == "be brief"
    assert "images" not in second and second["options"]["num_ctx"] == 2048 and chat == "/api/chat" and third["messages"][0]["content"] == "x"
    assert not files.HttpModel("http://127.0.0.1:9", timeout=1).available()


def rich_parser(content):
    name = content.decode().splitlines()[0]
    if name == "broken":
        raise ValueError("encrypted")
    pages = [f"A title on the page\nResults\nFig. 1 shows growth of {name}.", "page two", "drawn"]
    figure = lambda caption, picture, **more: {"figure_number": "1", "page_number": 1, "caption": caption, "x1": 10.0, "y1": 10.0, "x2": 150.0, "y2": 120.0, "source": "raster", "image": picture} | more
    figures = [figure("Figure 1. (A) up. (B) down", image(panels_image(False))), figure("Figure 1. twin", image(blank(150, 150, 60))), figure("tiny", None, x2=20.0, y2=20.0), figure("small picture", image(blank(90, 200)))]
    spans = [{"page": 0, "type": 0, "text": " A sniffed title of it ", "font_size": 20.0}, {"page": 0, "type": 0, "text": "short", "font_size": 40.0}, {"page": 0, "type": 1, "text": "an image block, large", "font_size": 50.0}, {"page": 1, "type": 0, "text": "another page, larger", "font_size": 60.0}]
    info = [{"width": 600.0, "height": 800.0, "n_paths": 99}, {"width": 600.0, "height": 800.0, "n_paths": 30}, {"width": 600.0, "height": 800.0, "n_paths": 31, "image": image(blank(200, 150, 9))}]
    return {"pages": pages, "title": "", "author": "A; B", "creator": None, "producer": "A Press", "figures": figures if name != "plain" else [], "spans": spans, "page_info": info}


def by_image(prompt, picture):
    """Answers that tell which image and caption were asked about."""
    caption = prompt.split("Figure caption: ")[-1].split("\n")[0]
    if "twin" in caption:
        raise TimeoutError("too slow")
    return json.dumps({"figure_type": "heatmap", "confidence": 0.9, "reasoning": f"{len(picture or b'')}"})


def series_of(prompt, picture):
    assert picture is None or picture.startswith(b"\x89PNG")
    label = re.search(r"\(([AB])\)", prompt)
    return json.dumps([{"series_name": label[1] if label else None, "data_points": [{"x": 1, "y": 2}], "statistical_annotations": []}, "no object", {"x_label": "only"}])


def better(content):
    name = content.decode().splitlines()[0]
    if name == "fails":
        raise RuntimeError("no extractor")
    return {"figures": [{"figure_number": "9", "page_number": 2, "caption": "better", "x1": 0.0, "y1": 0.0, "x2": 200.0, "y2": 200.0, "source": "pdffigures2"}] if name == "primary" else []}


def test_process_whole(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for name in ("full", "plain", "broken", "primary", "fails"):
        (src / f"{name}.pdf").write_text(f"{name}\n")
    store = Store(spark, str(tmp_path / "s"))
    settings = Settings(model_attempts=1)
    found = lambda: files.documents(spark, str(src))
    for _ in range(2):  # the second run replaces and repeats nothing
        out = process(found(), store, rich_parser, by_image, series_of, primary=better, settings=settings)
    papers = {r["pdf_path"].rsplit("/", 1)[1]: r for r in out["papers"].collect()}
    assert sorted(papers) == ["fails.pdf", "full.pdf", "plain.pdf", "primary.pdf"] and papers["full.pdf"]["title"] == "A sniffed title of it" and papers["full.pdf"]["journal"] == "A Press" and papers["full.pdf"]["authors"] == ["A", "B"]
    figures = out["figures"].collect()
    mine = lambda name: sorted((r["figure_number"], r["panel_label"], r["page_number"], r["caption"]) for r in figures if r["paper_id"] == papers[f"{name}.pdf"]["id"])
    twice = [("1", "", 1, "Figure 1. twin"), ("1", "A", 1, "(A) up."), ("1", "B", 1, "(B) down")]
    # the drawn page has no figure number of its own and is counted
    assert [f for f in mine("full") if f[2] == 1] == twice and [f[2:] for f in mine("full") if f[2] != 1] == [(3, "")]
    assert mine("fails") == mine("full") and [f[2:] for f in mine("plain")] == [(1, ""), (3, "")] or [f[2:] for f in mine("plain")] == [(3, "")]
    assert mine("primary") == [("9", "", 2, "better")]
    panel = next(r for r in figures if r["panel_label"] == "A")
    assert panel["confidence_score"] == pytest.approx(0.8 * 0.95) and panel["image_path"] == f"figures/{panel['paper_id']}/0000_A.png" and next(r for r in figures if r["caption"] == "better")["confidence_score"] == 0.95
    by_id = {r["id"]: r for r in figures}
    series = out["series"].collect()
    named = [(by_id[s["figure_id"]]["panel_label"], s["series_name"]) for s in series if by_id[s["figure_id"]]["paper_id"] == papers["full.pdf"]["id"]]
    assert ("A", "A") in named and ("B", "B") in named and ("A", "B") not in named and ("B", "A") not in named
    assert all(s["series_name"] is not None and s["extraction_method"] == "gemma4_multimodal" and s["confidence_score"] == 0.5 for s in series)
    errors = [(r["error_type"], r["error_message"]) for r in out["errors"].collect()]
    assert len(errors) == len(set(errors)) and sum(k == "parse" for k, _ in errors) == 1 and sum(k == "classify" for k, _ in errors) == 2 and any("too slow" in m for _, m in errors)
    assert {bytes(r["png"])[:4] for r in out["images"].collect()} == {b"\x89PNG"}
    near = process(found(), Store(spark, str(tmp_path / "s2")), rich_parser, by_image, series_of, mode="surrounding", settings=settings, most_figures=1)
    assert max(r["count"] for r in near["figures"].where("panel_label = ''").groupBy("paper_id").count().collect()) == 1


def page_parser(content):
    """Figures by their boxes alone, on pages that are rendered."""
    picture = blank(400, 300)
    picture[100:200, 50:200] = 60
    return {"pages": ["Some page"], "figures": [{"figure_number": "3", "page_number": 1, "caption": "c", "x1": 50.0, "y1": 100.0, "x2": 200.0, "y2": 200.0, "source": "raster"}], "page_info": [{"width": 300.0, "height": 400.0, "n_paths": 0, "image": image(picture)}]}


def test_crops_and_extractor_output_in_process(spark, tmp_path):
    src, made = tmp_path / "in", tmp_path / "json"
    src.mkdir(), made.mkdir()
    for name in ("a", "b", "c"):
        (src / f"{name}.pdf").write_text(f"{name}\n")
    (made / "b.json").write_text(json.dumps([{"figType": "Table", "name": "7", "caption": "by the extractor", "page": 0, "captionBoundary": {"x1": 0, "y1": 0, "x2": 250, "y2": 250}}]))
    (made / "c.json").write_text("{broken")
    primary = files.extractor_output(spark, str(made))
    settings = Settings(image_dpi=72, least_figure_area=100, model_attempts=1)
    out = process(files.documents(spark, str(src)), Store(spark, str(tmp_path / "s")), page_parser, by_image, series_of, primary=primary, settings=settings, require_image=True)
    papers = {r["id"]: r["pdf_path"][-5] for r in out["papers"].collect()}
    got = sorted((papers[r["paper_id"]], r["figure_number"], r["caption"], r["image_path"] is not None) for r in out["figures"].collect())
    assert got == [("a", "3", "c", True), ("b", "7", "by the extractor", True), ("c", "3", "c", True)]
    assert out["series"].count() == 6 and {r["figure_id"].rsplit("/", 1)[1][0]: len(r["png"]) > 50 for r in out["images"].collect()} == {"a": True, "b": True, "c": True}
    bare = process(files.documents(spark, str(src)), Store(spark, str(tmp_path / "s2")), lambda c: page_parser(c) | {"page_info": []}, by_image, series_of, settings=settings, require_image=True)
    assert bare["figures"].count() == 3 and bare["series"].isEmpty()
    assert not files.extractor_available(str(tmp_path / "no.jar"))


def test_watch_repeats_no_errors(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "b.pdf").write_text("broken\n")
    store = Store(spark, str(tmp_path / "s"))
    for k in range(2):  # a lost checkpoint makes the batch run again
        watch(spark, str(src), store, str(tmp_path / f"check{k}"), by_image, series_of, rich_parser).awaitTermination()
    assert store.read("errors").count() == 1


def test_pages_and_renderings(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("full\n")
    (tmp_path / "b.pdf").write_text("broken\n")
    found = files.documents(spark, str(tmp_path))
    parsed = files.parse(found, rich_parser)
    pages = files.page_texts(parsed.where("error is null"))
    assert [(r["page_idx"], r["maybe_scanned"]) for r in pages.orderBy("page_idx").collect()] == [(0, True), (1, True), (2, True)] and files.page_text(pages, 2).first()["text"] == "page two"
    assert [(r["page"], r["figure_ref"]) for r in files.references(pages).collect()] == [(0, "Fig. 1")] and "growth of full" in files.references(pages).first()["context"]
    made = files.render(found, lambda content: (_ for _ in ()).throw(ValueError()) if b"broken" in content else [exports.png(blank(2, 3)), exports.png(blank(1, 1))]).collect()
    assert [(r["page_idx"], bytes(r["png"])[:4]) for r in made] == [(0, b"\x89PNG"), (1, b"\x89PNG")]
    assert [r["text"] for r in files.text_spans(parsed).collect()] == ["A sniffed title of it", "short", "another page, larger"]


# Collections, training data, benchmark, command line


def articles_page(number):
    return [{"doi": f"10.1/{number}-{k}" if k % 2 else "", "n": k} for k in range(4)] if number < 4 else []


def half_usable(number):
    return [{"doi": f"10.1/{number}-{k}" if k % 2 else None} for k in range(10)] if number < 30 else []


def sets_page(number):
    if number == 2:
        raise TimeoutError("slow")
    return [{"id": 10 * number + k, "files": [{"name": "x.txt", "url": "t"}, {"name": f"{k}.PNG", "url": f"i{k}"}, {"name": "d.csv", "url": f"c{k}"}, {"name": "e.csv", "url": "late"}][: 3 + k % 2 if k else 2]} for k in range(3)]


def few_pairs(number):
    return sets_page(number if number != 2 else 200) if number < 40 else []


MARKS = Path(tempfile.gettempdir()) / "inkquarry-test-marks"


def fails_once(number):
    mark = MARKS / f"page-{number}"
    if number in (2, 3) and not mark.exists():
        mark.write_text("asked")
        raise ConnectionError("gone")
    return half_usable(number)


def test_collections(spark):
    module = "tests.test_engine"
    got = [r["doi"] for r in collect.articles(spark, f"{module}:articles_page", 5, per_page=1).collect()]
    assert got == ["10.1/1-1", "10.1/1-3", "10.1/2-1", "10.1/2-3", "10.1/3-1"]
    assert len(collect.articles(spark, f"{module}:articles_page", 100).collect()) == 6  # all there are
    assert collect.articles(spark, f"{module}:articles_page", 0).isEmpty()


def test_collections_go_on_until_enough(spark, tmp_path):
    module, folder = "tests.test_engine", str(tmp_path / "c")
    want = [f"10.1/{p}-{k}" for p in range(1, 30) for k in range(1, 10, 2)]
    assert [r["doi"] for r in collect.articles(spark, f"{module}:half_usable", 20, folder=folder).collect()] == want[:20]
    assert collect.asked_pages(spark, folder).agg(F.max("page")).first()[0] <= 6  # and asks for no more than the yield suggests
    assert [r["doi"] for r in collect.articles(spark, f"{module}:half_usable", 40, folder=folder).collect()] == want[:40]  # goes on where it ended
    pairs = collect.dataset_pairs(spark, f"{module}:few_pairs", 50).collect()
    assert [r["article_id"] for r in pairs] == [10 * p + k for p in [1, 200, *range(3, 26)] for k in (1, 2)] and pairs[0]["image_url"] == "i1"


def test_pages_that_fail(spark, tmp_path, caplog):
    module = "tests.test_engine"
    # page 2 never comes: the collection ends before it and says so
    folder = str(tmp_path / "never")
    got = collect.dataset_pairs(spark, f"{module}:sets_page", 75, folder=folder).collect()
    assert sorted((r["article_id"], r["image_url"], r["csv_url"]) for r in got) == [(11, "i1", "c1"), (12, "i2", "c2")]
    assert [tuple(r) for r in collect.failed_pages(spark, folder).collect()] == [(2, "TimeoutError: slow")] and "page 2" in caplog.text
    rounds = {p.name for p in (tmp_path / "never/pages").iterdir() if p.name.startswith("round")}
    assert rounds == {"round=0", "round=1", "round=2"}  # it was asked three times


def test_pages_that_fail_once(spark, tmp_path):
    folder = str(tmp_path / "once")
    for p in MARKS.glob("page-*"):
        p.unlink()
    MARKS.mkdir(exist_ok=True)
    got = [r["doi"] for r in collect.articles(spark, "tests.test_engine:fails_once", 20, per_page=5, folder=folder).collect()]
    assert got == [f"10.1/{p}-{k}" for p in range(1, 5) for k in range(1, 10, 2)] and collect.failed_pages(spark, folder).isEmpty()
    assert len(list(MARKS.glob("page-*"))) == 2


def test_training_pairs(spark, tmp_path):
    plots = synthetic.plots(spark, 12)
    points = synthetic.points(plots)
    assert synthetic.save_pairs(plots, points, str(tmp_path / "deep" / "er"), images=False) == 24
    stems = {r["stem"]: r for r in plots.collect()}
    for p in (tmp_path / "deep/er").glob("*.csv"):
        kind = stems[p.stem]["plot_type"]
        lines = p.read_text().splitlines()
        assert lines[0] == {"line_plot": "series,x,y,err_y", "bar_chart": "series,category,value,err", "scatter_plot": "x,y", "heatmap": "row,col,value"}[kind]
        assert len(lines) - 1 == stems[p.stem]["n_series"] * stems[p.stem]["n_points"] == json.loads((p.parent / f"{p.stem}_meta.json").read_text())["n_rows"]
        if sorted(stems).index(p.stem) % 2:
            (p.parent / f"{p.stem}.png").write_bytes(exports.png(blank(3, 3)))
    (tmp_path / "deep/er/zz_meta.json").write_text("[broken")
    (tmp_path / "deep/er/zz.png").write_bytes(b"x")
    pairs = files.training_pairs(spark, str(tmp_path)).collect()
    assert sorted(r["stem"] for r in pairs) == sorted(stems)[1::2] and all(r["caption"] == stems[r["stem"]]["caption"] for r in pairs)
    truth = json.loads(pairs[0]["ground_truth"])
    assert len(truth) == stems[pairs[0]["stem"]]["n_series"] and len(truth[0]["data_points"]) == stems[pairs[0]["stem"]]["n_points"]


def test_drawn_plots(spark, tmp_path):
    from inkquarry.sources import plots as P

    made = synthetic.plots(spark, 24)
    points = synthetic.points(made)
    assert synthetic.save_pairs(made, points, str(tmp_path)) == 72
    assert files.training_pairs(spark, str(tmp_path)).count() == 24  # every plot has its image
    kinds, rows = {r["plot_id"]: r["plot_type"] for r in made.collect()}, {}
    for r in points.orderBy("series", "i").collect():
        rows.setdefault(r["plot_id"], []).append(r)
    assert set(kinds.values()) == set(synthetic.KINDS)
    drawn = P.plot_images(points)
    left, top, right, bottom = P.FRAME
    for r in drawn.collect():
        pixels, kind, mine = I.array_of(r["image"].asDict()), kinds[r["plot_id"]], rows[r["plot_id"]]
        px = lambda x: left + (x - r["x_min"]) / (r["x_max"] - r["x_min"]) * (right - left)  # noqa: B023, E731
        py = lambda y: bottom - (y - r["y_min"]) / (r["y_max"] - r["y_min"]) * (bottom - top)  # noqa: B023, E731
        n = max(p["series"] for p in mine) + 1
        last = [p for p in mine if p["series"] == n - 1]
        if kind == "heatmap":
            columns = len(last)
            for p in mine:
                cell = pixels[round(top + (bottom - top) * (p["series"] + 0.5) / n), round(left + (right - left) * (p["i"] + 0.5) / columns)]
                assert abs(P.cell_value(cell) - p["y"]) < 0.004
        elif kind == "bar_chart":
            wide = 0.8 * (right - left) / len(last) / n
            for p in mine:  # the top of each bar, beside its error bar
                x = round(px(p["i"]) + (p["series"] - (n - 1) / 2) * wide - wide / 4)
                column = np.flatnonzero((pixels[top + 1 : bottom, x] == P.COLOURS[p["series"]]).all(axis=1)) + top + 1
                assert abs(column.min() - py(p["y"])) <= 1.5
        else:  # nothing is drawn over the markers of the last series
            assert all((pixels[round(py(p["y"])), round(px(p["x"]))] == P.COLOURS[n - 1]).all() for p in last)
    for by in ("dark", "edges"):
        areas = {(r["x"], r["y"], r["x"] + r["w"], r["y"] + r["h"]) for r in I.plot_areas(drawn.select(F.col("plot_id").alias("image_id"), "image"), by).collect()}
        assert all(abs(a - b) <= 6 for area in areas for a, b in zip(area, (left, top, right, bottom)))  # the frame with its ticks


def test_digitised_plots_are_near_the_truth(spark):
    """From drawn points to digitised ones: each within two pixels."""
    from inkquarry.sources import plots as P

    rng = np.random.default_rng(4)
    truth = {k: [(10.0 * i + k, float(v)) for i, v in enumerate(rng.random(25) * 100)] for k in range(3)}
    rows = [(k, "scatter_plot", 0, i, x, y, None) for k, pts in truth.items() for i, (x, y) in enumerate(pts)]
    images = P.plot_images(spark.createDataFrame(rows, "plot_id long, plot_type string, series int, i int, x double, y double, err_y double"))
    for by in ("dark", "edges"):
        got = {}
        for r in I.auto_digitize(images.select(F.col("plot_id").cast("string").alias("image_id"), "image"), P.calibration(images), by=by).collect():
            got.setdefault(int(r["image_id"]), []).append((r["x"], r["y"]))
        for r in images.collect():
            one_x, one_y = (r["x_max"] - r["x_min"]) / (P.FRAME[2] - P.FRAME[0]), (r["y_max"] - r["y_min"]) / (P.FRAME[3] - P.FRAME[1])
            mine = sorted(got[r["plot_id"]])
            assert len(mine) == 25 and all(abs(a[0] - b[0]) <= 2 * one_x and abs(a[1] - b[1]) <= 2 * one_y for a, b in zip(mine, sorted(truth[r["plot_id"]])))


def brute_edges(grey, low=50, high=150):
    """Canny's steps pixel by pixel."""
    h, w = grey.shape
    g = lambda y, x: int(grey[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
    grad = {}
    for y in range(h):
        for x in range(w):
            gx = sum(k * (g(y + d, x + 1) - g(y + d, x - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(k * (g(y + 1, x + d) - g(y - 1, x + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            grad[y, x] = gx, gy, abs(gx) + abs(gy)
    m = lambda y, x: grad.get((y, x), (0, 0, 0))[2]
    weak = set()
    for (y, x), (gx, gy, n) in grad.items():
        t = np.tan(np.pi / 8)
        if abs(gy) < abs(gx) * t:
            peak = n > m(y, x - 1) and n >= m(y, x + 1)
        elif abs(gy) > abs(gx) / t:
            peak = n > m(y - 1, x) and n >= m(y + 1, x)
        else:
            s = 1 if (gx < 0) == (gy < 0) else -1
            peak = n > m(y - 1, x - s) and n > m(y + 1, x + s)
        if peak and n > low:
            weak.add((y, x))
    kept, waiting = set(), [p for p in weak if m(*p) > high]
    while waiting:
        p = waiting.pop()
        if p in kept:
            continue
        kept.add(p)
        waiting += [q for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (q := (p[0] + dy, p[1] + dx)) in weak]
    return kept


def test_edges_against_brute_force():
    rng = np.random.default_rng(11)
    for k in range(6):
        grey = rng.integers(0, 60, (40, 50)) + 150
        grey[5:30, 8:40] = rng.integers(0, 40 + 10 * k, (25, 32))
        got = I.edge_map(grey)
        assert set(zip(*map(list, np.nonzero(got)))) == brute_edges(grey)
        label, n = I.connected(got)
        assert (label > 0).sum() == got.sum() and n == label.max() + 1
    # a filled disc: the outline's area is that of the pixels' centres
    y, x = np.mgrid[:60, :60]
    label, n = I.connected((y - 30) ** 2 + (x - 30) ** 2 <= 400)
    assert n == 2 and I.polygon_area(I.outer_border(label, 1, 10, 30)) == pytest.approx(np.pi * 400, rel=0.05)
    for one in (np.eye(9, dtype=bool), np.ones((1, 9), dtype=bool), np.ones((1, 1), dtype=bool)):  # lines enclose nothing
        label, _ = I.connected(one)
        assert I.polygon_area(I.outer_border(label, 1, 0, 0)) == 0
    assert I.largest_outline(np.full((20, 20), 200)) is None


@pytest.mark.parametrize(("ground", "frame", "noise"), [(255, 20, 0), (255, 20, 12), (225, 150, 6), (40, 230, 6), (255, 205, 0)])
def test_plot_area_of_noisy_and_tinted_frames(ground, frame, noise):
    rng = np.random.default_rng(ground + noise)
    pixels = np.full((240, 320, 3), ground, dtype=float)
    pixels[30:200, 40:290] = frame
    pixels[33:197, 43:287] = ground
    for k in range(60):
        pixels[110:112, 50 + 4 * k : 53 + 4 * k] = (30, 90, 220)
    pixels = np.clip(pixels + rng.normal(0, noise or 1e-9, pixels.shape), 0, 255).astype(np.uint8)
    x, y, w, h = I.largest_outline(I.grey_of(pixels))
    assert abs(x - 40) <= 3 and abs(y - 30) <= 3 and abs(w - 250) <= 6 and abs(h - 170) <= 6


def exact_answer(prompt, picture):
    if "Figure good" in prompt:
        return json.dumps([{"series_name": "b", "data_points": [{"x": 0, "y": 5}]}, {"series_name": "A ", "data_points": [{"x": 0, "y": 1}, {"x": 1, "y": 2}, {"x": 2, "y": 9}]}])
    return "nothing"


def test_benchmark_folder_and_cli(spark, tmp_path, capsys):
    folder = tmp_path / "bench"
    folder.mkdir()
    truth = [{"figure_type": "line_plot", "series_name": "a", "data_points": [{"x": 0, "y": 1}, {"x": 1, "y": 2}]}, {"figure_type": "heatmap", "series_name": "b", "data_points": [{"x": 0, "y": 5}, {"x": 1, "y": 500}]}]
    for name, text, picture in (("good", json.dumps(truth), True), ("lost", json.dumps(truth), False), ("torn", "{not json", True), ("mute", json.dumps(truth[1:]), True)):
        (folder / f"{name}_ground_truth.json").write_text(text)
        if picture:
            (folder / f"{name}.png").write_bytes(b"png")
    got = {r["figure"]: r for r in cli.benchmark_folder(spark, str(folder), exact_answer).collect()}
    # series are cut to the shorter of both, so 500 and 9 take no part
    assert (got["good"]["rmse"], got["good"]["r2"], got["good"]["passed"], got["good"]["figure_type"]) == (0.0, 1.0, True, "line_plot")
    assert got["mute"]["rmse"] is None and not got["mute"]["passed"] and got["lost"]["skipped"] and got["torn"]["skipped"]
    assert cli.main(["benchmark", "--test-set", str(folder), "--extract", "tests.test_engine:exact_answer"], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    spark.conf.set("spark.inkquarry.rmse_threshold", "-1.0")
    try:
        assert not any(r["passed"] for r in cli.benchmark_folder(spark, str(folder), exact_answer).collect())
    finally:
        spark.conf.unset("spark.inkquarry.rmse_threshold")
    assert lines[:4] == ["Total figures : 4", "Passed        : 1", "Failed        : 1", "Pass rate     : 25.0%"] and lines[-2].startswith("  heatmap") and lines[-1].startswith("  line_plot            1/1 passed  RMSE=0.0000")

    src, store, out = tmp_path / "in", str(tmp_path / "store"), tmp_path / "out"
    src.mkdir()
    (src / "full.pdf").write_text("full\n10.5/x")
    plug = ["--parser", "tests.test_engine:rich_parser", "--classify", "tests.test_engine:by_image", "--extract", "tests.test_engine:series_of", "-o", str(out)]
    assert cli.main(["--store", store, "process", str(src / "full.pdf"), *plug], spark) == 0
    held = Store(spark, store)
    written = {str(x.relative_to(out)) for x in (out / "figures").rglob("*.png")}
    assert written == {r["image_path"] for r in held.read("figures").collect() if r["image_path"]} and any(x.endswith("_A.png") for x in written)
    assert {x.name for x in (out / "csv/1").iterdir() if not x.name.startswith(".")} >= {"fig1A_A.csv", "fig1B_B.csv"} and (out / "csv/1/fig1A_A.csv").read_text() == "x,y,err_x,err_y\n1.0,2.0,,\n"
    assert "1/1 succeeded" in capsys.readouterr().out and "Extraction Report" in spark.read.text(str(out / "report")).where("value like '%Report'").first()["value"]
    (src / "broken.pdf").write_text("broken\n")
    assert cli.main(["--store", store, "process-batch", str(src), *plug], spark) == 1
    assert "1/2 succeeded" in capsys.readouterr().out
    paper = Store(spark, store).read("papers").first()
    for kind in ("csv", "json", "xlsx"):
        assert cli.main(["--store", store, "export", "--paper-id", str(paper["id"]), "--format", kind, "-o", str(tmp_path / "exp" / kind)], spark) == 0
    assert cli.main(["--store", store, "export", "--paper-id", "77", "--format", "json", "-o", str(tmp_path / "x")], spark) == 1
    assert cli.main(["--store", store, "search", "--doi", "10.0/none"], spark) == 1
    assert cli.main(["--store", store, "process", str(src / "full.pdf"), "--parser", "tests.test_engine:rich_parser", "-o", str(out)], spark) == 1  # no model server


def test_papers_of_one_base_name(spark, tmp_path, capsys):
    for k, folder in enumerate(("a", "b")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "x.pdf").write_text(f"full\n10.5/{k}")
    out = tmp_path / "out"
    plug = ["--parser", "tests.test_engine:rich_parser", "--classify", "tests.test_engine:by_image", "--extract", "tests.test_engine:series_of", "-o", str(out)]
    for folder in ("a", "b"):
        assert cli.main(["--store", str(tmp_path / "s"), "process", str(tmp_path / "in" / folder / "x.pdf"), *plug], spark) == 0
    now = Store(spark, str(tmp_path / "s")).snapshot()
    paths = [r["image_path"] for r in now.read("figures").collect() if r["image_path"]]
    assert len(paths) == len(set(paths)) and {p.split("/")[1] for p in paths} == {"1", "2"} and all((out / p).is_file() for p in paths)
    names = lambda k: {x.name for x in (out / f"csv/{k}").iterdir() if x.suffix == ".csv"}
    assert names(1) == names(2) and "fig1A_A.csv" in names(1)  # a name doesn't depend on the other paper
    primary = spark.createDataFrame([("x", [("9", 1, "by stem", 0.0, 0.0, 200.0, 200.0, "pdffigures2")])], "stem string, figures array<struct<figure_number:string,page_number:int,caption:string,x1:double,y1:double,x2:double,y2:double,source:string>>")
    primary = primary.withColumn("figures", F.transform("figures", lambda f: f.withField("image", F.lit(None).cast(I.IMAGE))))
    both = process(spark.read.format("binaryFile").load([str(tmp_path / "in" / d / "x.pdf") for d in "ab"]).select("path", "content"), Store(spark, str(tmp_path / "s2")), rich_parser, by_image, series_of, primary=primary, settings=Settings(model_attempts=1))
    assert both["figures"].where("caption = 'by stem'").isEmpty()  # nobody's, as both have the stem


def test_settings(spark, monkeypatch):
    assert Settings.of(spark) == Settings()
    monkeypatch.setenv("INKQUARRY_CONFIDENCE_THRESHOLD", "0.4")
    spark.conf.set("spark.inkquarry.image_dpi", "150")
    try:
        assert Settings.of(spark).confidence_threshold == 0.4 and Settings.of(spark).image_dpi == 150
    finally:
        spark.conf.unset("spark.inkquarry.image_dpi")


def test_precision_and_recall_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = lambda n: [(int(rng.integers(0, 3)), float(rng.choice([rng.random(), 0.5])), float(rng.random())) for _ in range(n)]
    t, p = rows(120) + [(7, 1.0, 1.0)], rows(90) + [(8, 1.0, 1.0), (2, 0.5, 0.5), (2, 0.5, 0.5)]
    schema = "k int, x double, y double"
    got = {r["k"]: (r["precision"], r["recall"]) for r in M.point_precision_recall(spark.createDataFrame(t, schema), spark.createDataFrame(p, schema), "k").collect()}

    def normal(side, k):
        v = np.array([r[1:] for r in side if r[0] == k], dtype=float).reshape(-1, 2)
        span = v.max(axis=0) - v.min(axis=0) if len(v) else 1
        return (v - v.min(axis=0)) / np.where(span > 0, span, 1) if len(v) else v

    for k in got:
        a, b = normal(t, k), normal(p, k)
        near = (((a[:, None] - b[None]) ** 2).sum(axis=2) ** 0.5 <= 0.05) if len(a) and len(b) else np.zeros((len(a), len(b)), bool)
        assert got[k] == (pytest.approx(near.any(axis=0).mean() if len(b) else 0.0), pytest.approx(near.any(axis=1).mean() if len(a) else 0.0))
    assert set(got) == {0, 1, 2, 7, 8}


@pytest.mark.parametrize("most", [0, 10**6])
def test_precision_and_recall_move_each_point_once(spark, most):
    """Both ways against all pairs, with nulls, ties and single points; what is shuffled by points of usual keys is one exchange of them."""
    rng = np.random.default_rng(6)
    value = lambda: None if rng.random() < 0.05 else float(rng.choice([rng.random(), 0.25, 0.5]))
    sides = [[(int(rng.integers(0, 6)), value(), value()) for _ in range(300)] + extra for extra in ([(7, 1.0, 1.0), (None, 1.0, 1.0)], [(8, 1.0, 1.0), (None, 1.0, 1.0)])]
    t, p = (spark.createDataFrame(s, "k int, x double, y double") for s in sides)
    df = M.point_precision_recall(t, p, "k", most=most)
    got = {r["k"]: (r["precision"], r["recall"]) for r in df.collect()}

    def normal(side, k):
        v = np.array([[np.nan if c is None else c for c in r[1:]] for r in side if r[0] == k], dtype=float).reshape(-1, 2)
        if not len(v):
            return v
        span = np.nanmax(v, axis=0) - np.nanmin(v, axis=0)
        return (v - np.nanmin(v, axis=0)) / np.where(span > 0, span, 1)

    for k in got:
        a, b = normal(sides[0], k), normal(sides[1], k)
        near = ((a[:, None] - b[None]) ** 2).sum(axis=2) ** 0.5 <= 0.05
        assert got[k] == (pytest.approx(near.any(axis=0).mean() if near.size else 0.0), pytest.approx(near.any(axis=1).mean() if near.size else 0.0))
    assert set(got) == {0, 1, 2, 3, 4, 5, 7, 8}
    if most:
        assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_vector_search_in_blocks(spark, tmp_path, monkeypatch):
    """Blocks of vectors and of queries against all pairs: copies go by their ids, wherever they lie; null ids, other lengths, and no join of all pairs."""
    from inkquarry.sources import vectors as V

    for name, n in (("BLOCK", 40), ("QUERIES", 7), ("SCORES", 90)):
        monkeypatch.setattr(V, name, n, raising=False)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5))
    rows = [(k, x[k % 60 if k < 240 else 0].tolist()) for k in range(300)]
    df = spark.createDataFrame([*rows, (1000, [1.0, 2.0])], "id long, vector array<double>")
    held = V.Vectors(spark, str(tmp_path / "v"))
    held.build(df.where("id < 1000"), lists=3)
    held.upsert(df.where("id = 1000"))
    asked = df.where("id % 10 = 0 and id < 1000").unionByName(spark.createDataFrame([(None, x[3].tolist()), (2**53 + 1, x[4].tolist())], df.schema))
    found = held.search(asked, 7, probes=3)
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "CoGroups" in plan
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 9)))
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for r in asked.collect():
        near = sorted(((-round(float(unit(r["vector"]) @ unit(v)), 9), k) for k, v in rows if k != r["id"]))[:7]
        assert got[r["id"]] == [(k, -s) for s, k in near]
