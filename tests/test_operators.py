"""Hand-computed values of the document engine's operators."""

import json

import pytest
from pyspark.sql import functions as F

from inkquarry.functions import geometry as G
from inkquarry.functions import model_json as J
from inkquarry.functions import text as T
from inkquarry.operators import metrics as M
from inkquarry.operators import ordered as O
from inkquarry.operators.context import build_contexts
from inkquarry.plans.process import process
from inkquarry.sources import files, synthetic
from inkquarry.sources.store import Store
from inkquarry.streaming.ingest import watch


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("y,z,rmse,r2", [([1, 2, 3], [1, 2, 3], 0.0, 1.0), ([0, 1], [0.5, 0.5], 0.5, 0.0), ([1, 2, 3, 4], [1, 2, 3, 4], 0.0, 1.0), ([], [], 0.0, 0.0), ([5, 5], [5, 5], 0.0, 1.0), ([5, 5], [5, 6], 0.0, 0.0), ([7], [9], 0.0, 0.0)])
def test_rmse_r2(spark, y, z, rmse, r2):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, z)], "y double, z double")
    low, high = (float(min(y)), float(max(y))) if y else (0.0, 0.0)
    got = df.agg(M.rmse(F.col("y"), F.col("z"), F.lit(low), F.lit(high)).alias("a"), M.r2(F.col("y"), F.col("z")).alias("b")).first()
    assert got["a"] == pytest.approx(rmse) and got["b"] == pytest.approx(r2)


@pytest.mark.parametrize("t,p,want", [(["Control"], ["Control"], [(0, 0)]), (["A", "B"], ["X", "Y"], [(0, 0), (1, 1)]), (["A", "B"], ["b ", "a"], [(0, 1), (1, 0)]), (["Group 1"], ["x", "group"], [(0, 1)]), (["A"], [""], [(0, 0)]), (["A", "B"], ["A"], [(0, 0)]), (["A"], [], [])])
def test_match_series(spark, t, p, want):
    arr = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    assert [(r["t"], r["p"]) for r in one(spark, M.match_series(arr(t), arr(p)))] == want


def test_gaps_merge_at_five(spark):
    df = spark.createDataFrame([(1, x, float(x)) for x in (0, 5, 10, 16, 17)], "k int, x int, y double")
    got = [(r["x"], r["n"]) for r in O.group_medians(df, ["k"], "x", "y", []).orderBy("x").collect()]
    assert got == [(5.0, 3), (16.5, 2)]


@pytest.mark.parametrize("raw,kind,score", [('{"figure_type": "line_plot", "confidence": 0.9}', "line_plot", 0.9), ('Sure: {"figure_type": "bar_chart", "confidence": 0.8} ok', "bar_chart", 0.8), ("no json", "other", 0.0), ('```json\n{"figure_type":"heatmap","confidence":1.7}\n```', "heatmap", 1.0), ('{"figure_type":"heatmap","confidence":0.5}', "other", 0.5), ('{"figure_type":"big scatter_plot","confidence":0.9}', "scatter_plot", 0.9), ('{"figure_type":"flowchart","confidence":0.9}', "diagram", 0.9)])
def test_classified(spark, raw, kind, score):
    got = one(spark, J.classified(F.lit(raw)))
    assert (got["figure_type"], got["confidence"]) == (kind, score)


def test_series_answers(spark):
    raw = 'Here: [{"series_name":"A","data_points":[{"x":1,"y":2}]}, {"series_name":null}] done'
    got = one(spark, J.parse_array(F.lit(raw)))
    assert [g["series_name"] for g in got] == ["A", None] and got[0]["data_points"][0]["y"] == 2.0
    assert one(spark, J.parse_array(F.lit("nothing"))) == []


def test_text_rules(spark):
    assert one(spark, T.doi(F.lit("see doi: 10.1234/abc.. and 10.9/x"))) == "10.1234/abc"
    assert one(spark, T.doi(F.lit("none"))) is None
    assert one(spark, T.mode_first_seen(T.years(F.lit("1999, 2001, 2001, 1999, 18990")))) == 1999
    assert one(spark, T.match_starts(F.lit("ab--ab-ab"), "ab")) == [0, 4, 7]
    assert one(spark, T.panel_labels(F.lit("(A) one (B) two [C] x. (A) again"))) == ["A", "B", "C"]
    assert one(spark, T.panel_caption(F.lit("(A) one. (B) two"), F.lit("A"))) == "(A) one."
    s = one(spark, T.sections(F.lit("x\nIntroduction\nwhy\nMaterials and Methods\nhow\n")))
    assert [(r["name"], r["body"].strip()) for r in s] == [("Introduction", "why"), ("Methods", "how")]
    assert one(spark, T.overlap_ratio(F.lit("abc"), F.lit("abcd"))) == 0.75
    assert one(spark, T.greedy_distinct(F.array(F.lit("aaaa bbbb"), F.lit("aaaa bbb"), F.lit("xyz")))) == ["aaaa bbbb", "xyz"]
    assert one(spark, T.stem(F.lit("/a/b.c/paper.v1.pdf"))) == "paper.v1"


def test_axes(spark):
    f = lambda *a: one(spark, G.pixel_to_data(*map(F.lit, a)))
    assert f(50.0, 0.0, 100.0, 0.0, 10.0, False) == 5.0
    assert f(50.0, 0.0, 100.0, 1.0, 100.0, True) == pytest.approx(10.0)
    assert f(50.0, 7.0, 7.0, 3.0, 9.0, False) == 3.0
    assert f(50.0, 0.0, 100.0, -1.0, 100.0, True) is None


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.init()
    paper = lambda p, d, t: spark.createDataFrame([(p, d, t)], "pdf_path string, doi string, title string")
    s.upsert_papers(paper("/fake/paper.pdf", "10.1234/test", "Original"))
    s.upsert_papers(paper("/fake/paper.pdf", None, "Updated"))
    s.upsert_papers(paper("/other.pdf", "10.9999/xyz", "Other"))
    got = {r["pdf_path"]: r for r in s.read("papers").collect()}
    assert len(got) == 2 and got["/fake/paper.pdf"]["title"] == "Updated" and got["/fake/paper.pdf"]["doi"] is None and got["/fake/paper.pdf"]["id"] == 1
    s.replace_figures(spark.createDataFrame([(2, "1", 1, "line_plot")], "paper_id long, figure_number string, page_number int, figure_type string"))
    s.append("series", spark.createDataFrame([(1, "Control", [(0.0, 0.1, None, None), (1.0, 0.2, None, None)])], "figure_id long, series_name string, data_points array<struct<x:double,y:double,err_x:double,err_y:double>>"), ["series_name"])
    found = s.search("10.9999/xyz").first()
    assert found["figures"][0]["series"][0]["series_name"] == "Control" and s.search("10.0000/not-exist").isEmpty()
    s.export_points(2, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    s.export_json(2, str(tmp_path / "json"))
    with pytest.raises(ValueError):
        s.export_json(99, str(tmp_path / "none"))


def parser(content):
    out = files.text_parser(content)
    return out | {"figures": [{"figure_number": "1", "page_number": 1, "caption": "Figure 1. Growth over time", "x1": 0.0, "y1": 0.0, "x2": 100.0, "y2": 50.0, "source": "pdffigures2"}]}


def classify(prompt, image):
    return '{"figure_type": "line_plot", "confidence": 0.9}'


def extract(prompt, image):
    return json.dumps([{"series_name": "S", "data_points": [{"x": 1, "y": 2}]}])


def test_process_and_watch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.pdf").write_text("A very fine paper title\ndoi: 10.5555/abc 2001\nResults\nFig. 1 shows growth.\n")
    (src / "b.pdf").write_text("%PDF-ENCRYPTED")
    out = process(files.documents(spark, str(src)), Store(spark, str(tmp_path / "s1")), parser, classify, extract)
    assert [r["doi"] for r in out["papers"].collect()] == ["10.5555/abc"]
    assert out["figures"].first()["figure_type"] == "line_plot" and out["series"].first()["data_points"][0]["y"] == 2.0
    assert "encrypted" in out["errors"].first()["error_message"]
    store = Store(spark, str(tmp_path / "s2"))
    for _ in range(2):
        watch(spark, str(src), store, str(tmp_path / "check"), classify, extract, parser).awaitTermination()
    assert store.read("papers").count() == 1 and store.read("figures").count() == 1


def test_synthetic_is_repeatable(spark):
    a = synthetic.points(synthetic.plots(spark, 20)).collect()
    b = synthetic.points(synthetic.plots(spark, 20).repartition(5)).collect()
    assert sorted(a) == sorted(b) and {r["plot_type"] for r in a} <= set(synthetic.KINDS)


def many_figures(content):
    figure = lambda k: {"figure_number": str(k), "page_number": 1, "caption": f"Figure {k}.", "x1": 0.0, "y1": 0.0, "x2": 100.0, "y2": 50.0, "source": "pdffigures2"}
    return files.text_parser(content) | {"figures": [figure(k) for k in range(1, 64)]}


def test_process_keeps_all_figures(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.pdf").write_text("A very fine paper title\nResults\nFig. 1 shows growth.\n")
    out = process(files.documents(spark, str(src)), Store(spark, str(tmp_path / "s1")), many_figures, classify, extract)
    assert sorted(int(r["figure_number"]) for r in out["figures"].collect()) == list(range(1, 64)) and out["series"].count() == 63
    few = process(files.documents(spark, str(src)), Store(spark, str(tmp_path / "s2")), many_figures, classify, extract, most_figures=5)
    assert few["figures"].count() == 5


def test_repeated_sections_are_joined(spark):
    text = "Title\nMethods\n\nfirst way \nRESULTS\nFig. 1 rose.\nmaterials and methods\n  second way of growth\nResults\n\nDiscussion\nwhy\nResults\nFig. 1 fell.\n"
    got = [(r["ord"], r["name"], r["body"]) for r in one(spark, T.sections(F.lit(text)))]
    assert got == [(0, "Methods", "first way\n\nsecond way of growth"), (1, "Results", "Fig. 1 rose.\n\n\n\nFig. 1 fell."), (2, "Discussion", "why")]
    assert one(spark, T.sections(F.lit("no heading"))) == [] and one(spark, T.sections(F.lit(None).cast("string"))) is None
    papers = spark.createDataFrame([("p", "t", None, text)], "paper_id string, title string, doi string, full_text string")
    figures = spark.createDataFrame([("p", "p#0", "1", "Figure 1. Growth of second")], "paper_id string, figure_id string, figure_number string, caption string")
    row = build_contexts(figures, papers).first()
    assert "second way of growth" in row["methods_context"] and "fell" in row["results_context"] and "rose" in row["results_context"]


def test_hot_keys_by_slices(spark):
    import numpy as np
    import pandas as pd

    from inkquarry.operators import metrics, ordered

    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 4000, p=[0.7, 0.25, 0.05]), "i": np.arange(4000), "x": rng.integers(0, 9000, 4000).astype(float)})
    frame.loc[rng.choice(4000, 60, replace=False), "x"] = np.nan
    rows = [(None if r.k == "c" else r.k, int(r.i), None if np.isnan(r.x) else float(r.x)) for r in frame.itertuples()]
    df = spark.createDataFrame(rows, "k string, i long, x double").repartition(6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small slices stay apart
    try:
        values = lambda df, *c: sorted((tuple(r[x] for x in c) for r in df.collect()), key=repr)
        for gap in (1, 5, 40):
            want = values(ordered.gap_groups(df, ["k"], "x", ["i"], gap), "k", "i", "x", "grp")
            for most in (0, 300, 1500):
                assert values(ordered.gap_groups(df, ["k"], "x", ["i"], gap, most), "k", "i", "x", "grp") == want
        want = values(ordered.medians(df, ["k"], ["x", "i"]), "k", "x", "i", "n")
        assert values(ordered.medians(df, ["k"], ["x", "i"], most=0), "k", "x", "i", "n") == want == values(ordered.medians(df, ["k"], ["x", "i"], most=500), "k", "x", "i", "n")
        full = df.where("x is not null").select("k", (F.col("x") * 10_000 + F.col("i")).alias("p"))
        for end in (None, F.lit(-1.0)):
            assert values(ordered.cut_pairs(full, ["k"], "p", end, most=0), "k", "p", "next") == values(ordered.cut_pairs(full, ["k"], "p", end), "k", "p", "next")
        assert ordered.slices(df.where("k = 'a'"), ["k"], ["x", "i"]).select("_part").distinct().count() > 1
        few = df.where("x is null")
        assert values(ordered.medians(few, ["k"], ["x"], most=0), "k", "x", "n") == values(ordered.medians(few, ["k"], ["x"]), "k", "x", "n")
        got = values(metrics.minmax_rows(df, ["x"], ["k"]), "k", "i", "x")
        assert [(k, i, None if x is None else round(x, 9)) for k, i, x in got] == [(k, i, None if x is None else round(x, 9)) for k, i, x in values(df.select("k", "i", metrics.minmax(F.col("x"), "k").alias("x")), "k", "i", "x")]
        empty = df.limit(0)
        assert ordered.gap_groups(empty, ["k"], "x", ["i"], most=0).isEmpty() and ordered.medians(empty, ["k"], ["x"], most=0).isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("slices", [1, 2, 64])
def test_budget_ends_at_the_first_row_beyond_it(spark, slices):
    """A row beyond the budget counts for all rows behind it, also for smaller ones of other slices."""
    rows = [(k, i, None if i == 40 else 1000 // (i + 1)) for k in ("a", "b", None) for i in range(41)]
    got = O.within_budget(spark.createDataFrame(rows, "k string, id int, n int"), ["k"], [F.desc("n"), "id"], "n", 2_050, slices).collect()
    want = [(k, i, sum(1000 // (j + 1) for j in range(i + 1))) for k in ("a", "b", None) for i in range(3)]
    assert sorted(map(repr, ((r["k"], r["id"], r["running"]) for r in got))) == sorted(map(repr, want))
