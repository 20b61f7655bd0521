"""Empty tables, nulls, repeated rows, long texts, clashing columns and missing parts, for the corpus operators and for every stage of the pipeline."""

import importlib
import random
import sys

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from inkquarry.llm import bpe, exact_dedup, minhash, secrets, suffix_dedup, toxicity, url_filter

from .test_llm import brute_components, brute_removed, prose, table

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, digest string, block int, key string, node long, component long, rep long, _own0 int, _kept int, kept boolean"


def edge_rows():
    rng = random.Random(31)
    long = prose(rng, 60_000)
    return [(1, None), (2, None), (3, ""), (4, "same text of a row"), (4, "same text of a row"), (5, "same text of a row"), (None, "idless text"), (None, None), (6, long), (7, long + " more"), (8, "   \n\t "), (9, "one"), (9, "two")]


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "d", 1, "k", 7, 8, 9, 10, 11, True) for i, t in rows], CLASHING).repartition(3)


def test_repeats_by_suffixes(spark):
    rng = random.Random(6)
    text = prose(rng, 80)
    rows = [(5, text), (5, text), (6, "x" * 250), (7, text[:199]), (8, text[:200]), (None, text), (9, "é" * 300)]
    got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.remove_repeats(table(spark, rows)).collect()), key=repr)
    assert got == brute_removed(rows)


def test_bpe_of_empty_tables(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert bpe.decode(bpe.encode(table(spark, []), path), path).isEmpty()
    got = bpe.encode(table(spark, [(1, None), (1, None), (None, "")]), path).collect()
    assert len(got) == 3 and all(bytes(r["ids"]) == b"" for r in got)


def test_exact_groups_of_long_and_idless_texts(spark):
    rows = edge_rows()
    got = exact_dedup.exact_groups(table(spark, rows)).collect()
    keep = {}
    for i, t in rows:
        keep[t or ""] = max(x for x in (keep.get(t or ""), i, -1) if x is not None)
    assert sorted((r["keep_id"] if r["keep_id"] is not None else -1) for r in got) == sorted(keep[t or ""] for _, t in rows)


def test_secrets_of_repeated_rows_and_long_names(spark):
    name = "x" * 3000 + "_password"
    rows = [(1, f'{name} = "Zx9kQ2mP7vL1"'), (1, f'{name} = "Zx9kQ2mP7vL1"'), (2, "a" * 200_000 + ' token="abcdefgh1"'), (None, "= : ="), (3, None)]
    got = [(r["doc_id"], [(x["kind"], x["start"], x["end"]) for x in r["spans"]]) for r in secrets.scan_documents(clashing(spark, rows)).collect()]
    mine = [x for i, x in got if i == 1]
    # one hex span of 200,000 letters a, and the assignment behind it
    assert len(mine) == 2 and mine[0] == mine[1] and ("literal", len(name) + 4, len(name) + 16) in mine[0] and [x for i, x in got if i == 2][0][0][0] == "hex" and [x for i, x in got if i == 3] == [[]]


def test_toxicity_of_long_texts(spark):
    rows = [(i, "a good word. " * 3) for i in range(40)] + [(100 + i, "a vile word. " * 3) for i in range(40)] + [(200, "a good word. " * 60_000), (201, "a good word. " * 60_000 + "vile vile vile."), (202, None)]
    labels = spark.createDataFrame([(i, int(100 <= i < 200)) for i, _ in rows], "doc_id long, toxic int")
    docs = table(spark, rows)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, toxicity.fit(docs, labels.where("doc_id < 200"))).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values()) and got[201] >= got[200]
    kept = toxicity.clean_documents(clashing(spark, rows[:3]), toxicity.Model(toxicity.np.zeros(toxicity.WIDTH), -20.0)).columns
    assert kept == [f.split(" ")[0] for f in CLASHING.split(", ")]


def test_near_copies_of_clashing_tables(spark):
    rows = edge_rows()
    got = minhash.one_of_each(clashing(spark, rows))
    want = brute_components([r for r in rows if r[0] is not None], 5, 80, 100)
    ids = sorted({r["doc_id"] for r in got.select("doc_id").collect() if r["doc_id"] is not None})
    assert got.columns == [f.split(" ")[0] for f in CLASHING.split(", ")] and ids == sorted({i for i, (_, c) in want.items() if c == i})


@pytest.mark.parametrize("kind", ["edges", "empty"])
def test_pipeline_stages(spark, tmp_path, kind):
    """Each stage on its own, and all in a row, on nulls, repeated rows, long texts and further columns, and on empty tables."""
    import corpus_pipeline

    docs = clashing(spark, edge_rows() if kind == "edges" else [])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1, 0), (5, 1, None), (None, 1, 1)] if kind == "edges" else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
        if name != "best-fit packing":
            assert out.columns == docs.columns
        rows = out.collect()
        assert bool(rows) == (kind == "edges")
        if name == "exact dedup" and kind == "edges":
            # null ids with the text of others never win, and stay where all their group is without one
            assert sorted(((r["doc_id"], r["text"]) for r in rows), key=repr) == sorted([(3, ""), (5, "same text of a row"), (None, "idless text"), *[(i, t) for i, t in edge_rows() if i in (6, 7, 8, 9)]], key=repr)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(got) == (kind == "edges")


def test_missing_parts_are_told_apart(monkeypatch):
    """Without this subpackage the entry module has the other queries; any other missing module is an error."""
    import builtins

    real = builtins.__import__

    def without(name):
        def load(module, *args, **kwargs):
            if module == name or module.startswith(name + "."):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
            return real(module, *args, **kwargs)

        return load

    for name, works in (("corpus_pipeline", True), ("inkquarry.llm", True), ("xxhash", False)):
        held = {k: sys.modules.pop(k) for k in list(sys.modules) if k in ("corpus_pipeline", "__spark_entry__") or k.startswith("inkquarry.llm")}
        monkeypatch.setattr(builtins, "__import__", without(name))
        try:
            if works:
                entry = importlib.import_module("__spark_entry__")
                assert "pipeline" not in entry.queries() and len(entry.queries()) > 60
            else:
                with pytest.raises(ModuleNotFoundError):
                    importlib.import_module("__spark_entry__")
        finally:
            monkeypatch.setattr(builtins, "__import__", real)
            for k in [k for k in sys.modules if k in ("corpus_pipeline", "__spark_entry__") or k.startswith("inkquarry.llm")]:
                del sys.modules[k]
            sys.modules.update(held)


def test_urls_of_empty_tables(spark):
    model = url_filter.train(url_filter.labelled_table()[:50])
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, score string"), model).isEmpty()


def test_rounds_of_components_make_no_broadcasts(spark, monkeypatch):
    """Each round's two joins go by shuffle, however small its tables: broadcasts of all rounds pile up in the driver."""
    from inkquarry.llm import common

    plans, staged = [], common.staged
    monkeypatch.setattr(common, "staged", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or staged(df, name))
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 40), (60, 40), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 40: 40, 50: 40, 60: 40}
    assert len(plans) > 2 and all(p.count("Join Inner") == p.count("rightHint=(strategy=merge)") >= 2 for p in plans[1:])


def test_stars_take_no_round_of_components(spark, monkeypatch):
    """Rounds end with the one that makes stars, and edges that are stars take none: each round leaves its plans and tasks in the driver."""
    from inkquarry.llm import common

    names, staged = [], common.staged
    monkeypatch.setattr(common, "staged", lambda df, name: names.append(name) or staged(df, name))
    for edges, expected, rounds in (
        ([(1, 3), (3, 1), (1, 4), (5, 9), (7, 7)], {1: 1, 3: 1, 4: 1, 5: 5, 9: 5}, 0),
        ([(1, 2), (2, 3)], dict.fromkeys((1, 2, 3), 1), 1),
        ([(1, 3), (2, 3)], dict.fromkeys((1, 2, 3), 1), 1),
        ([(7, 7)], {}, 0),
    ):
        names.clear()
        got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == expected and names == ["edges"] * (1 + rounds)


def test_training_rows_are_views_of_arrow_buffers(spark):
    """The driver holds the cells of the training texts once, not as rows and bytes besides."""
    from inkquarry.llm import toxicity

    docs = spark.createDataFrame([(k, None if k == 3 else f"word{k} and more. end") for k in range(12)], "doc_id long, text string")
    rows = toxicity.training_rows(docs, spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, toxic int"))
    cells = toxicity.Cached(toxicity._cells_of)
    used = [r["doc_id"] for r in docs.where(~toxicity.held_out(F.col("doc_id"))).orderBy("doc_id").collect()]
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert [(c.tolist(), y) for c, y in rows] == [(toxicity.text_cells(texts[k], cells).tolist(), k % 2) for k in used] and len(used) > 3
    assert not any(isinstance(c.base, bytes) for c, _ in rows)


def test_roots_of_pointers(spark, monkeypatch):
    """Joins to the pointer's own pointer find the roots, in rounds that grow with the logarithm of the depth."""
    from inkquarry.llm import common

    names, staged = [], common.staged
    monkeypatch.setattr(common, "staged", lambda df, name: names.append(name) or staged(df, name))
    edges = [(k, k + 1) for k in range(1, 12)] + [(100, k) for k in range(101, 130)] + [(110, 300), (300, 301)]
    up = {b: a for a, b in edges}
    root = lambda x: root(up[x]) if x in up else x
    got = [tuple(r) for r in common.pointer_roots(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert sorted(got) == sorted((b, root(b)) for b in up) and len(names) == 5
    assert common.pointer_roots(spark.createDataFrame([], "a long, b long")).isEmpty()
