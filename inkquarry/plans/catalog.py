"""The registered queries: each applies library operators to whole driver tables; SQL holds the same in DuckDB's dialect."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkquarry.functions import geometry as G
from inkquarry.functions import model_json as J
from inkquarry.functions import text as T
from inkquarry.operators import metrics as M
from inkquarry.operators import ordered as O
from inkquarry.operators.images import colour_clusters
from inkquarry.sources import store, synthetic

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Query]:
    """Registers a function of tables: its parameters name the tables that it reads."""

    def register(f: Callable) -> Query:
        names = f.__code__.co_varnames[: f.__code__.co_argcount]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names])

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return register


# Joins and lookups


@query("SELECT o_orderkey, count(l_orderkey)::BIGINT AS n_series, round(coalesce(sum(l_quantity), 0), 4) AS n_points FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def parent_child_left_join(orders, lineitem):
    per = lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return orders.join(per, orders["o_orderkey"] == per["l_orderkey"], "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_series"), F.round(F.coalesce("q", F.lit(0.0)), 4).alias("n_points"))


@query("""SELECT c_custkey, c_name, o_orderkey, l_linenumber, l_quantity FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def three_level_lookup(customer, orders, lineitem):
    j = customer.join(orders, customer["c_custkey"] == orders["o_custkey"], "left").join(lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("c_custkey", "c_name", "o_orderkey", "l_linenumber", "l_quantity")


@query("SELECT * FROM orders WHERE o_custkey = 7")
def point_filter(orders):
    return orders.where("o_custkey = 7")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def project_subset(orders):
    return orders.select([c for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "not_there") if c in orders.columns])


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_pairs(documents, labels):
    return documents.join(labels, "doc_id", "left_semi").select("doc_id", "lang", "source")


@query("SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_fallback(documents, labels):
    return documents.join(labels, "doc_id", "left_anti").select("doc_id", "lang", "source")


@query("""WITH t AS (SELECT event_id, ['line_plot', 'bar_chart', 'scatter_plot', 'heatmap', 'spectrum_nmr', 'spectrum_ir', 'spectrum_ms', 'western_blot', 'microscopy', 'table', 'diagram', 'other', 'flowchart', 'unheard_of'][event_id % 14 + 1] AS figure_type FROM events)
SELECT event_id, figure_type, CASE WHEN figure_type IN ('line_plot', 'scatter_plot') THEN 'plot_digitizer' WHEN figure_type = 'bar_chart' THEN 'bar_extractor' WHEN figure_type = 'heatmap' THEN 'heatmap_extractor'
WHEN figure_type LIKE 'spectrum%' THEN 'spectrum_extractor' WHEN figure_type = 'western_blot' THEN 'gel_extractor' WHEN figure_type = 'microscopy' THEN 'microscopy_extractor' ELSE 'description_only' END AS strategy FROM t""")
def dim_lookup_default(events):
    kinds = F.array(*map(F.lit, (*J.FIGURE_TYPES, "flowchart", "unheard_of")))
    return events.select("event_id", F.get(kinds, (F.col("event_id") % 14).cast("int")).alias("figure_type")).withColumn("strategy", J.strategy(F.col("figure_type")))


@query("""SELECT a.conv_id, a.turn, count(b.turn)::BIGINT AS n_near, coalesce(sum(length(b.text)), 0)::BIGINT AS n_chars FROM conversations a LEFT JOIN conversations b
ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 GROUP BY a.conv_id, a.turn""")
def band_join_neighbours(conversations):
    near = conversations.select("conv_id", F.explode(F.sequence(F.col("turn") - 1, F.col("turn") + 1)).alias("turn"), F.length("text").alias("n"))
    keys = conversations.groupBy("conv_id", "turn").agg(F.count("*").alias("times"))
    g = near.groupBy("conv_id", "turn").agg(F.count("*").alias("n_near"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chars"))
    return keys.join(g, ["conv_id", "turn"]).select("conv_id", "turn", (F.col("n_near") * F.col("times")).alias("n_near"), (F.col("n_chars") * F.col("times")).alias("n_chars"))


@query("""WITH v AS (SELECT event_id, user_id, value, lag(value) OVER w AS lo, lead(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id))
SELECT event_id, user_id, coalesce(value - lo <= 0.05, false) OR coalesce(hi - value <= 0.05, false) AS has_near FROM v""")
def theta_within_tolerance(events):
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    near = F.coalesce(F.col("value") - F.lag("value").over(w) <= 0.05, F.lit(False)) | F.coalesce(F.lead("value").over(w) - F.col("value") <= 0.05, F.lit(False))
    return events.select("event_id", "user_id", near.alias("has_near"))


@query("""WITH r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS pos FROM conversations)
SELECT a.conv_id, a.pos::INTEGER AS pos, length(a.text)::BIGINT AS n_user, length(b.text)::BIGINT AS n_assistant FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.pos = b.pos WHERE a.role = 'user' AND b.role = 'assistant'""")
def position_zip_join(conversations):
    r = O.numbered(conversations, ["conv_id", "role"], ["turn"], "pos").withColumn("n", F.length("text").cast("long"))
    side = lambda role: r.where(F.col("role") == role).select("conv_id", "pos", F.col("n").alias(f"n_{role}"))
    return side("user").join(side("assistant"), ["conv_id", "pos"])


@query("SELECT 'fig' || CAST(p_partkey AS VARCHAR) || '_' || replace(replace(p_name, ' ', '_'), '/', '-') AS file, p_partkey FROM part")
def safe_filename(part):
    return part.select(T.safe_name(F.concat(F.lit("fig"), F.col("p_partkey").cast("string")), F.col("p_name")).alias("file"), "p_partkey")


# Aggregates and metrics


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_quantity), 4) AS points FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def counts_rollup_report(lineitem):
    return lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("points"))


_RMSE = """WITH v AS (SELECT l_suppkey, l_extendedprice AS y, l_extendedprice * (1 - l_discount) AS z, min(l_extendedprice) OVER (PARTITION BY l_suppkey) AS lo, max(l_extendedprice) OVER (PARTITION BY l_suppkey) AS hi FROM lineitem) """


@query(_RMSE + "SELECT l_suppkey, round(coalesce(sqrt(avg(power((y - z) / nullif(hi - lo, 0), 2))), 0), 6) AS rmse FROM v GROUP BY 1")
def grouped_rmse(lineitem):
    y, z = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lineitem.groupBy("l_suppkey").agg(F.round(M.rmse(y, z), 6).alias("rmse"))


@query(_RMSE + """SELECT l_suppkey, round(CASE WHEN count(*) < 2 THEN 0 WHEN min(y) = max(y) THEN CASE WHEN sum(power(y - z, 2)) = 0 THEN 1 ELSE 0 END ELSE 1 - sum(power(y - z, 2)) / (var_pop(y) * count(*)) END, 6)::DOUBLE AS r2 FROM v GROUP BY 1""")
def grouped_r2(lineitem):
    y, z = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lineitem.groupBy("l_suppkey").agg(F.round(M.r2(y, z), 6).alias("r2"))


@query("""SELECT event_type AS figure_type, count(*)::BIGINT AS n, count(*) FILTER (value <= 0.5)::BIGINT AS passed, round(100.0 * count(*) FILTER (value <= 0.5) / greatest(count(*), 1), 6)::DOUBLE AS pass_rate,
round(coalesce(avg(value), 0), 6) AS mean_rmse, round(coalesce(avg(1 - value), 0), 6) AS mean_r2 FROM events GROUP BY ROLLUP (event_type)""")
def pass_rate_by_type(events):
    r = M.report(events.select(F.col("event_type").alias("figure_type"), F.col("value").alias("rmse"), (1 - F.col("value")).alias("r2"), (F.col("value") <= 0.5).alias("passed")))
    return r.select("figure_type", "n", "passed", *[F.round(c, 6).alias(c) for c in ("pass_rate", "mean_rmse", "mean_r2")])


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""")
def mode_first_seen(events):
    c = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("f"))
    return c.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.col("f"))).alias("event_type"), F.max("n").alias("n"))


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def argmax_first(documents):
    return documents.groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"), F.max("n_chars").alias("n_chars"))


@query("SELECT event_type, round(median(value), 6) AS median_value FROM events GROUP BY 1")
def exact_median(events):
    return O.medians(events, ["event_type"], ["value"]).select("event_type", F.round("value", 6).alias("median_value"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1")
def distinct_sorted_array(events):
    return events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins(events):
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.event_id", "x.event_type")


@query("SELECT conv_id, count(*)::BIGINT AS page_count, string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) AS full_text FROM conversations GROUP BY 1")
def ordered_listagg(conversations):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return conversations.groupBy("conv_id").agg(F.count("*").alias("page_count"), F.array_join(F.transform(rows, lambda p: p["text"]), "\n\n").alias("full_text"))


@query("""WITH v AS (SELECT p_partkey, p_retailprice AS v, min(p_retailprice) OVER (PARTITION BY p_brand) AS lo, max(p_retailprice) OVER (PARTITION BY p_brand) AS hi FROM part)
SELECT p_partkey, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE v - lo END, 6) AS normal FROM v""")
def minmax_normalise(part):
    return M.minmax_rows(part.select("p_partkey", "p_brand", F.col("p_retailprice").alias("v")), ["v"], ["p_brand"]).select("p_partkey", F.round("v", 6).alias("normal"))


@query("SELECT count(*)::BIGINT AS n, count(*) FILTER (v IS NULL)::BIGINT AS failed, count(*) FILTER (v IS NOT NULL)::BIGINT AS good FROM (SELECT try_cast(json_extract_string(props, '$.k') AS INTEGER) AS v FROM events)")
def batch_success_count(events):
    v = F.get_json_object("props", "$.k").try_cast("int")
    return events.agg(F.count("*").alias("n"), F.count_if(v.isNull()).alias("failed"), F.count_if(v.isNotNull()).alias("good"))


# Order-dependent operators

_GAPS = """WITH s AS (SELECT user_id, event_id, floor(value) AS x, value AS y FROM events), b AS (SELECT *, CASE WHEN x - lag(x) OVER w > 5 THEN 1 ELSE 0 END AS brk FROM s WINDOW w AS (PARTITION BY user_id ORDER BY x, event_id)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY x, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM b) """


@query(_GAPS + "SELECT user_id, grp::BIGINT AS grp, round(median(x), 6) AS x, round(median(y), 6) AS y, count(*)::BIGINT AS n FROM g GROUP BY 1, 2")
def gap_sessionize_median(events):
    s = events.select("user_id", "event_id", F.floor("value").cast("double").alias("x"), F.col("value").alias("y"))
    return O.group_medians(s, ["user_id"], "x", "y", ["event_id"]).select("user_id", "grp", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n")


@query(_GAPS.replace("user_id", "event_type").replace("> 5", "> 0.02").replace("floor(value)", "value") + "SELECT event_type, grp::BIGINT AS grp, round(median(x), 6) AS x, round(median(y), 6) AS y, count(*)::BIGINT AS n FROM g GROUP BY 1, 2")
def hot_gap_medians(events):
    """Gap groups and their medians where every key is over the bound for slices."""
    s = events.select("event_type", "event_id", F.col("value").alias("x"), F.col("value").alias("y"))
    return O.group_medians(s, ["event_type"], "x", "y", ["event_id"], gap=0.02, most=100).select("event_type", "grp", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n")


@query("SELECT 1 AS k, round(median(l_extendedprice), 6) AS l_extendedprice, round(median(l_quantity), 6) AS l_quantity, count(*)::BIGINT AS n FROM lineitem UNION ALL SELECT 2, round(median(l_extendedprice), 6), round(median(l_quantity), 6), count(*)::BIGINT FROM lineitem WHERE l_orderkey % 2 = 0")
def hot_medians(lineitem):
    """Exact medians of one group that holds all rows, and of one that holds some half of them."""
    rows = lineitem.select(F.lit(1).alias("k"), "l_extendedprice", "l_quantity")
    both = rows.unionByName(lineitem.where("l_orderkey % 2 = 0").select(F.lit(2).alias("k"), "l_extendedprice", "l_quantity"))
    return O.medians(both, ["k"], ["l_extendedprice", "l_quantity"], most=1000).select("k", F.round("l_extendedprice", 6).alias("l_extendedprice"), F.round("l_quantity", 6).alias("l_quantity"), "n")


@query("SELECT o_orderstatus, o_orderkey, coalesce(lead(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey), -1)::BIGINT AS next FROM orders")
def hot_boundaries(orders):
    """Each key with the next one of its status, in slices."""
    return O.cut_pairs(orders.select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], "o_orderkey", F.lit(-1), most=100)


@query("""WITH s AS (SELECT DISTINCT user_id, floor(value) AS x FROM events), b AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY user_id ORDER BY x) > 5 THEN 1 ELSE 0 END AS brk FROM s),
g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS grp FROM b), e AS (SELECT user_id, min(x) AS a, max(x) AS z FROM g GROUP BY user_id, grp),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY z - a DESC, a) AS r FROM e)
SELECT user_id, a AS first, z AS last, row_number() OVER (PARTITION BY user_id ORDER BY a)::INTEGER AS no FROM r WHERE r <= 2""")
def widest_bands(events):
    s = events.select("user_id", F.floor("value").cast("double").alias("x")).distinct()
    return O.widest(O.bands(s, ["user_id"], "x"), ["user_id"], 2).select("user_id", "first", "last", "no")


@query("SELECT o_custkey, o_orderkey, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), o_orderkey + 100)::BIGINT AS next FROM orders")
def lead_boundaries(orders):
    return O.cut_pairs(orders.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", F.col("o_orderkey") + 100)


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS next FROM orders) WHERE next IS NOT NULL")
def cut_pairs(orders):
    return O.cut_pairs(orders.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("SELECT source, doc_id, running FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM documents) WHERE running <= 60000")
def running_budget(documents):
    return O.within_budget(documents.select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), "doc_id"], "n_chars", 60_000).select("source", "doc_id", "running")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS no FROM orders")
def dense_ids(orders):
    return O.numbered(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "no")


@query("SELECT o_orderkey, 1000 + row_number() OVER (ORDER BY o_orderkey)::BIGINT AS id FROM orders")
def surrogate_ids(orders):
    return O.surrogate_ids(orders.select("o_orderkey"), ["o_orderkey"], 1000)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def topk_per_group(orders):
    return O.numbered(orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).where("no <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def order_desc_limit(orders):
    return orders.orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderdate").limit(5)


# Writing


@query("""SELECT coalesce(o.s_name, n.s_name) AS s_name, CASE WHEN o.id IS NULL THEN (SELECT max(s_suppkey) FROM supplier WHERE s_suppkey % 2 = 0) + row_number() OVER (PARTITION BY o.id IS NULL ORDER BY coalesce(o.s_name, n.s_name)) ELSE o.id END::BIGINT AS id,
CASE WHEN n.s_name IS NOT NULL THEN n.v ELSE o.v END AS s_acctbal FROM (SELECT s_suppkey AS id, s_name, s_acctbal AS v FROM supplier WHERE s_suppkey % 2 = 0) o
FULL JOIN (SELECT s_name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_acctbal + 1 END AS v FROM supplier WHERE s_suppkey % 2 = 1 OR s_suppkey % 4 = 0) n ON o.s_name = n.s_name""")
def upsert_merge(supplier):
    old = supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), "s_name", "s_acctbal")
    new = supplier.where("s_suppkey % 2 = 1 or s_suppkey % 4 = 0").select("s_name", F.expr("case when s_suppkey % 4 = 0 then null else s_acctbal + 1 end").alias("s_acctbal"))
    return store.upserted(old, new, old.agg(F.max("id")).first()[0] or 0, "s_name").select("s_name", "id", "s_acctbal")


@query("SELECT r_regionkey AS k, r_name AS name, NULL::INTEGER AS region FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def union_append(region, nation):
    return region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")).unionByName(nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), allowMissingColumns=True)


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def except_keys(customer, orders):
    return customer.select(F.col("c_custkey").alias("k")).subtract(orders.where("o_totalprice > 300000").select("o_custkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(customer, supplier):
    return customer.select(F.col("c_nationkey").alias("k")).intersect(supplier.select("s_nationkey"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(orders, customer):
    gone = customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return orders.join(gone, "o_custkey", "left_anti").select("o_orderkey", "o_orderstatus")


@query("SELECT event_id, CASE WHEN try_cast(json_extract_string(props, '$.k') AS INTEGER) % 3 = 0 THEN 'multiple of three: ' || json_extract_string(props, '$.k') END AS error_message FROM events WHERE try_cast(json_extract_string(props, '$.k') AS INTEGER) % 3 = 0")
def error_split(events):
    k = F.get_json_object("props", "$.k")
    return store.error_split(events, F.when(k.try_cast("int") % 3 == 0, F.concat(F.lit("multiple of three: "), k)))[1].select("event_id", "error_message")


# Text

_MENTION = "'Shown in Fig. ' || CAST(doc_id % 7 AS VARCHAR) || ' is what follows. ' || text"


@query(f"""SELECT doc_id, regexp_matches(t, 'Fig\\. ' || CAST(doc_id % 7 AS VARCHAR) || ' ') AS mentioned, (strpos(t, 'Fig. ') - 1)::INTEGER AS start,
replace(substring(t, greatest(strpos(t, 'Fig. ') - 200, 1), strpos(t, 'Fig. ') + 5 + 200 - greatest(strpos(t, 'Fig. ') - 200, 1)), chr(10), ' ') AS snippet FROM (SELECT doc_id, {_MENTION} AS t FROM documents)""")
def char_window_snippets(documents):
    t = documents.select("doc_id", F.concat(F.lit("Shown in Fig. "), (F.col("doc_id") % 7).cast("string"), F.lit(" is what follows. "), "text").alias("t"))
    start = F.locate("Fig. ", F.col("t")) - 1
    return t.select("doc_id", F.rlike(F.col("t"), T.figure_pattern((F.col("doc_id") % 7).cast("string"))).alias("mentioned"), start.alias("start"), T.window_around(F.col("t"), start, F.lit(5), 200).alias("snippet"))


@query("SELECT doc_id, list_aggregate([x for x in [length(y) for y in string_split(text, ' the ')]], 'count')::BIGINT - 1 AS n_hits, CASE WHEN strpos(text, ' the ') > 0 THEN (strpos(text, ' the ') - 1)::INTEGER END AS first_hit FROM documents")
def match_offsets(documents):
    starts = T.match_starts(F.col("text"), " the ")
    return documents.select("doc_id", starts.alias("s")).select("doc_id", F.size("s").cast("long").alias("n_hits"), F.get("s", F.lit(0)).alias("first_hit"))


_DOI = """WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'see [10.' || (1000 + doc_id % 9000) || '/abc' || doc_id || '] and ' WHEN 1 THEN 'https://dx.doi.org/10.5555/X.' || doc_id || '.. or 10.1/no ' WHEN 2 THEN 'DOI:  10.4321/(a)_b-' || doc_id || '"x ' WHEN 3 THEN 'a10.1234/no 10.12345/bare;' || doc_id || ',y doi: none ' ELSE '' END || 'in 1' || (900 + doc_id % 99) || ', 2001, 20011, 1' || (900 + doc_id % 50) || ' and 2001. ' || text AS t FROM documents),
y AS (SELECT doc_id, t, regexp_extract_all(substring(t, 1, 4000), '\\b(19\\d{2}|20\\d{2})\\b', 1) AS ys FROM t) """


@query(_DOI + """SELECT doc_id, nullif(rtrim(coalesce(nullif(regexp_extract(substring(t, 1, 6000), '(?i)(?:doi[:\\s]*|https?://(?:dx\\.)?doi\\.org/)(10\\.\\d{4,9}/[-._;()/:A-Z0-9a-z]+)', 1), ''), regexp_extract(substring(t, 1, 6000), '(?i)\\b(10\\.\\d{4,9}/[-._;()/:A-Z0-9a-z]+)', 1)), '.'), '') AS doi,
(SELECT u.y FROM (SELECT unnest(ys) AS y, generate_subscripts(ys, 1) AS i) u GROUP BY u.y ORDER BY count(*) DESC, min(u.i) LIMIT 1)::INTEGER AS year FROM y""")
def doi_year_extract(documents):
    i, s = F.col("doc_id"), lambda x: F.col("doc_id").cast("string") if x is None else x.cast("string")
    lead = (
        F.when(i % 5 == 0, F.concat(F.lit("see [10."), s(1000 + i % 9000), F.lit("/abc"), s(None), F.lit("] and "))).when(i % 5 == 1, F.concat(F.lit("https://dx.doi.org/10.5555/X."), s(None), F.lit(".. or 10.1/no ")))
        .when(i % 5 == 2, F.concat(F.lit("DOI:  10.4321/(a)_b-"), s(None), F.lit('"x '))).when(i % 5 == 3, F.concat(F.lit("a10.1234/no 10.12345/bare;"), s(None), F.lit(",y doi: none "))).otherwise("")
    )
    t = F.concat(lead, F.lit("in 1"), s(900 + i % 99), F.lit(", 2001, 20011, 1"), s(900 + i % 50), F.lit(" and 2001. "), "text")
    return documents.select("doc_id", t.alias("t")).select("doc_id", T.doi(F.col("t")).alias("doi"), T.mode_first_seen(T.years(F.col("t"))).alias("year"))


_HEADS = "(?im)^\\s*(abstract|introduction|methods?|materials?\\s+and\\s+methods?|results?|discussion|conclusions?|acknowledgements?|references?)\\s*$"


@query(f"""WITH t AS (SELECT doc_id, 'Start' || chr(10) || 'Introduction' || chr(10) || replace(replace(replace(coalesce(text, ''), ' the ', chr(10) || ' RESULTS ' || chr(10)), ' of ', chr(10) || 'materials  and method' || chr(10)), ' de ', chr(10) || 'Method' || chr(10)) || chr(10) || 'references' || chr(10) || 'last' AS t FROM documents),
s AS (SELECT doc_id, regexp_extract_all(t, '{_HEADS}', 1) AS heads, string_split_regex(t, '{_HEADS}') AS parts FROM t), e AS (SELECT doc_id, unnest(heads) AS h, generate_subscripts(heads, 1) AS i, parts FROM s),
n AS (SELECT doc_id, i, CASE WHEN regexp_full_match(h, '(?i)materials?\\s+and\\s+methods?') THEN 'Methods' ELSE upper(h[1]) || lower(h[2:]) END AS name, regexp_replace(parts[i + 1], '^\\s+|\\s+$', '', 'g') AS body FROM e)
SELECT doc_id, name, (row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1)::INTEGER AS ord, string_agg(body, chr(10) || chr(10) ORDER BY i) AS body FROM n GROUP BY doc_id, name""")
def section_merge(documents):
    """Sections of whole texts in which three frequent words are made headings: repeated ones are joined in the place of the first."""
    made = F.coalesce("text", F.lit(""))
    for word, head in ((" the ", "\n RESULTS \n"), (" of ", "\nmaterials  and method\n"), (" de ", "\nMethod\n")):
        made = F.replace(made, F.lit(word), F.lit(head))
    t = F.concat(F.lit("Start\nIntroduction\n"), made, F.lit("\nreferences\nlast"))
    return documents.select("doc_id", F.explode(T.sections(t)).alias("s")).select("doc_id", "s.name", "s.ord", "s.body")


_WORDS = "['tion', 'ther', 'with', 'from', 'idiot', 'enti']"


@query(f"SELECT doc_id, len(list_filter({_WORDS}, lambda k: contains(lower(text), k)))::INTEGER AS score FROM documents")
def keyword_score(documents):
    return documents.select("doc_id", T.keyword_hits(F.col("text"), F.array(*[F.lit(w) for w in ("tion", "ther", "with", "from", "idiot", "enti")])).alias("score"))


_STOP = "['figure', 'shows', 'shown', 'panel', 'panels', 'data', 'with', 'from', 'each', 'this', 'that', 'their', 'were', 'have', 'been', 'also', 'upon', 'using', 'used', 'left', 'right', 'upper', 'lower', 'scale', 'bars', 'images', 'image', 'error', 'mean', 'median', 'total', 'values']"


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{4,}}') AND NOT list_contains({_STOP}, w)))), ' ') AS words FROM documents""")
def caption_keywords(documents):
    return documents.select("doc_id", F.array_join(F.array_sort(T.keywords(F.coalesce("text", F.lit("")))), " ").alias("words"))


@query()
def greedy_dedupe(documents):
    return documents.select("doc_id", T.greedy_distinct(F.split("text", "\n")).alias("kept"))


@query()
def greedy_match(nation):
    names = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("truth"))
    return names.select("n_regionkey", M.match_series(F.col("truth"), F.reverse(F.transform("truth", lambda x: F.lower(F.substring(x, 1, 4))))).alias("pairs"))


@query(r"""WITH t AS (SELECT doc_id, replace(replace(text, ' the ', ' (Figs. 1) '), ' of ', ' FIGURE  12 ') || ' Fig 2' AS t FROM documents), n AS (SELECT unnest(['1', '2', '12']) AS number)
SELECT doc_id, number, len(regexp_extract_all(t, '(?i)\b(?:Fig(?:ure|s?\.?)?)\.?\s*' || number || '\b'))::INTEGER AS n FROM t, n""")
def mention_counts(documents):
    """How often each of three figures is mentioned in each text, by one scan of the text."""
    from inkquarry.operators.context import mention_length, mention_windows

    t = F.concat(F.replace(F.replace("text", F.lit(" the "), F.lit(" (Figs. 1) ")), F.lit(" of "), F.lit(" FIGURE  12 ")), F.lit(" Fig 2"))
    w = documents.select("doc_id", mention_windows(t, 2).alias("w")).select("doc_id", "w", F.explode(F.array(*map(F.lit, ("1", "2", "12")))).alias("number"))
    return w.select("doc_id", "number", F.size(F.filter("w", lambda x: mention_length(x["tail"], F.col("number")) > 0)).alias("n"))


@query()
def scored_context(documents):
    from inkquarry.operators.context import scored_sentences

    return documents.select("doc_id", scored_sentences(F.col("text"), F.lit("Then there were others with this thing"), F.lit("3")).alias("context"))


# JSON of models, figures, geometry


@query("SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def json_parse_defaults(events):
    x = J.parse_object(F.concat(F.lit("```json\n"), "props", F.lit("\n```")), "struct<k:bigint,missing:string>")
    return events.select("event_id", x.alias("x")).select("event_id", F.coalesce("x.k", F.lit(-1).cast("long")).alias("k"), F.coalesce("x.missing", F.lit("none")).alias("missing"))


@query("""WITH k AS (SELECT event_id, value, ['a Bar_Chart, surely', 'flowchart', 'something', 'western_blot', 'Spectrum_NMR', 'spectrum_ms or spectrum_ir', ' TABLE ', 'microscopy', 'heatmap', 'diagram'][event_id % 10 + 1] AS raw, event_id % 7 AS m FROM events),
c AS (SELECT *, CASE WHEN m IN (5, 6) THEN 0.0 WHEN m = 4 THEN 0.3 ELSE least(greatest(value / 60, 0), 1) END AS confidence FROM k), t AS (SELECT *, CASE WHEN m IN (5, 6) OR confidence < 0.7 THEN 'other' ELSE
CASE raw WHEN 'a Bar_Chart, surely' THEN 'bar_chart' WHEN 'flowchart' THEN 'diagram' WHEN 'something' THEN 'other' WHEN 'Spectrum_NMR' THEN 'spectrum_nmr' WHEN 'spectrum_ms or spectrum_ir' THEN 'spectrum_ir' WHEN ' TABLE ' THEN 'table' ELSE raw END END AS figure_type FROM c)
SELECT event_id, confidence, figure_type, m NOT IN (5, 6) AND coalesce(CASE WHEN m = 3 THEN false END, figure_type NOT IN ('microscopy', 'diagram')) AS quantitative, CASE WHEN m IN (5, 6) THEN 'Classification failed — defaulting to ''other''.' ELSE '' END AS reasoning FROM t""")
def confidence_relabel(events):
    """Answers in prose, fences and pieces, some without a score, some unreadable, over all kinds of types."""
    raw = F.get(F.array(*map(F.lit, ("a Bar_Chart, surely", "flowchart", "something", "western_blot", "Spectrum_NMR", "spectrum_ms or spectrum_ir", " TABLE ", "microscopy", "heatmap", "diagram"))), (F.col("event_id") % 10).cast("int"))
    m, score = F.col("event_id") % 7, F.col("value") / 60
    plain = F.struct(raw.alias("figure_type"), score.alias("confidence"))
    answer = (
        F.when(m == 0, F.to_json(plain)).when(m == 1, F.concat(F.lit("```json\n"), F.to_json(plain), F.lit("\n```"))).when(m == 2, F.concat(F.lit("Here it is: "), F.to_json(plain), F.lit(" so.")))
        .when(m == 3, F.to_json(F.struct(raw.alias("figure_type"), score.cast("string").alias("confidence"), F.lit(False).alias("has_quantitative_data")))).when(m == 4, F.to_json(F.struct(raw.alias("figure_type"))))
        .when(m == 5, "{ }").otherwise(F.to_json(F.struct(raw.alias("figure_type"), F.lit("high").alias("confidence"))))
    )
    c = events.select("event_id", J.classified(answer).alias("c"))
    return c.select("event_id", "c.confidence", "c.figure_type", F.col("c.has_quantitative_data").alias("quantitative"), "c.reasoning")


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity / 50 * 9 + 1, 6) AS linear, round(power(10, l_quantity / 50 * 3), 6) AS log FROM lineitem""")
def axis_linear_log(lineitem):
    px, z = F.col("l_quantity"), F.lit(0.0)
    return lineitem.select(
        "l_orderkey", "l_linenumber", F.round(G.pixel_to_data(px, z, F.lit(50.0), F.lit(1.0), F.lit(10.0), F.lit(False)), 6).alias("linear"),
        F.round(G.pixel_to_data(px, z, F.lit(50.0), F.lit(1.0), F.lit(1000.0), F.lit(True)), 6).alias("log"),
    )


@query("SELECT l_orderkey, l_linenumber, l_quantity AS x, l_tax AS y, 100 - l_quantity AS w, 1 - l_tax AS h, (100 - l_quantity) * (1 - l_tax) * power(300.0 / 72, 2) >= 1000 AS large FROM lineitem")
def struct_bbox(lineitem):
    b = G.box_of(F.array("l_quantity", "l_tax", F.lit(100.0), F.lit(1.0)))
    return lineitem.select("l_orderkey", "l_linenumber", b.alias("b")).select("l_orderkey", "l_linenumber", "b.*", G.large_enough(F.col("b.w"), F.col("b.h"), least=1000).alias("large"))


@query("""WITH s AS (SELECT o_orderkey, to_json([{'id': o_orderkey, 'o_totalprice': o_totalprice}]) AS series FROM orders), f AS (SELECT o_custkey, list({'page_number': 1, 'figure_number': o_orderkey::VARCHAR, 'id': o_orderkey, 'series': [{'id': o_orderkey, 'o_totalprice': o_totalprice}]} ORDER BY o_orderkey::VARCHAR) AS fs FROM orders GROUP BY 1)
SELECT c_custkey AS id, to_json(fs)::VARCHAR AS figures FROM customer LEFT JOIN f ON o_custkey = c_custkey""")
def nested_json_doc(customer, orders):
    papers = customer.select(F.col("c_custkey").alias("id"), "c_name")
    figures = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("paper_id"), F.lit(1).alias("page_number"), F.col("o_orderkey").cast("string").alias("figure_number"))
    series = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("figure_id"), "o_totalprice")
    return store.nested(papers, figures, series).select("id", F.to_json("figures", {"ignoreNullFields": "false"}).alias("figures"))


@query("""WITH t AS (SELECT l_suppkey AS k, l_quantity AS x, l_extendedprice AS y, l_extendedprice * (1 - l_discount) AS z FROM lineitem),
r AS (SELECT k, min(x) AS x0, max(x) - min(x) AS xs, min(y) AS y0, max(y) - min(y) AS ys, min(z) AS z0, max(z) - min(z) AS zs FROM t GROUP BY k),
n AS (SELECT k, CASE WHEN xs > 0 THEN (x - x0) / xs ELSE x - x0 END AS x, CASE WHEN ys > 0 THEN (y - y0) / ys ELSE y - y0 END AS y, CASE WHEN zs > 0 THEN (z - z0) / zs ELSE z - z0 END AS z FROM t JOIN r USING (k))
SELECT k, avg(CASE WHEN EXISTS (SELECT 1 FROM n b WHERE b.k = a.k AND sqrt(power(a.x - b.x, 2) + power(a.z - b.y, 2)) <= 0.05) THEN 1.0 ELSE 0.0 END) AS "precision",
avg(CASE WHEN EXISTS (SELECT 1 FROM n b WHERE b.k = a.k AND sqrt(power(a.x - b.x, 2) + power(a.y - b.z, 2)) <= 0.05) THEN 1.0 ELSE 0.0 END) AS recall FROM n a GROUP BY k""")
def point_precision_recall(lineitem):
    t = lineitem.select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    p = lineitem.select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"))
    return M.point_precision_recall(t, p, "k")


@query("""WITH v AS (SELECT l_orderkey AS figure, l_extendedprice AS y, l_extendedprice * (1 - l_discount) AS z FROM lineitem),
g AS (SELECT figure, coalesce(sqrt(avg(power(y - z, 2))) / nullif(max(y) - min(y), 0), 0) AS rmse, CASE WHEN count(*) < 2 THEN 0 WHEN min(y) = max(y) THEN CASE WHEN sum(power(y - z, 2)) = 0 THEN 1 ELSE 0 END ELSE 1 - sum(power(y - z, 2)) / (var_pop(y) * count(*)) END AS r2 FROM v GROUP BY 1)
SELECT figure, 'line_plot' AS figure_type, round(rmse, 6) AS rmse, round(r2, 4)::DOUBLE AS r2, rmse <= 0.05 AS passed FROM g""")
def benchmark_report(lineitem):
    rows = lineitem.groupBy(F.col("l_orderkey").alias("figure"), F.col("l_returnflag").alias("series_name")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_discount"))).alias("p"))
    rows = rows.withColumns({"figure_type": F.lit("line_plot"), "ord": F.ascii("series_name")})
    truth = rows.select("figure", "figure_type", "ord", "series_name", F.col("p.l_extendedprice").alias("ys"))
    predicted = rows.select("figure", "figure_type", "ord", "series_name", F.transform("p", lambda x: x["l_extendedprice"] * (1 - x["l_discount"])).alias("ys"))
    return M.benchmark(truth, predicted).withColumns({"rmse": F.round("rmse", 6), "r2": F.round("r2", 4)})


# Documents: pages, spans, captions, contexts


@query("SELECT conv_id AS paper_id, turn::INTEGER AS page_idx, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 100 AS maybe_scanned FROM conversations")
def page_flags(conversations):
    return conversations.select(F.col("conv_id").alias("paper_id"), F.col("turn").cast("int").alias("page_idx"), T.maybe_scanned(F.col("text")).alias("maybe_scanned"))


@query("SELECT conv_id AS paper_id, text FROM conversations WHERE turn = 2")
def page_lookup(conversations):
    from inkquarry.sources.files import page_text

    return page_text(conversations.select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("page_idx"), "text"), 3)


def _spans(lineitem) -> DataFrame:
    span = F.struct(
        F.col("l_linenumber").alias("page"), (F.col("l_partkey") % 3).cast("int").alias("type"), F.when(F.col("l_suppkey") % 4 == 0, "  ").otherwise(F.concat(F.lit("  part "), F.col("l_partkey").cast("string"), F.lit(" title\t"))).alias("text"),
        F.lit(0.0).alias("x0"), F.col("l_quantity").alias("y0"), F.lit(9.0).alias("x1"), (F.col("l_quantity") + 1).alias("y1"), (F.col("l_quantity") / 5).alias("font_size"),
    )
    return lineitem.groupBy(F.col("l_orderkey").alias("path")).agg(F.array_sort(F.collect_list(span)).alias("spans"))


_SPANS = """WITH x AS (SELECT l_orderkey AS paper_id, l_linenumber AS page, l_partkey % 3 AS type, CASE WHEN l_suppkey % 4 = 0 THEN '  ' ELSE '  part ' || l_partkey || ' title' || chr(9) END AS raw, l_quantity AS y0, l_quantity / 5 AS font_size FROM lineitem),
s AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY page, type, raw, y0) - 1 AS ord, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS text FROM x), k AS (SELECT * FROM s WHERE type = 0 AND font_size >= 4 AND text <> '') """


@query(_SPANS + "SELECT paper_id, page, text, y0, font_size FROM k")
def spans_kept(lineitem):
    from inkquarry.sources.files import text_spans

    return text_spans(_spans(lineitem)).select("paper_id", "page", "text", F.get("bbox", F.lit(1)).alias("y0"), "font_size")


@query(_SPANS + "SELECT paper_id, text AS title FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY font_size DESC, ord) AS r FROM k WHERE page = 1 AND length(text) > 10) WHERE r = 1")
def title_sniff(lineitem):
    from inkquarry.operators.context import title_of_first_page
    from inkquarry.sources.files import text_spans

    return title_of_first_page(text_spans(_spans(lineitem)).withColumn("page", F.col("page") - 1))


@query("""WITH i AS (SELECT c_custkey AS paper_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS title, c_name || '; ' || c_mktsegment || ', , x' AS author, CASE c_custkey % 4 WHEN 0 THEN 'Adobe InDesign' WHEN 1 THEN 'Journal of ' || c_mktsegment WHEN 2 THEN '' END AS creator, CASE WHEN c_custkey % 8 = 2 THEN 'Microsoft Word' ELSE 'Press ' || c_nationkey END AS producer FROM customer)
SELECT paper_id, coalesce(nullif(title, ''), 'sniffed ' || paper_id) AS title, array_to_string(list_filter(list_transform(regexp_split_to_array(author, '[;,]'), lambda a: trim(a)), lambda a: a <> ''), '|') AS authors,
CASE WHEN NOT regexp_matches(coalesce(nullif(creator, ''), producer), 'Microsoft|Adobe') THEN coalesce(nullif(creator, ''), producer) END AS journal, 'page of ' || paper_id || chr(10) || chr(10) || 'end' AS full_text, 2::BIGINT AS page_count FROM i""")
def metadata_fill(customer):
    from inkquarry.operators.context import papers_from_pages

    i, text = F.col("c_custkey"), lambda c: c.cast("string")
    info = customer.select(
        i.alias("paper_id"), F.when(i % 3 == 0, "").otherwise(F.col("c_name")).alias("title"), F.concat("c_name", F.lit("; "), "c_mktsegment", F.lit(", , x")).alias("author"),
        F.when(i % 4 == 0, "Adobe InDesign").when(i % 4 == 1, F.concat(F.lit("Journal of "), "c_mktsegment")).when(i % 4 == 2, "").alias("creator"),
        F.when(i % 8 == 2, "Microsoft Word").otherwise(F.concat(F.lit("Press "), text(F.col("c_nationkey")))).alias("producer"), F.concat(F.lit("sniffed "), text(i)).alias("sniffed_title"),
    )
    pages = customer.select(i.alias("paper_id"), F.posexplode(F.array(F.concat(F.lit("page of "), text(i)), F.lit("end"))).alias("page_idx", "text"))
    return papers_from_pages(pages, info).select("paper_id", "title", F.array_join("authors", "|").alias("authors"), "journal", "full_text", "page_count")


@query(r"""WITH t AS (SELECT doc_id, replace(replace(text, ' the ', ' Figs. S3a – 5 '), ' of ', ' FIGURE  12b ') AS t FROM documents), r AS (SELECT doc_id, t, regexp_extract_all(t, '(?i)\b(?:Fig(?:ure|s?\.?)?)\s*\.?\s*([A-Z]?\d+[a-z]?(?:\s*[–-]\s*\d+)?)\b') AS refs FROM t)
SELECT doc_id, array_to_string(list_transform(refs, lambda x: trim(x)), '|') AS refs, len(refs)::INTEGER AS n FROM r""")
def figure_references(documents):
    t = F.replace(F.replace("text", F.lit(" the "), F.lit(" Figs. S3a – 5 ")), F.lit(" of "), F.lit(" FIGURE  12b "))
    found = documents.select("doc_id", T.figure_references(t).alias("r"))
    return found.select("doc_id", F.array_join(F.transform("r", lambda x: x["figure_ref"]), "|").alias("refs"), F.size("r").alias("n"))


@query("""WITH b AS (SELECT l_orderkey AS paper_id, l_linenumber AS page, l_quantity AS y0, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 'Fig. ' || l_partkey || ' shows' WHEN l_partkey % 3 = 1 THEN 'Supplementary  Figure S' || l_partkey ELSE 'text ' || l_partkey END AS text FROM lineitem),
f AS (SELECT o_orderkey AS figure_id, o_orderkey AS paper_id, 1 AS page, (o_custkey % 30)::DOUBLE AS y1 FROM orders), j AS (SELECT f.figure_id, b.y0, b.text FROM f JOIN b USING (paper_id, page) WHERE y0 BETWEEN y1 AND y1 + 80)
SELECT o_orderkey AS figure_id, coalesce((SELECT text FROM j WHERE j.figure_id = o_orderkey AND regexp_matches(text, '(?i)^(Figure|Fig\\.|FIGURE|Supplementary\\s+Figure|Supp\\.?\\s*Fig\\.?)\\s*[\\dS]') ORDER BY y0, text LIMIT 1), (SELECT string_agg(text, ' ' ORDER BY y0, text) FROM j WHERE j.figure_id = o_orderkey), '') AS caption FROM orders""")
def captions_below(orders, lineitem):
    from inkquarry.operators.context import captions_below as below

    p = F.col("l_partkey").cast("string")
    text = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("Fig. "), p, F.lit(" shows"))).when(F.col("l_partkey") % 3 == 1, F.concat(F.lit("Supplementary  Figure S"), p)).otherwise(F.concat(F.lit("text "), p))
    blocks = lineitem.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("y0"), text.alias("text"))
    figures = orders.select(F.col("o_orderkey").alias("figure_id"), F.col("o_orderkey").alias("paper_id"), F.lit(1).alias("page"), (F.col("o_custkey") % 30).cast("double").alias("y1"))
    return below(figures, blocks).select("figure_id", "caption")


_PAGES = """WITH p AS (SELECT conv_id, turn + 1 AS page, CASE WHEN turn % 3 = 0 THEN replace(text, ' the ', ' (Figure  7) ') ELSE text END AS text FROM conversations),
f AS (SELECT conv_id, page AS own FROM p GROUP BY 1, 2), w AS (SELECT f.conv_id, own, string_agg(text, chr(10) ORDER BY page, text) AS near, max(CASE WHEN page = own THEN text END) AS own_text FROM f JOIN p ON p.conv_id = f.conv_id AND page BETWEEN own - 1 AND own + 1 GROUP BY 1, 2),
m AS (SELECT *, regexp_extract(near, '(?i)\\bFig(?:ure)?\\.?\\s*7\\b') AS hit FROM w), g AS (SELECT *, strpos(near, hit) - 1 AS pos, greatest(strpos(near, hit) - 1 - 750, 0) AS lo FROM m) """


@query(_PAGES + """SELECT conv_id || '/' || own AS figure_id, regexp_replace(CASE WHEN hit <> '' THEN substring(near, (lo + 1)::BIGINT, (pos + length(hit) + 750 - lo)::BIGINT) ELSE substring(own_text, 1, 1500) END, '^\\s+|\\s+$', '', 'g') AS surrounding_text FROM g""")
def surrounding_window(conversations):
    from inkquarry.operators.context import surrounding_text

    text = F.when(F.col("turn") % 3 == 0, F.replace("text", F.lit(" the "), F.lit(" (Figure  7) "))).otherwise(F.col("text"))
    pages = conversations.select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("page_idx"), text.alias("text"))
    figures = pages.select("paper_id", (F.col("page_idx") + 1).alias("page_number")).distinct().withColumns({"figure_id": F.concat_ws("/", "paper_id", "page_number"), "figure_number": F.lit("7")})
    return surrounding_text(figures, pages).select("figure_id", "surrounding_text")


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'A caption of ' || source END AS caption, text AS methods, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang || ': ' || text END AS results, text FROM documents)
SELECT doc_id, regexp_replace(substring(concat_ws(chr(10) || chr(10), CASE WHEN caption <> '' THEN 'FIGURE CAPTION: ' || caption END, CASE WHEN doc_id % 2 = 0 THEN 'IN-TEXT DESCRIPTION: one ' || doc_id || '; two' END, CASE WHEN methods <> '' THEN 'METHODS CONTEXT: ' || substring(methods, 1, 500) END, CASE WHEN results <> '' THEN 'RESULTS CONTEXT: ' || substring(results, 1, 500) END), 1, 3000), '^\\s+|\\s+$', '', 'g') AS summary FROM d""")
def context_summary(documents):
    from inkquarry.operators.context import context_summary as summary

    i = F.col("doc_id")
    refs = F.when(i % 2 == 0, F.array(F.concat(F.lit("one "), i.cast("string")), F.lit("two"), F.lit("three"))).otherwise(F.array().cast("array<string>"))
    caption, results = F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("A caption of "), "source")), F.when(i % 4 == 0, "").otherwise(F.concat_ws(": ", "lang", "text"))
    return documents.select("doc_id", summary(caption, refs, F.col("text"), results).alias("summary"))


@query("""SELECT doc_id, concat_ws(chr(10), 'Paper: ' || CASE WHEN doc_id % 5 = 0 THEN 'Unknown' ELSE source END, 'DOI: Unknown', 'Figure ' || doc_id || CASE WHEN lang = 'en' THEN ' (line_plot)' ELSE '' END, '', CASE WHEN doc_id % 3 = 0 THEN '=== CAPTION ===' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '(no caption available)' ELSE 'about ' || lang END ELSE '=== CONTEXT ===' || chr(10) || text END, '',
'=== TASK ===', 'Extract ALL numerical data from this figure image.', 'For each data series output a JSON object with keys:', '  series_name, x_label, x_unit, y_label, y_unit,', '  axis_scale_x (linear|log), axis_scale_y (linear|log),', '  data_points ([{x, y, err_x, err_y},...]),', '  statistical_annotations ([{marker, x, p_value},...]).', 'Output a JSON array of series objects. No extra text.') AS prompt FROM documents""")
def prompt_text(documents):
    from inkquarry.operators.context import extraction_prompt

    i = F.col("doc_id")
    kind, context = F.when(F.col("lang") == "en", "line_plot"), F.when(i % 3 == 0, "").otherwise(F.col("text"))
    return documents.select("doc_id", extraction_prompt(F.when(i % 5 == 0, "").otherwise(F.col("source")), F.lit(None).cast("string"), i.cast("string"), kind, context, F.when(i % 2 == 0, "").otherwise(F.concat(F.lit("about "), "lang"))).alias("prompt"))


# Figures


@query("""SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 3 = 0 THEN '1' ELSE o_custkey::VARCHAR END AS figure_number, (o_orderkey % 7 + 1)::INTEGER AS page_number, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS caption,
CASE o_orderkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 3.0 ELSE 1.0 END AS x1, CASE o_orderkey % 5 WHEN 0 THEN 0.0 ELSE o_totalprice END AS y2 FROM orders""")
def extractor_mapping(orders):
    """JSON of a figure extractor to figures: names, else places; pages from 1; regions, else those of captions."""
    from inkquarry.sources.files import extracted_figures

    k = F.col("o_orderkey")
    region = lambda x: F.struct(F.lit(x).alias("x1"), F.lit(0.0).alias("y1"), F.lit(9.0).alias("x2"), F.col("o_totalprice").alias("y2"))
    raw = F.to_json(F.array(F.struct(
        F.lit("Figure").alias("figType"), F.when(k % 3 == 1, F.col("o_custkey").cast("string")).alias("name"), F.when(k % 3 == 2, F.col("o_custkey")).alias("number"), F.when(k % 4 != 0, F.col("o_orderpriority")).alias("caption"),
        (k % 7).cast("int").alias("page"), F.when(k % 5 > 1, region(1.0)).alias("regionBoundary"), F.when(k % 5 > 0, region(3.0)).alias("captionBoundary"),
    )))
    return orders.select(k.alias("doc"), F.explode(extracted_figures(raw)).alias("f")).select("doc", "f.figure_number", "f.page_number", "f.caption", "f.x1", "f.y2")


@query("""WITH p AS (SELECT o_custkey AS k, o_orderkey AS id, 'pdffigures2' AS source FROM orders WHERE o_totalprice > 150000), s AS (SELECT o_custkey AS k, o_orderkey AS id, 'raster' AS source FROM orders WHERE o_totalprice <= 150000)
SELECT * FROM p UNION ALL SELECT * FROM s WHERE k NOT IN (SELECT k FROM p)""")
def source_fallback(orders):
    from inkquarry.sources.files import first_source

    side = lambda cond, name: orders.where(cond).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.lit(name).alias("source"))
    return first_source(side("o_totalprice > 150000", "pdffigures2"), side("o_totalprice <= 150000", "raster"), "k")


@query("""WITH f AS (SELECT l_orderkey AS paper_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS ord, (l_linenumber % 4 + 1)::INTEGER AS page_number, l_quantity AS w, l_tax * 500 AS h FROM lineitem), r AS (SELECT paper_id, ord, page_number, 'raster' AS source, w, h FROM f WHERE w * h * power(300.0 / 72, 2) >= 10000),
p AS (SELECT o_orderkey AS paper_id, unnest([1, 2, 3, 4]) AS page_number, o_custkey FROM orders), v AS (SELECT paper_id, NULL AS ord, page_number, 'vector' AS source, 600.0 AS w, 800.0 AS h FROM p WHERE (o_custkey + 13 * page_number) % 61 > 30 AND NOT EXISTS (SELECT 1 FROM r WHERE r.paper_id = p.paper_id AND r.page_number = p.page_number)), a AS (SELECT * FROM r UNION ALL SELECT * FROM v)
SELECT paper_id, page_number, source, w, h, (row_number() OVER (PARTITION BY paper_id ORDER BY page_number, ord NULLS LAST))::VARCHAR AS figure_number FROM a""")
def figure_sources(orders, lineitem):
    """Raster figures that are large enough, whole pages of drawings where there are none, numbered in the order of pages."""
    from inkquarry.config import Settings
    from inkquarry.operators.images import IMAGE
    from inkquarry.plans.process import figures_of

    nothing = lambda kind: F.lit(None).cast(kind)
    figure = F.struct(
        nothing("string").alias("figure_number"), (F.col("l_linenumber") % 4 + 1).cast("int").alias("page_number"), F.lit("").alias("caption"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("l_quantity").alias("x2"), (F.col("l_tax") * 500).alias("y2"),
        F.lit("raster").alias("source"), nothing(IMAGE).alias("image"),
    )
    per = lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", figure.alias("f")))), lambda x: x["f"]).alias("figures"))
    page = lambda k: F.struct(F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), ((F.col("o_custkey") + 13 * k) % 61).cast("int").alias("n_paths"), nothing(IMAGE).alias("image"))
    parsed = orders.join(per, orders["o_orderkey"] == per["l_orderkey"], "left").select(F.col("o_orderkey").alias("path"), "figures", F.array(*[page(k) for k in (1, 2, 3, 4)]).alias("page_info"))
    return figures_of(parsed, Settings()).select("paper_id", "page_number", "source", F.col("x2").alias("w"), F.col("y2").alias("h"), "figure_number")


@query("""WITH t AS (SELECT doc_id, '(b) first [A] then (' || ['a', 'C', 'h', 'Z'][doc_id % 4 + 1] || ') of ' || source AS caption FROM documents), l AS (SELECT doc_id, caption, list_sort(list_distinct(list_transform(regexp_extract_all(caption, '(?i)[\\(\\[]([A-H])[\\)\\]]', 1), lambda x: upper(x)))) AS labels FROM t), p AS (SELECT doc_id, caption, unnest(labels) AS label, generate_subscripts(labels, 1) AS i FROM l)
SELECT doc_id, label, i::INTEGER - 1 AS panel FROM p WHERE i <= 2""")
def zip_labels(documents):
    """Labels of captions with the panels of an image, by place; labels beyond the panels are dropped."""
    letter = F.get(F.array(*map(F.lit, "aChZ")), (F.col("doc_id") % 4).cast("int"))
    labels = T.panel_labels(F.concat(F.lit("(b) first [A] then ("), letter, F.lit(") of "), "source"))
    zipped = documents.select("doc_id", F.explode(F.arrays_zip(labels.alias("label"), F.array(F.lit(0), F.lit(1)).alias("panel"))).alias("z"))
    return zipped.select("doc_id", "z.label", "z.panel").where("label is not null and panel is not null")


@query("""WITH s AS (SELECT (user_id % 3)::VARCHAR AS image_id, user_id::INTEGER AS series_id, floor(value)::INTEGER AS px, (event_id % 100)::INTEGER AS py FROM events), b AS (SELECT *, CASE WHEN px - lag(px) OVER w > 5 THEN 1 ELSE 0 END AS brk FROM s WINDOW w AS (PARTITION BY image_id, series_id ORDER BY px, py)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY image_id, series_id ORDER BY px, py ROWS UNBOUNDED PRECEDING) AS grp FROM b), m AS (SELECT image_id, series_id, median(px) AS x, median(py) AS y FROM g GROUP BY image_id, series_id, grp)
SELECT image_id, series_id, round(round(CASE image_id WHEN '0' THEN x / 100 * 10 ELSE power(10, x / 200 * 3) END, 6), 5) AS x, round(round(CASE image_id WHEN '0' THEN 1 - y / 100 ELSE 5 + y / 50 END, 6), 5) AS y FROM m WHERE image_id <> '2'""")
def calibrated_points(events):
    """Pixels of three images to points, each by its own calibration; the third has none and gives no points."""
    coords = events.select((F.col("user_id") % 3).cast("string").alias("image_id"), F.col("user_id").cast("int").alias("series_id"), F.floor("value").cast("int").alias("px"), (F.col("event_id") % 100).cast("int").alias("py"))
    rows = [("0", "x", 0.0, 100.0, 0.0, 10.0, False), ("0", "y", 0.0, 100.0, 1.0, 0.0, False), ("1", "x", 0.0, 200.0, 1.0, 1000.0, True), ("1", "y", 0.0, 100.0, 5.0, 7.0, False), ("2", "x", 0.0, 1.0, 0.0, 1.0, False)]
    calibration = events.sparkSession.createDataFrame(rows, "image_id string, axis string, pixel_min double, pixel_max double, data_min double, data_max double, is_log boolean")
    return O.digitize(coords, calibration).select("image_id", "series_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("""WITH s AS (SELECT o_custkey AS paper, o_orderkey % 3 AS fig, o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a b/c' ELSE o_orderpriority END AS name, o_totalprice AS y FROM orders),
n AS (SELECT *, 'fig' || fig || 'A_' || replace(replace(CASE WHEN name = '' THEN 'series' ELSE name END, ' ', '_'), '/', '-') AS file FROM s WHERE id % 5 <> 0)
SELECT CASE WHEN count(*) OVER (PARTITION BY file) > 1 THEN file || '_' || id ELSE file END AS file, 0 AS ord, y FROM n""")
def csv_names(orders):
    """Points by the names of their files: names that repeat get the series' id, series without points no file."""
    fig = (F.col("o_orderkey") % 3).cast("string")
    figures = orders.select((F.col("o_orderkey") % 3).alias("id"), fig.alias("figure_number"), F.lit("A").alias("panel_label"), F.lit(1).alias("paper_id")).distinct()
    k, none = F.col("o_orderkey") % 4, F.lit(None).cast("double")
    point = F.struct(none.alias("x"), F.col("o_totalprice").alias("y"))
    series = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("figure_id"), F.when(k == 0, "").when(k == 1, "a b/c").otherwise(F.col("o_orderpriority")).alias("series_name"), F.when(F.col("o_orderkey") % 5 == 0, F.slice(F.array(point), 1, 0)).otherwise(F.array(point)).alias("data_points"))
    return store.points_of(figures, series).select("file", "ord", "y")


@query("""WITH s AS (SELECT o_custkey % 40 AS paper_id, o_orderkey % 3 AS fig, o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a b/c' ELSE o_orderpriority || o_orderkey END AS name, o_totalprice AS y FROM orders),
n AS (SELECT *, 'fig' || fig || 'A_' || replace(replace(CASE WHEN name = '' THEN 'series' ELSE name END, ' ', '_'), '/', '-') AS file FROM s WHERE id % 5 <> 0)
SELECT paper_id, CASE WHEN count(*) OVER (PARTITION BY paper_id, file) > 1 THEN file || '_' || id ELSE file END AS file, 'x,y,err_x,err_y' || chr(10) || ',' || round(y)::BIGINT || '.0,,' || chr(10) AS content FROM n""")
def csv_files_per_paper(orders):
    """The CSV files of all papers: names count within their paper."""
    paper, fig = F.col("o_custkey") % 40, F.col("o_orderkey") % 3
    figures = orders.select((paper * 3 + fig).alias("id"), paper.alias("paper_id"), fig.cast("string").alias("figure_number"), F.lit("A").alias("panel_label")).distinct()
    k, none = F.col("o_orderkey") % 4, F.lit(None).cast("double")
    point = F.struct(none.alias("x"), F.round("o_totalprice").alias("y"), none.alias("err_x"), none.alias("err_y"))
    name = F.when(k == 0, "").when(k == 1, "a b/c").otherwise(F.concat("o_orderpriority", "o_orderkey"))
    series = orders.select(F.col("o_orderkey").alias("id"), (paper * 3 + fig).alias("figure_id"), name.alias("series_name"), F.when(F.col("o_orderkey") % 5 == 0, F.slice(F.array(point), 1, 0)).otherwise(F.array(point)).alias("data_points"))
    return store.series_files(figures, series).select("paper_id", "file", store.csv_text(F.col("data_points")).alias("content"))


def _stored(customer, orders, lineitem) -> tuple[DataFrame, DataFrame, DataFrame]:
    papers = customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("title"), F.lit(None).cast("string").alias("doi"), F.concat(F.lit("/p/"), F.col("c_custkey").cast("string")).alias("pdf_path"))
    figures = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").cast("string").alias("figure_number"), F.lit("").alias("panel_label"), (F.col("o_orderkey") % 5).cast("int").alias("page_number"), F.col("o_orderpriority").alias("figure_type"))
    series = lineitem.select(F.col("l_orderkey").alias("figure_id"), F.sequence(F.lit(1), F.col("l_quantity").cast("int")).alias("data_points"))
    return papers, figures, series


_COUNTS = "WITH s AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity::INTEGER)::BIGINT AS p FROM lineitem GROUP BY 1), f AS (SELECT o_custkey, o_orderkey, o_orderkey % 5 AS page, o_orderpriority, coalesce(n, 0) AS n, coalesce(p, 0) AS p FROM orders LEFT JOIN s ON l_orderkey = o_orderkey), "


@query("""WITH p AS (SELECT row_number() OVER (ORDER BY c_name) AS id, c_custkey, c_name, c_acctbal, c_nationkey FROM customer WHERE c_custkey % 4 <> 0),
q AS (SELECT (SELECT count(*) FROM p) + row_number() OVER (ORDER BY c_name) AS id, c_custkey, c_name, c_acctbal, c_nationkey FROM customer WHERE c_custkey % 4 = 0),
f AS (SELECT o_custkey, count(*) FILTER (o_orderkey % 2 = 0) AS first, count(*) FILTER (o_orderkey % 2 = 1) AS second FROM orders GROUP BY 1),
a AS (SELECT * FROM p UNION ALL SELECT * FROM q)
SELECT id, c_name AS pdf_path, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN 'new ' || c_nationkey ELSE c_nationkey::VARCHAR END AS title, coalesce(CASE WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN second ELSE first END, 0)::BIGINT AS n_figures FROM a LEFT JOIN f ON o_custkey = c_custkey""")
def merge_on_read(customer, orders):
    """A store of customers as papers and orders as figures after two transactions: new and known papers, each key twice in the second one, and figures that give way to others."""
    from inkquarry.staging import shared_folder

    spark = customer.sparkSession
    held = store.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex[:12]}")
    papers = customer.select("c_custkey", F.col("c_name").alias("pdf_path"), F.col("c_nationkey").cast("string").alias("title"))
    figures = orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderkey").cast("string").alias("figure_number"), F.lit("").alias("panel_label"), F.lit(1).alias("page_number"))

    def put(rows: DataFrame, parity: int):
        def change(t: store.Transaction) -> None:
            t.upsert_papers(rows.select("pdf_path", "title"))
            ids = t.read("papers").select("pdf_path", F.col("id").alias("paper_id")).join(rows.select("c_custkey", "pdf_path").distinct(), "pdf_path")
            t.replace_figures_of(ids.select("paper_id"), figures.where(F.col("o_orderkey") % 2 == parity).join(ids, "c_custkey"))

        held.transact(change)

    put(papers.where("c_custkey % 4 <> 0"), 0)
    again = papers.where("c_custkey % 3 = 0 or c_custkey % 4 = 0")
    put(again.withColumn("title", F.concat(F.lit("new "), "title")).unionByName(again.withColumn("title", F.lit("0 older"))), 1)
    now = held.snapshot()
    n = now.read("figures").groupBy("paper_id").agg(F.count("*").alias("n_figures"))
    return now.read("papers").join(n, F.col("id") == F.col("paper_id"), "left").select("id", "pdf_path", "title", F.coalesce("n_figures", F.lit(0)).alias("n_figures"))


@query(_COUNTS + """t AS (SELECT c_custkey, c_name, count(o_orderkey) AS figs, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(p), 0)::BIGINT AS p, list(printf('  Fig %-5s | %-20s | %d series | %d data points', o_orderkey::VARCHAR, o_orderpriority, n, p) ORDER BY page, o_orderkey::VARCHAR) FILTER (o_orderkey IS NOT NULL) AS lines FROM customer LEFT JOIN f ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_custkey AS paper_id, array_to_string(list_concat(list_concat([repeat('=', 60), 'Extraction Report', repeat('=', 60), 'Paper   : ' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Unknown' END, 'DOI     : Unknown', 'PDF     : /p/' || c_custkey, 'Figures : ' || figs, ''], coalesce(lines, [])), ['', 'Total series extracted : ' || n, 'Total data points      : ' || p, repeat('=', 60)]), chr(10)) AS report FROM t""")
def report_text(customer, orders, lineitem):
    lines = store.text_report(*_stored(customer, orders, lineitem))
    return lines.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), "\n").alias("report"))


@query("""WITH r AS (SELECT event_type, count(*) FILTER (event_id % 10 <> 0) AS n, count(*) FILTER (event_id % 10 <> 0 AND value <= 50) AS p, avg(value) FILTER (event_id % 10 <> 0) AS rmse FROM events GROUP BY 1), t AS (SELECT count(*) AS n, count(*) FILTER (event_id % 10 <> 0 AND value <= 50) AS p, count(*) FILTER (event_id % 10 <> 0) AS k, avg(value) FILTER (event_id % 10 <> 0) AS rmse, avg(1 - value) FILTER (event_id % 10 <> 0) AS r2 FROM events)
SELECT ord::INTEGER AS ord, value FROM (SELECT 0 AS ord, 'Total figures : ' || n AS value FROM t UNION ALL SELECT 1, 'Passed        : ' || p FROM t UNION ALL SELECT 2, 'Failed        : ' || (k - p) FROM t UNION ALL SELECT 3, printf('Pass rate     : %.1f%%', 100.0 * p / n) FROM t UNION ALL SELECT 4, printf('Mean RMSE     : %.4f  (threshold=0.05)', rmse) FROM t UNION ALL SELECT 5, printf('Mean R²       : %.4f', r2) FROM t UNION ALL SELECT 6, 'Results by figure type:'
UNION ALL SELECT 6 + row_number() OVER (ORDER BY event_type), printf('  %-20s %d/%d passed  RMSE=%.4f', event_type, p, n, rmse) FROM r)""")
def benchmark_lines(events):
    """The benchmark as text: types in order, skipped figures in the total only."""
    skipped, v = F.col("event_id") % 10 == 0, F.col("value")
    results = events.select(F.col("event_type").alias("figure_type"), F.when(~skipped, v).alias("rmse"), F.when(~skipped, 1 - v).alias("r2"), (~skipped & (v <= 50)).alias("passed"), skipped.alias("skipped"))
    return M.report_lines(results)


@query("SELECT doc_id, 'You are a scientific data extraction expert.' || chr(10) || 'Extract ALL numerical data from the provided scientific figure image.' || chr(10) || 'Output a JSON array of data series objects.' || chr(10) || chr(10) || 'Figure Caption: ' || text || chr(10) || chr(10) || 'Output:' AS ask, '[' || n_chars || ']' AS answer FROM documents")
def chat_samples(documents):
    plots = documents.select(F.col("doc_id").alias("plot_id"), F.col("text").alias("caption"))
    answers = documents.select(F.col("doc_id").alias("plot_id"), F.concat(F.lit("["), F.col("n_chars").cast("string"), F.lit("]")).alias("answer"))
    m = F.col("messages")
    return synthetic.chat_samples(plots, answers).select(F.col("plot_id").alias("doc_id"), F.get(m, F.lit(0))["content"].alias("ask"), F.get(m, F.lit(1))["content"].alias("answer"))


# Models and generated data


@query()
def kmeans_clusters(embeddings):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=10, seed=1, maxIter=10).fit(v).transform(v).select("vec_id", F.col("prediction").alias("cluster"))


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id = 0)
SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, q WHERE e.vec_id <> 0 ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id LIMIT 10""")
def cosine_topk(embeddings):
    # one query vector, read as a row and used as a literal
    probe = embeddings.where("vec_id = 0").select(F.col("embedding").cast("array<double>")).first()
    q, v = F.array(*[F.lit(x) for x in (probe[0] if probe else [])]), F.col("embedding").cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    score = F.round(dot(v, q) / F.sqrt(dot(v, v) * dot(q, q)), 6)
    return embeddings.where("vec_id <> 0").select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 7 <> 3), q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.v, e.v) AS score FROM q, e WHERE q.vec_id <> e.vec_id)
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5""")
def vector_collection(embeddings):
    """A collection that is built from some vectors, then gets others, changes some and loses some; all lists are looked into, so the neighbours are exact."""
    from inkquarry.sources.vectors import Vectors
    from inkquarry.staging import shared_folder

    spark, v = embeddings.sparkSession, embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    held = Vectors(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex[:12]}")
    held.build(v.where("id % 3 = 0"), lists=16)
    held.upsert(v.where("id % 2 = 0").withColumn("vector", F.reverse("vector")))
    held.upsert(v.where("id % 3 <> 0 or id % 2 = 0"))
    held.remove(v.where("id % 7 = 3").select("id"))
    return held.search(v.where("id % 50 = 0"), 5, probes=16).select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query()
def colour_series(part):
    """Pixels of images of 10,000 each, clustered by colour image by image."""
    k = F.col("p_partkey").cast("int")
    pixels = part.select(F.expr("p_partkey div 10000").cast("string").alias("image_id"), (k % 97).alias("x"), (k % 89).alias("y"), (k * 7 % 256).alias("b"), (k * 13 % 256).alias("g"), (k * 29 % 256).alias("r"))
    return colour_clusters(pixels)


@query()
def synth_rows(part):
    """The points of a generated plot for each part."""
    return synthetic.points(synthetic.plots_of(part.select(F.col("p_partkey").alias("plot_id"))))
