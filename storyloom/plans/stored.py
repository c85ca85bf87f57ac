"""Queries that write tables of the store, change them, and read them back."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ..operators import entities as e
from ..operators import knowledge as k
from ..operators.jobs import FIELDS, Pipeline, fingerprint
from ..operators.store import Store
from ..sources import sinks
from ..sources.versions import Versions
from ..tables import new_path
from .relational import match_panels
from .registry import query, table


def _terms(spark, sf_dir):
    """Events as definitions of terms: one in ten works names, some without a definition."""
    ev = table(spark, sf_dir, "events")
    definition = F.when(F.col("value") > 5, F.concat_ws(" ", "event_type", F.col("event_id").cast("string")))
    return ev.select(F.concat(F.lit("w"), F.col("user_id") % 10).alias("work_id"), F.concat(F.lit("t"), F.col("event_id") % 70).alias("term"), definition.alias("definition"), F.when(F.col("event_type") == "view", "pdf").alias("source"), "event_id")


@query("""WITH t AS (SELECT 'w' || user_id % 10 AS work_id, 't' || event_id % 70 AS term, CASE WHEN value > 5 THEN event_type || ' ' || event_id END AS definition, CASE WHEN event_type = 'view' THEN 'pdf' END AS source, event_id FROM events),
f AS (SELECT work_id, term, event_id % 2 AS part, arg_max(definition, event_id) FILTER (WHERE definition IS NOT NULL) AS definition, arg_max(source, event_id) FILTER (WHERE source IS NOT NULL) AS source FROM t GROUP BY ALL),
m AS (SELECT work_id, term, coalesce(max(definition) FILTER (WHERE part = 1), max(definition) FILTER (WHERE part = 0)) AS definition, coalesce(max(source) FILTER (WHERE part = 1), max(source) FILTER (WHERE part = 0)) AS source FROM f GROUP BY ALL)
SELECT * FROM m WHERE work_id NOT IN ('w3', 'w4') AND NOT (work_id IN ('w5', 'w6') AND source IS NULL)""")
def stored_terms(spark, sf_dir):
    """Even events, then odd ones put in by key; then all terms of two works deleted, and those without a source of two."""
    store, terms = Store(spark, new_path(spark, "stored-terms")), _terms(spark, sf_dir)
    for part in (0, 1):
        store.upsert("terminology", terms.where(F.col("event_id") % 2 == part), ["event_id"])
    store.delete("terminology", terms.where("work_id IN ('w3', 'w4')"), F.lit(True))
    store.delete("terminology", terms.where("work_id IN ('w5', 'w6')"), F.col("source").isNull())
    store.vacuum()
    return store.table("terminology")


@query("""WITH l AS (SELECT DISTINCT o_orderkey AS panel, l_suppkey AS segment FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'), z AS (SELECT segment, count(*) AS c FROM l GROUP BY 1), p AS (SELECT panel, count(*) AS n, max(c) AS most FROM l JOIN z USING (segment) GROUP BY 1),
m AS (SELECT o_orderkey AS panel, coalesce(n, 0) AS n_groups, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'one_to_many' WHEN most > 1 THEN 'many_to_one' ELSE 'one_to_one' END AS cardinality FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN p ON o_orderkey = panel)
SELECT panel % 97 AS page, CASE WHEN panel % 97 < 10 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN panel % 97 >= 10 THEN count(*) END AS n_panels, CASE WHEN panel % 97 >= 10 THEN count(*) FILTER (WHERE cardinality = 'unmatched') END AS n_unmatched FROM m GROUP BY page""")
def mapping_index(spark, sf_dir):
    """The mapping by page is saved, rolled up to an index row a page, and pages that fail replace theirs."""
    path = new_path(spark, "mapping-index")
    sinks.write_snapshot(match_panels(spark, sf_dir).withColumn("page", F.col("panel") % 97), f"{path}/pages", ["page"])
    saved = sinks.read_snapshot(spark, f"{path}/pages", "panel BIGINT, n_groups BIGINT, cardinality STRING, page BIGINT", ["page"])
    index = saved.groupBy("page").agg(F.lit("completed").alias("status"), F.count("*").alias("n_panels"), F.count_if(F.col("cardinality") == "unmatched").alias("n_unmatched"))
    ddl = "page BIGINT, status STRING, n_panels BIGINT, n_unmatched BIGINT"
    sinks.write_snapshot(index.select("page", "status", "n_panels", "n_unmatched"), f"{path}/index", ["page"])
    none = F.lit(None).cast("bigint")
    failed = saved.where("page < 10").select("page", F.lit("failed").alias("status"), none.alias("n_panels"), none.alias("n_unmatched")).distinct()
    sinks.write_snapshot(failed, f"{path}/index", ["page"])
    return sinks.read_snapshot(spark, f"{path}/index", ddl, ["page"])


@query("""WITH n AS (SELECT conv_id, turn, role, lag(turn) OVER w AS p, lead(turn) OVER w AS n, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, role, CASE WHEN conv_id % 2 = 0 THEN p END AS previous_panel, CASE WHEN conv_id % 2 = 0 THEN n END AS next_panel, CASE WHEN conv_id % 2 = 0 THEN 's' || CAST(s AS BIGINT) END AS scene_id FROM n""")
def scene_links(spark, sf_dir):
    """Records are saved without links; those of half of the pages are then written again with scene and neighbours."""
    path = new_path(spark, "scene-links")
    ddl = "conv_id BIGINT, turn BIGINT, role STRING, previous_panel BIGINT, next_panel BIGINT, scene_id STRING"
    at = Versions(spark, path, ddl, ("conv_id",))
    at.replace(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"))
    half = at.read().where("conv_id % 2 = 0").select("conv_id", "turn", "role")
    # Scenes begin at a user's turn; a page holds few records, so its order is one window.
    at.replace(k.scene_linked(half, ["conv_id"], "turn", F.col("role") == "user"))
    return at.read()


@query("""WITH t AS (SELECT user_id AS project, event_type AS name, event_id % 3 = 0 AS is_on, event_id FROM events WHERE event_id % 5 <> 0), a AS (SELECT project, name, arg_max(is_on, event_id) AS is_on FROM t GROUP BY ALL)
SELECT project, name, is_on FROM a WHERE project % 7 <> 0""")
def project_toggles(spark, sf_dir):
    """Projects with a map of toggles: each batch of switches is merged into the map by name; some projects are deleted."""
    at = Versions(spark, new_path(spark, "projects"), "project BIGINT, toggles MAP<STRING, BOOLEAN>", ("project",))
    switches = table(spark, sf_dir, "events").where("event_id % 5 <> 0").select(F.col("user_id").alias("project"), F.col("event_type").alias("name"), (F.col("event_id") % 3 == 0).alias("is_on"), "event_id")
    half = switches.agg(F.max("event_id")).first()[0] or 0
    for batch in (switches.where(F.col("event_id") <= half / 2), switches.where(F.col("event_id") > half / 2)):
        at.replace(e.merge_maps(at.read(), batch, "project", "toggles", "name", "is_on", "event_id"))
    at.replace(at.read().limit(0), touched=switches.where("project % 7 = 0").select("project").distinct())
    return at.read().select("project", F.explode("toggles").alias("name", "is_on"))


@query("""WITH s AS (SELECT *, '#' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || ' ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 's ' || l_returnflag || l_linestatus || ' panel ' || l_partkey AS x FROM lineitem) SELECT l_orderkey, string_agg(x, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, x) AS report, count(*) AS n_shots, CAST(sum(l_quantity) AS DOUBLE) AS seconds FROM s GROUP BY l_orderkey""")
def shot_reports(spark, sf_dir):
    """A review text a scene, its shots in order, saved and read back."""
    lines = table(spark, sf_dir, "lineitem")
    text = F.concat(F.lit("#"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit(" "), F.col("l_quantity").cast("bigint").cast("string"), F.lit("s "), "l_returnflag", "l_linestatus", F.lit(" panel "), F.col("l_partkey").cast("string"))
    shots = lines.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"), text.alias("text"), F.col("l_quantity").alias("seconds"))
    path = new_path(spark, "shot-reports")
    sinks.write_snapshot(sinks.shot_report(shots, ["l_orderkey"]), path)
    return sinks.read_snapshot(spark, path, "l_orderkey BIGINT, report STRING, n_shots BIGINT, seconds DOUBLE")


@query("""SELECT n_nationkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total, 'customers completed 1, nations completed 2, listing completed 1' AS stages, 'customers failed; nations listing; ' AS runs FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def staged_runs(spark, sf_dir):
    """Three stages over orders, of which the second fails at first: the next run goes on there, a third finds nothing to do.
    Each nation's totals from the last stage, with what the control table says and what the three runs did."""
    path, broken = new_path(spark, "staged-runs"), ["once"]
    saved = lambda name, ddl: sinks.read_snapshot(spark, f"{path}/{name}", ddl)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")

    def customers(spark):
        sums = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
        sinks.write_snapshot(sums, f"{path}/customers")

    def nations(spark):
        sums = saved("customers", "c_custkey BIGINT, n_orders BIGINT, total DOUBLE").join(table(spark, sf_dir, "customer"), "c_custkey")
        if broken:
            broken.pop()
            sums = sums.withColumn("total", F.raise_error(F.lit("the first attempt fails")).cast("double"))
        sinks.write_snapshot(sums.groupBy("c_nationkey").agg(F.sum("n_orders").alias("n_orders"), F.sum("total").alias("total")), f"{path}/nations")

    def listing(spark):
        totals = saved("nations", "c_nationkey INT, n_orders BIGINT, total DOUBLE").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        sinks.write_snapshot(totals.select("n_nationkey", "n_orders", F.round("total", 2).alias("total")), f"{path}/listing")

    run = Pipeline(spark, f"{path}/control", [("customers", customers), ("nations", nations), ("listing", listing)])
    of, runs = fingerprint(orders), []
    for _ in range(3):
        try:
            runs.append(" ".join(run.run(of)))
        except PySparkException:
            runs.append(" ".join([n for n, s in run.state.items() if s["status"] == "completed"] + ["failed"]))
    control = F.array_sort(F.collect_list(F.struct("position", F.concat_ws(" ", "stage", "status", F.col("attempts").cast("string")).alias("line"))))
    stages = sinks.read_snapshot(spark, f"{path}/control", FIELDS).agg(F.array_join(F.transform(control, lambda s: s["line"]), ", ").alias("stages"))
    # One row, so each nation meets it once.
    return saved("listing", "n_nationkey INT, n_orders BIGINT, total DOUBLE").crossJoin(stages).withColumn("runs", F.lit("; ".join(runs)))
