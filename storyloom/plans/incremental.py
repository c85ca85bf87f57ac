"""Queries on incremental runs: orders as pages to match, in batches that overlap."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..streaming import incremental as inc
from ..tables import new_path
from .registry import query, table


def _match(items):
    """The work on an order: it fails where a pending order is cheap."""
    bad = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 100000)
    return items.select("o_orderkey", F.round(F.col("o_totalprice") / 2, 2).alias("half"), F.when(bad, F.concat(F.lit("cheap "), F.col("o_orderpriority"))).alias("error"))


def _ran(spark, sf_dir):
    """Two thirds of the orders arrive first, then all of them; the second arrival is replayed once."""
    path = new_path(spark, "incremental")
    orders = table(spark, sf_dir, "orders")
    run = inc.Incremental(spark, f"{path}/out", ("o_orderkey",), "o_orderkey BIGINT", "half DOUBLE", _match)
    for part in (orders.where("o_orderkey % 3 <> 0"), orders):
        part.write.mode("append").parquet(f"{path}/in")
        run.run(spark.readStream.schema(orders.schema).parquet(f"{path}/in"), f"{path}/checkpoint")
    run.process(orders, 1)
    return run


_BATCHES_SQL = """WITH o AS (SELECT *, o_orderkey % 3 <> 0 AS early, o_orderstatus = 'P' AND o_totalprice < 100000 AS bad FROM orders)"""


@query(_BATCHES_SQL + """ SELECT CAST(0 AS BIGINT) AS batch, count(*) FILTER (WHERE early AND NOT bad) AS done, CAST(0 AS BIGINT) AS skipped, count(*) FILTER (WHERE early AND bad) AS failed FROM o
UNION ALL SELECT 1, count(*) FILTER (WHERE NOT early AND NOT bad), count(*) FILTER (WHERE early AND NOT bad), count(*) FILTER (WHERE bad) FROM o""")
def incremental_tallies(spark, sf_dir):
    return _ran(spark, sf_dir).tallies()


@query(_BATCHES_SQL + " SELECT o_orderkey, 'cheap ' || o_orderpriority AS error, CASE WHEN early THEN 2 ELSE 1 END::BIGINT AS attempts FROM o WHERE bad")
def dead_letters(spark, sf_dir):
    return _ran(spark, sf_dir).dead_letters()


@query("""WITH l AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM l)))""")
def redo_items(spark, sf_dir):
    """Orders are marked done (F) or skipped (P); a done one counts only if it has a returned line, its output."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "skipped").otherwise("running")
    outputs = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return inc.still_to_do(orders, orders.select("o_orderkey", status.alias("status")), outputs, ["o_orderkey"])


@query("""WITH s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place, l_partkey FROM lineitem), k AS (SELECT DISTINCT l_orderkey FROM s), p AS (SELECT * FROM s WHERE place = 3)
SELECT k.l_orderkey, p.place, p.l_partkey, CASE WHEN p.place IS NULL THEN 'segment 3 is out of range' END AS error FROM k LEFT JOIN p ON p.l_orderkey = k.l_orderkey""")
def picked_segments(spark, sf_dir):
    w = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    segments = table(spark, sf_dir, "lineitem").select("l_orderkey", w.cast("long").alias("place"), "l_partkey")
    return inc.picked(segments, ["l_orderkey"], "place", 3)
