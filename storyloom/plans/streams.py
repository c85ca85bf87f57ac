"""Queries that run a stream over the events table to its end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import events as s
from .registry import query

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _finished(stream: DataFrame, name: str) -> DataFrame:
    """The complete result of a stream once all there is has been taken in, as a table in the shared folder. These
    queries stand for a whole table, so no row may be late: the mode is complete, and the state is the result. A stream
    without end writes in append mode (streaming/events.run_available), where the watermark frees the state."""
    spark = stream.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="storyloom-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out")
    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("""SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS hour_start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def stream_windows(spark, sf_dir):
    out = _finished(s.windows(s.read_events(spark, f"{sf_dir}/events*.parquet", EVENTS), ["event_type"]), "stream-windows")
    return out.select("event_type", F.col("start_at").cast("timestamp_ntz").alias("hour_start"), "n", F.round("total", 2).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 43200000000 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM g) SELECT user_id, min(ts) AS start_at, count(*) AS n, round(max(value), 4) AS most FROM n GROUP BY user_id, g""")
def stream_sessions(spark, sf_dir):
    out = _finished(s.sessions(s.read_events(spark, f"{sf_dir}/events*.parquet", EVENTS), ["user_id"]), "stream-sessions")
    return out.select("user_id", F.col("start_at").cast("timestamp_ntz").alias("start_at"), "n", F.round("most", 4).alias("most"))
