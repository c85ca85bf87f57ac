"""Event-time streams: windows, sessions, and state folded a key at a time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.states import EVENT, RECORD, Record, step, with_event


def read_events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of Parquet files; their ts has no zone and is taken as the session's (UTC), as watermarks need."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windows(events: DataFrame, keys: list[str], late: str = "1 hour", length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of value by key and tumbling (or sliding) window; rows later than `late` are left out."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*keys, F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "n", "total")


def sessions(events: DataFrame, keys: list[str], gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a key: events at most gap apart."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("most")).select(*keys, F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "n", "most")


def joined_within(left: DataFrame, right: DataFrame, keys: list[str], late: str, within: str) -> DataFrame:
    """Stream-stream inner join of events of the same keys, right at most `within` after left; both watermarks bound
    the state. Columns of right are prefixed r_."""
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).withWatermark("r_ts", late)
    on: Column = (F.col("r_ts") >= F.col("ts")) & (F.col("r_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    return left.withWatermark("ts", late).join(r, on)


class MemoryMerger(StatefulProcessor):
    """Keeps the record of each key through the events of operators/states. A batch's events of a key are taken in order
    of seq (ties as in fold_states), and the record after them is given out; state deleted where there is none. With
    idle, a key of which event time has seen nothing for so long is dropped, and given out as expired."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", RECORD)

    def _now(self) -> Record | None:
        if not self.memory.exists():
            return None
        *plain, conflicting = self.memory.get()
        return Record(*plain, tuple(conflicting or ()))

    def _put(self, now: Record | None) -> None:
        if now is None:
            self.memory.clear()
        else:
            self.memory.update((*now[:5], list(now.conflicting)))

    def _row(self, key, now: Record | None, gone: str = "deleted") -> pd.DataFrame:
        value, state, confidence, seen, page, conflicting = now or Record(None, gone, None, 0, None)
        whole = pd.array([page], "Int32")
        return pd.DataFrame({"key": [key[0]], "value": [value], "state": [state], "confidence": [confidence], "seen_count": [seen], "page": whole, "conflicting": [list(conflicting)]})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples(index=False):
            self._put(Record(_plain(row.value), _plain(row.state), _plain(row.confidence), int(row.seen_count), _whole(row.page), tuple(row.conflicting if row.conflicting is not None else ())))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        events = [(seq, _plain(e), _plain(v), _plain(s), _plain(c), _whole(p)) for seq, e, v, s, c, p in zip(*(frame[c] for c in ("seq", *EVENT)))]
        events.sort(key=lambda r: [(x is not None, x if x is not None else 0) for x in r])
        now = self._now()
        for _, *event in events:
            now = step(now, *event)
        self._put(now)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(frame["ts"].max().timestamp() * 1000) + self.idle_ms)
        yield self._row(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.memory.clear()
        yield self._row(key, None, "expired")

    def close(self) -> None:
        pass


def _plain(value):
    return None if value is None or value is pd.NA or (isinstance(value, float) and value != value) else value


def _whole(value) -> int | None:
    return None if _plain(value) is None else int(value)


def merge_memory(rows: DataFrame, idle: dt.timedelta | None = None, snapshot: DataFrame | None = None) -> DataFrame:
    """rows: key, seq, value, page, and perhaps event, state and confidence. The record of each key that a batch touches,
    after it. snapshot: records (key and the columns of states.RECORD, as fold_states gives them) that the stream goes
    on from. idle: keys without an event for so long, by the watermark of a column ts that rows must then have,
    are dropped, so the state is bounded by the live keys. Needs the RocksDB state store."""
    full = with_event(rows)
    for name, kind in (("state", "string"), ("confidence", "double")):
        full = full if name in full.columns else full.withColumn(name, F.lit(None).cast(kind))
    kind = rows.schema["key"].dataType.simpleString()
    idle_ms = None if idle is None else int(idle.total_seconds() * 1000)
    first = None if snapshot is None else snapshot.select("key", *(f.split()[0] for f in RECORD.split(", "))).groupBy("key")
    columns = ["key", "seq", *EVENT, *(["ts"] if idle else [])]
    return full.select(*columns).groupBy("key").transformWithStateInPandas(MemoryMerger(idle_ms), f"key {kind}, {RECORD}", outputMode="Update", timeMode="EventTime" if idle else "None", initialState=first)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what there is and stops; a restart from the checkpoint goes on where this left off."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
