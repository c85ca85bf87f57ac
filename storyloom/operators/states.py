"""The states of a memory record: one step, for batches and streams alike."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A record as it stands; conflicting holds the values that it has been in conflict about, the latest first.
RECORD = "value string, state string, confidence double, seen_count int, page int, conflicting array<string>"
#: What happens to a record. event: observe (null too), correct or delete; seq orders a key's events.
EVENT = ("event", "value", "state", "confidence", "page")


class Record(NamedTuple):
    value: str | None
    state: str
    confidence: float | None
    seen_count: int
    page: int | None
    conflicting: tuple[str | None, ...] = ()


def step(now: Record | None, event: str | None, value: str | None, state: str | None, confidence: float | None, page: int | None) -> Record | None:
    """The record after an event.

    A deletion leaves none. A correction is the user's: certain, whatever was there, and later observations only count;
    the latest correction holds. Of observations, the first makes the record. An equal value, or any for a verified
    record, only counts. Where either side is uncertain the two conflict, and a clearly surer value (by .15) takes over.
    A record in conflict takes the next differing value and is settled; any other one comes into conflict with it.
    Every event counts, and its page, if it has one, is the record's. Nulls are equal to nulls only."""
    if event == "delete":
        return None
    if event == "correct":
        # A correction is no sighting on a page, so it leaves the page.
        return Record(value, "user_corrected", 1.0, now.seen_count + 1, now.page, now.conflicting) if now else Record(value, "user_corrected", 1.0, 1, None)
    if now is None:
        return Record(value, state or "auto", confidence, 1, page)
    now = now._replace(seen_count=now.seen_count + 1, page=now.page if page is None else page)
    if now.value == value or now.state in ("verified", "user_corrected"):
        return now
    if "uncertain" in (now.state, state):
        surer = None not in (confidence, now.confidence) and confidence > now.confidence + 0.15
        return now._replace(value=value if surer else now.value, state="conflicted")
    if now.state == "conflicted":
        return now._replace(value=value, state="auto")
    return now._replace(state="conflicted", conflicting=tuple(dict.fromkeys((now.value, value, *now.conflicting))))


def with_event(log: DataFrame) -> DataFrame:
    """log with an event column: observations, where it has none."""
    return log if "event" in log.columns else log.withColumn("event", F.lit("observe"))


def fold_states(log: DataFrame, key: str, seq: str) -> DataFrame:
    """log: key, seq, value, state, confidence, page and perhaps event; other columns are ignored. The record of each key
    after all its events in order of seq (ties by the other columns, nulls first); deleted ones are not there. Keys of
    any number of rows stream through their task, which holds one batch and one record. Null keys are one key; an
    empty log gives no rows."""
    kind = log.schema[key].dataType.simpleString()

    def run(batches):
        at, now, some, types = None, None, False, None

        def table(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=[key, *(f.split()[0] for f in RECORD.split(", "))])

        for batch in batches:
            types, done = [batch.schema.field(0).type, pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.string())], []
            for k, *event in zip(*(c.to_pylist() for c in batch.columns)):
                if not some or k != at:
                    if now is not None:
                        done.append((at, *now))
                    at, now, some = k, None, True
                now = step(now, *event)
            if done:
                yield table(done)
        if now is not None:
            yield table([(at, *now)])

    rows = with_event(log).repartition(key).sortWithinPartitions(key, seq, *EVENT)
    return rows.select(key, "event", "value", "state", F.col("confidence").cast("double"), F.col("page").cast("int")).mapInArrow(run, f"`{key}` {kind}, {RECORD}")
