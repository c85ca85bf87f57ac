"""Sinks: snapshots replaced whole or by key, logs, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Versions


def write_snapshot(table: DataFrame, path: str, by: list[str] = ()) -> None:
    """Replaces a table; with `by`, only the rows of the keys that it holds. The write is a version of its own that a
    pointer names at the end, so a failed job leaves the old rows."""
    Versions(table.sparkSession, path, _ddl(table), tuple(by)).replace(table)


def read_snapshot(spark: SparkSession, path: str, ddl: str, by: list[str] = ()) -> DataFrame:
    """The table as of now; empty before its first write."""
    return Versions(spark, path, ddl, tuple(by)).read()


def _ddl(table: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)


def append(rows: DataFrame, path: str, by: list[str] = ()) -> None:
    """Adds rows to a snapshot or log."""
    Versions(rows.sparkSession, path, _ddl(rows), tuple(by)).add(rows)


def narration_text(segments: DataFrame, keys: list[str]) -> DataFrame:
    """segments (keys, position, type, speaker, text) as one labelled text a key."""
    label = F.when(F.col("type") == "dialogue", F.concat(F.lit("Dialogue"), F.coalesce(F.concat(F.lit(" ("), "speaker", F.lit(")")), F.lit("")))).otherwise(F.lit("Narrator"))
    line = F.concat(label, F.lit(": "), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return segments.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("script"))


def shot_report(shots: DataFrame, keys: list[str]) -> DataFrame:
    """shots (keys, place, text, seconds) as one text a scene, a line a shot in order of place, with their number and
    length."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "text")))
    return shots.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("report"), F.count("*").alias("n_shots"), F.sum("seconds").alias("seconds"))
