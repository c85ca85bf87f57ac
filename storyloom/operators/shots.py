"""Shots and sound: splitting, reuse, levels, cameras over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def split_long(rows: DataFrame, duration: str, longest: float = 9.0, first: float = 3.0, most: int = 3) -> DataFrame:
    """Rows longer than longest become an opening of max(first, half) and up to most - 1 equal close-ups; the others
    stay one piece. Adds piece (from 0), n_pieces and piece_seconds."""
    d = F.col(duration)
    long = d > longest
    opening = F.greatest(F.lit(first), d / 2)
    n = F.when(long, most).otherwise(1)
    out = rows.withColumn("n_pieces", n).withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    return out.withColumn("piece_seconds", F.when(~long, d).when(F.col("piece") == 0, opening).otherwise((d - opening) / (F.col("n_pieces") - 1)))


def reuse(rows: DataFrame, primary: str, order: list[str]) -> DataFrame:
    """Adds reuse_count: how often the primary has been used up to and with this row."""
    return rows.withColumn("reuse_count", F.row_number().over(Window.partitionBy(primary).orderBy(*order)))


def peak(value: Column, default: float = 0.9) -> Column:
    """Aggregate: the greatest magnitude of a group, or a default where there is none."""
    return F.coalesce(F.max(F.abs(value)), F.lit(default))


def level(rows: DataFrame, value: str, target: float = 0.9, most: float = 1.009) -> DataFrame:
    """Two passes: the greatest magnitude of all rows sets one gain, at most `most`, applied to each. The maximum is one
    row, joined as such."""
    peak = rows.agg(F.max(F.abs(value)).alias("__peak"))
    gain = F.coalesce(F.least(F.try_divide(F.lit(target), F.col("__peak")), F.lit(most)), F.lit(most))
    return rows.crossJoin(F.broadcast(peak)).withColumn("gain", gain).withColumn("levelled", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(value) * F.col("gain")))).drop("__peak")


def mix_sections(parts: DataFrame, keys: list[str], seconds: str, volume: str) -> DataFrame:
    """Per section: how many parts sound, for how long together, and their loudness weighted by time."""
    return parts.groupBy(*keys, "section").agg(F.count("*").alias("n_parts"), F.sum(seconds).alias("seconds"), (F.sum(F.col(volume) * F.col(seconds)) / F.sum(seconds)).alias("loudness"))


def score_parts(characters: Column, actions: Column, event: Column, objects: Column, coverage: Column, story: Column, weights: dict[str, float]) -> Column:
    """Weighted mean of six signals, each 0 to 1, clamped."""
    signals = {"character": characters, "action": actions, "event": event, "object": objects, "ocr": coverage, "story": story}
    total = sum(weights[k] for k in signals)
    out = sum((F.coalesce(v.cast("double"), F.lit(0.0)) * weights[k] for k, v in signals.items()), F.lit(0.0)) / total
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))
