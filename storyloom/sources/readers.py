"""Sources: JSON artifacts, page listings, word tables, sound files; corrupt input becomes rows that say so."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import union_box


def artifacts(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON documents, one a file, under a fixed schema: the good rows, and the corrupt files with their text."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_file"))
    doc = F.from_json("value", f"{schema}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = raw.withColumn("_doc", doc)
    good = parsed.where(F.col("_doc._corrupt").isNull()).select("_doc.*").drop("_corrupt")
    return good, parsed.where(F.col("_doc._corrupt").isNotNull()).select("_file", F.col("_doc._corrupt").alias("_corrupt"))


def listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Files whose name has a number at group 1 of pattern: number, path, size; nothing is read of their content."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), "modificationTime")
    return files.withColumn("number", F.regexp_extract("path", pattern, 1).try_cast("int")).where("number is not null").select("number", "path", "size", "modificationTime")


def panels_of(manifest: DataFrame) -> DataFrame:
    """A row a panel of manifests, in their order."""
    rows = manifest.select("page", F.posexplode("panels").alias("pos", "p"))
    return rows.select("page", "pos", F.col("p.id").alias("panel_id"), F.col("p.image").alias("image"), F.col("p.bbox").alias("bbox"), F.col("p.confidence").alias("confidence"), F.col("p.reading_order").alias("own_order"))


def ordered_panels(manifest: DataFrame, order: DataFrame) -> DataFrame:
    """Panels with their rank: the order file's, else the panel's own, else the manifest's."""
    ranks = order.select("page", F.posexplode("order").alias("at", "panel_id")).select("page", "panel_id", (F.col("at") + 1).alias("rank"))
    return panels_of(manifest).join(ranks, ["page", "panel_id"], "left").withColumn("rank", F.coalesce("rank", "own_order", F.col("pos") + 1))


def first_source(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several sources of one schema; of each key, those of the first source that has it."""
    both = sources[0].withColumn("__s", F.lit(0))
    for i, df in enumerate(sources[1:], 1):
        both = both.unionByName(df.withColumn("__s", F.lit(i)))
    w = Window.partitionBy(*keys)
    return both.withColumn("__m", F.min("__s").over(w)).where("__s = __m").drop("__s", "__m")


def word_lines(words: DataFrame, page: list[str]) -> DataFrame:
    """Recogniser output (block, par, line, word, text, left, top, width, height, conf, level) as lines: words of level 5
    with a confidence, joined in order; the box around them; mean confidence in 0 to 1."""
    good = words.where((F.col("level") == 5) & (F.col("conf") >= 0) & (F.trim("text") != ""))
    item = F.struct(F.col("word").alias("word"), F.col("text").alias("text"), F.struct(F.col("left").alias("x"), F.col("top").alias("y"), F.col("width").alias("w"), F.col("height").alias("h")).alias("box"))
    lines = good.groupBy(*page, "block", "par", "line").agg(F.array_sort(F.collect_list(item)).alias("w"), F.round(F.avg(F.col("conf")) / 100, 3).alias("confidence"))
    return lines.select(*page, "block", "par", "line", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"), union_box(F.transform("w", lambda x: x["box"])).alias("box"), "confidence")


def samples(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples in -1 to 1 of a WAV file of 8 or 16 bits."""
    with wave.open(io.BytesIO(content)) as f:
        rate, channels, width = f.getframerate(), f.getnchannels(), f.getsampwidth()
        raw = f.readframes(f.getnframes())
    data = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128 if width == 1 else np.frombuffer(raw, "<i2").astype(np.float32) / 32768
    return rate, data.reshape(-1, channels).mean(1) if channels > 1 else data


def sound_facts(files: DataFrame, silent_below: float = 0.005) -> DataFrame:
    """files (path, content): path, rate, seconds, peak, rms, silent, error; a file that cannot be read has an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    rate, x = samples(content)
                    rms = float(np.sqrt((x[: 5 * rate] ** 2).mean())) if len(x) else 0.0
                    rows.append((path, rate, len(x) / rate, float(np.abs(x).max()) if len(x) else 0.0, rms, rms < silent_below, None))
                except (wave.Error, EOFError, ValueError) as e:
                    rows.append((path, None, None, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "rate", "seconds", "peak", "rms", "silent", "error"]).astype({"rate": "Int32", "silent": "boolean"})

    return files.select("path", "content").mapInPandas(run, "path string, rate int, seconds double, peak double, rms double, silent boolean, error string")


def wav(rate: int, data: np.ndarray, most: float = 0.98) -> bytes:
    """Samples as a 16-bit mono WAV file, clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(data, -most, most) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def wav_files(sounds: DataFrame, rate: Column) -> DataFrame:
    """sounds (path, samples: doubles) as path and content: 16-bit WAV files, a row each; a sound is one file, so it is made whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "content": [wav(int(r), np.asarray(x, dtype=np.float64)) for r, x in zip(frame["rate"], frame["samples"])]})

    return sounds.select("path", rate.alias("rate"), "samples").mapInPandas(run, "path string, content binary")


def one_of(*columns: Column) -> Column:
    """The first known value: a cascade of sources in order of trust."""
    return F.coalesce(*columns)
