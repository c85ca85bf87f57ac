"""Sources, sinks and streams on small files."""

import json

import numpy as np
from pyspark.sql import functions as F

from storyloom import schema
from storyloom.sources import readers, sinks
from storyloom.streaming import events


def test_artifacts_and_order(spark, tmp_path):
    box = [1, 2, 3, 4]
    (tmp_path / "p1.json").write_text(json.dumps({"page": 1, "source": "x", "panels": [{"id": "p001_001", "bbox": box, "area": 12, "confidence": 0.9}, {"id": "p001_002", "bbox": box, "area": 12, "confidence": 0.8, "reading_order": 9}]}))
    (tmp_path / "p2.json").write_text("{broken")
    good, bad = readers.artifacts(spark, str(tmp_path), schema.MANIFEST)
    assert good.count() == 1 and bad.count() == 1
    order = spark.createDataFrame([(1, "rtl", ["p001_001"], [])], schema.READING_ORDER)
    assert {r["panel_id"]: r["rank"] for r in readers.ordered_panels(good, order).collect()} == {"p001_001": 1, "p001_002": 9}
    assert [r["number"] for r in readers.listing(spark, str(tmp_path), r"p(\d+)\.json$").orderBy("number").collect()] == [1, 2]


def test_word_lines(spark):
    data = [(1, 1, 1, 1, 2, "b", 20, 0, 10, 10, 80.0, 5), (1, 1, 1, 1, 1, "a", 0, 0, 10, 12, 90.0, 5), (1, 1, 1, 1, 3, "c", 0, 0, 1, 1, -1.0, 5)]
    df = spark.createDataFrame(data, "page INT, block INT, par INT, line INT, word INT, text STRING, left INT, top INT, width INT, height INT, conf DOUBLE, level INT")
    r = readers.word_lines(df, ["page"]).first()
    assert r["text"] == "a b" and r["confidence"] == 0.85 and tuple(r["box"]) == (0, 0, 30, 12)


def test_sound(spark, tmp_path):
    tone = (0.5 * np.sin(np.arange(8000) / 10)).astype(np.float32)
    for name, content in (("tone", readers.wav(8000, tone)), ("quiet", readers.wav(8000, tone * 0)), ("bad", b"x")):
        (tmp_path / f"{name}.wav").write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: r for r in readers.sound_facts(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got["tone.wav"]["seconds"] == 1.0 and not got["tone.wav"]["silent"] and got["quiet.wav"]["silent"] and got["bad.wav"]["error"]


def test_first_source(spark):
    a, b = spark.createDataFrame([(1, "a")], "k INT, v STRING"), spark.createDataFrame([(1, "b"), (2, "b")], "k INT, v STRING")
    assert sorted(tuple(r) for r in readers.first_source([a, b], ["k"]).collect()) == [(1, "a"), (2, "b")]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_snapshot(spark.createDataFrame([(1, "a"), (2, "a")], "page INT, v STRING"), path, ["page"])
    sinks.write_snapshot(spark.createDataFrame([(2, "b")], "page INT, v STRING"), path, ["page"])
    sinks.append(spark.createDataFrame([(3, "c")], "page INT, v STRING"), path, ["page"])
    assert {r["page"]: r["v"] for r in sinks.read_snapshot(spark, path, "page INT, v STRING", ["page"]).collect()} == {1: "a", 2: "b", 3: "c"}


def test_narration_text(spark):
    df = spark.createDataFrame([(1, 2, "dialogue", "Guts", "No."), (1, 1, "narration", None, "Night.")], "scene INT, position INT, type STRING, speaker STRING, text STRING")
    assert sinks.narration_text(df, ["scene"]).first()["script"] == "Narrator: Night.\nDialogue (Guts): No."


def test_stateful_merge_equals_fold(spark, tmp_path):
    rows = [(1, 1, "x", 1), (1, 2, "y", 2), (1, 3, "z", 3), (2, 1, "x", 1), (2, 2, "x", 5)]
    spark.createDataFrame(rows, "key LONG, seq INT, value STRING, page INT").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key LONG, seq INT, value STRING, page INT").parquet(str(tmp_path / "in"))
    q = events.merge_memory(stream).writeStream.outputMode("update").format("memory").queryName("merged").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["key"]: (r["value"], r["state"], r["seen_count"]) for r in spark.table("merged").collect()} == {1: ("z", "auto", 3), 2: ("x", "auto", 2)}


def test_stream_join_and_append(spark, tmp_path):
    data = [(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:05:00", "b"), (1, "2024-01-02 00:00:00", "b")]
    df = spark.createDataFrame(data, "user_id LONG, ts STRING, event_type STRING").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    read = lambda: events.read_events(spark, str(tmp_path / "e"), df.schema.simpleString()[7:-1].replace(":", " "))
    left, right = read().where("event_type = 'a'"), read().where("event_type = 'b'")
    events.run_available(events.joined_within(left, right, ["user_id"], "1 hour", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
