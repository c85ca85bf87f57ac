"""Knowledge rows, segments, planned shots and the entity store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from storyloom import schema
from storyloom.operators import knowledge as k
from storyloom.operators import store as s


def panel(pid, people=(), event=None, text=None, place=None, rank=1, conf=0.5, page=1, scene="s1"):
    visual = ([(n, "d " + n, "a " + n, None) for n in people], place, [], [], [], event, None, "0.4", conf)
    return (pid, page, rank, "i.jpg", [1, 1, 5, 5], (text, []) if text is not None else None, visual, None, None, scene)


def test_panel_errors(spark):
    good, bad = panel("p001_001"), ("x", 0, 0, "i", [1, 1, 0, 5], None, None, None, None, None)
    rows = spark.createDataFrame([good, bad], schema.PANEL).select("panel_id", k.panel_errors().alias("e")).collect()
    assert {r["panel_id"]: r["e"] for r in rows} == {"p001_001": [], "x": ["panel_id", "page", "reading_order", "bbox"]}


def test_coerce_visual(spark):
    answers = ['{"characters": [{"name": "A"}], "actions": "run", "objects": ["x", "y"], "confidence": "0.7"}', "{}", "not json", None]
    df = spark.createDataFrame([(a,) for a in answers], "a STRING").select(k.coerce_visual(F.col("a")).alias("v"))
    got = [r["v"] for r in df.collect()]
    assert got[0]["characters"][0]["name"] == "A" and got[0]["characters"][0]["emotion"] == "unknown"
    assert got[0]["actions"] == ["run"] and got[0]["objects"] == ["x", "y"] and got[0]["confidence"] == 0.7
    assert all(v["environment"] == "unknown" and v["actions"] == [] and v["confidence"] == 0.0 for v in got[1:])


def test_records_and_changes(spark):
    panels = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c")], "page INT, panel_id STRING")
    order = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "page INT, panel_id STRING, rank INT")
    none = spark.createDataFrame([], "page INT, panel_id STRING, text STRING")
    rows = k.build_records(panels, order, none, none.withColumnRenamed("text", "note")).collect()
    assert {r["panel_id"]: (r["previous_panel"], r["next_panel"]) for r in rows} == {"b": (None, "a"), "a": ("b", "c"), "c": ("a", None)}
    after = panels.withColumn("v", F.when(F.col("panel_id") == "a", 2).otherwise(1))
    assert [r["panel_id"] for r in k.changed(panels.withColumn("v", F.lit(1)), after).collect()] == ["a"]


def test_characters_and_profiles(spark):
    df = spark.createDataFrame([panel("p001_001", ["A", "unknown"]), panel("p001_002", ["A"], page=2)], schema.PANEL)
    assert {r["name"]: r["appearance_count"] for r in k.page_characters(df).where("page = 1").collect()} == {"A": 1, "Unknown_p001_001": 1}
    a = k.profiles(df).where("name = 'A'").first()
    assert (a["first_seen_page"], a["appearances"], a["descriptions"], a["roles"]) == (1, 2, ["d A"], ["a A"])


def test_scene_facts(spark):
    df = spark.createDataFrame([("s", 1, 2, "b", ["X"], "inn", None, None), ("s", 1, 1, "a", ["Y", "X"], None, "duel", 0.5)], "scene STRING, page INT, rank INT, panel_id STRING, characters ARRAY<STRING>, location STRING, event STRING, confidence DOUBLE")
    r = k.finalize_scenes(df, ["scene"]).first()
    assert (r["panel_ids"], r["characters"], r["confidence"], r["summary"]) == (["a", "b"], ["X", "Y"], 0.5, "Characters: X, Y. Locations: inn. Events: duel")


def test_segments(spark):
    schema_ = "scene_id STRING, position INT, text STRING, panel_ids ARRAY<STRING>, estimated_seconds STRING, visual_intent STRING, camera STRING, importance STRING, type STRING, speaker STRING"
    data = [("s", 1, '"Night."', ["a", "a"], "2.25", None, None, "7", None, None), ("s", 2, "x", ["z"], "0", "odd", "static", "bad", "dialogue", None), ("s", 3, "Hi", ["a"], "1", "full_panel", "pan_up", None, "dialogue", None)]
    good, bad = k.segments(spark.createDataFrame(data, schema_), spark.createDataFrame([("s", ["a"])], "scene_id STRING, ids ARRAY<STRING>"))
    got = {r["segment_id"]: r for r in good.collect()}
    assert got["seg_001"]["text"] == "Night." and got["seg_001"]["panel_ids"] == ["a"] and got["seg_001"]["importance"] == 1.0 and got["seg_001"]["estimated_seconds"] == 2.2
    assert got["seg_002"]["speaker"] == "unknown"
    assert bad.first()["errors"] == ["panel_ids", "seconds", "visual_intent", "importance"]


def test_plan(spark):
    panels = spark.createDataFrame([panel("p001_001", ["Griffith"], "battle", "the battle"), panel("p001_002", ["Casca"])], schema.PANEL)
    segs = spark.createDataFrame([(1, "s1", "g1", "anything", ["p001_002"], 3.0), (1, "s1", "g2", "Griffith at the battle", [], 3.0), (1, "s1", "g3", "nothing here", [], 3.0)], "page INT, scene_id STRING, segment_id STRING, text STRING, panel_ids ARRAY<STRING>, estimated_seconds DOUBLE")
    got = {r["segment_id"]: r for r in k.plan_shots(segs, panels).collect()}
    assert got["g1"]["match_score"] >= 0.9 and not got["g1"]["needs_review"]
    assert got["g2"]["primary_panel"] == "p001_001" and not got["g2"]["needs_review"]
    assert got["g3"]["needs_review"] and got["g3"]["match_score"] < 0.55


@pytest.mark.parametrize("regions, strategy", [([], "16_9"), ([((10, 10, 100, 50), 0.9)], "16_9"), ([((0, 0, 50, 480), 0.9)], "safe_wider"), ([((10, 10, 9, 9), 0.1)], "16_9")])
def test_crop(spark, regions, strategy):
    df = spark.createDataFrame([(regions,)], "r ARRAY<STRUCT<box: STRUCT<x: INT, y: INT, w: INT, h: INT>, weight: DOUBLE>>")
    c = df.select(k.crop_of(F.lit(640), F.lit(480), F.col("r")).alias("c")).first()["c"]
    assert c["strategy"] == strategy and 0 <= c["box"]["x"] and c["box"]["x"] + c["box"]["w"] <= 640.001 and c["box"]["y"] + c["box"]["h"] <= 480.001


def test_store(spark, tmp_path):
    st = s.Store(spark, str(tmp_path))
    row = lambda w, t, d: spark.createDataFrame([(w, t, d, "pdf")], schema.STORE["terminology"][0])
    st.upsert("terminology", row("w1", "a", "one"))
    st.upsert("terminology", row("w2", "b", "two"))
    st.upsert("terminology", row("w1", "a", "three").unionByName(row("w1", "c", None)))
    assert {(r["work_id"], r["term"]): r["definition"] for r in st.table("terminology").collect()} == {("w1", "a"): "three", ("w1", "c"): None, ("w2", "b"): "two"}
    st.delete("terminology", "w1", F.col("term") == "a")
    assert [r["term"] for r in st.rows("terminology", "w1", order=[F.col("term")]).collect()] == ["c"]
    st.log("timeline", spark.createDataFrame([("w1", "e1", 3, "l", "d")], schema.STORE["timeline"][0]))
    assert {r["table_name"]: r["n_rows"] for r in st.stats().collect() if r["n_rows"]} == {"terminology": 2, "timeline": 1}


def test_character_folds(spark):
    log = spark.createDataFrame([("w", 1, "Guts", None, "big", ["Blk"], 1, 0.4), ("w", 2, "guts", "hero", "unknown", ["Blk", "Swd"], 50, 0.9), ("w", 3, "Unknown", None, None, [], 9, 0.1)], "work_id STRING, seq INT, name STRING, role STRING, description STRING, aliases ARRAY<STRING>, page INT, confidence DOUBLE")
    cast = s.fold_characters(log)
    r = cast.first()
    assert cast.count() == 1 and (r["name"], r["role"], r["description"], r["first_page"], r["last_page"], r["appearance_count"], r["confidence"], r["aliases"]) == ("guts", "hero", "big", 1, 50, 2, 0.9, ["Blk", "Swd"])
    assert {x["alias"] for x in s.aliases_of(cast, log).collect()} == {"Blk", "Swd", "Guts", "guts"}


def test_cache_corrections_and_scope(spark):
    now = dt.datetime(2024, 1, 1, 12)
    cache = spark.createDataFrame([("w", "q", "u", "old", now - dt.timedelta(hours=5)), ("w", "q", "u", "new", now - dt.timedelta(hours=1))], schema.STORE["research_cache"][0])
    asked = spark.createDataFrame([("w", "q"), ("w", "r")], "work_id STRING, query STRING")
    assert {r["query"]: r["result"] for r in s.fresh(cache, asked, F.lit(now), 7200).collect()} == {"q": "new", "r": None}
    records = spark.createDataFrame([("k", "v", "auto", 0.5), ("l", "v", "auto", 0.5)], "key STRING, value STRING, state STRING, confidence DOUBLE")
    fixes = spark.createDataFrame([("k", "x", 1), ("k", "y", 2)], "key STRING, value STRING, seq INT")
    assert {r["key"]: (r["value"], r["state"]) for r in s.correct(records, fixes).collect()} == {"k": ("y", "user_corrected"), "l": ("v", "auto")}
    cast = spark.range(1, 41).withColumnRenamed("id", "position")
    assert [s.scope_cast(cast, v).count() for v in (0, 1, 2, 3, 20)] == [40, 9, 13, 17, 40]
