"""Ingest in batches, facts in a window, and views by literal cases."""

import pytest
from pyspark.sql import functions as F

from storyloom.functions.text import short_id
from storyloom.operators import ingest as g
from storyloom.operators import store as s
from storyloom.operators import views as v
from storyloom.schema import VISUAL


def panels(spark, *rows):
    """rows: (work, page, [(name, description)], place, [objects], event)."""
    data = [(w, p, ([(n, d, "", "") for n, d in people], place, [], objects, [], event, "", "", 0.5)) for w, p, people, place, objects, event in rows]
    return spark.createDataFrame(data, f"work_id STRING, page INT, visual {VISUAL}")


FIRST = ("w", 3, [("Guts", "big"), ("unknown", "x"), ("", "y")], "Hill", ["Sword", "N/A"], "fight")
SECOND = ("w", 1, [("GUTS", None), ("Casca", "fast")], "hill", [], " none ")


def test_learned(spark):
    got = {(r["kind"], r["key"], r["value"]) for r in g.learned(panels(spark, FIRST, SECOND)).collect()}
    assert got == {("character", "Guts", "big"), ("character", "GUTS", None), ("character", "Casca", "fast"), ("place", "Hill", "Hill"), ("place", "hill", "hill"), ("object", "Sword", "Sword"), ("event", "fight", "fight")}


def test_batches_add_up_and_replays_do_not(spark, tmp_path):
    st = s.Store(spark, str(tmp_path))
    g.ingest_pages(st, panels(spark, FIRST), 0)
    for _ in range(2):
        g.ingest_pages(st, panels(spark, SECOND), 1)
    people = {r["name"]: (r["description"], r["first_page"], r["last_page"], r["appearance_count"], r["confidence"]) for r in st.table("characters").collect()}
    assert people == {"Guts": ("big", 1, 3, 2, 0.5), "Casca": ("fast", 1, 1, 1, 0.5)}
    assert [(r["name"], r["first_page"], r["appearance_count"]) for r in st.table("locations").collect()] == [("Hill", 1, 2)]
    assert st.table("source_evidence").count() == 3 and st.table("events").count() == 1
    assert sorted(r["key_value"] for r in st.table("processing_checkpoints").collect()) == ["1", "3"]


def test_a_run_that_died_between_tables_is_run_again(spark, tmp_path, monkeypatch):
    st = s.Store(spark, str(tmp_path))
    whole = s.Store.log

    def dies(self, name, rows, mark=None):
        raise RuntimeError("lost")

    monkeypatch.setattr(s.Store, "log", dies)
    with pytest.raises(RuntimeError):
        g.ingest_pages(st, panels(spark, FIRST), 7)
    monkeypatch.setattr(s.Store, "log", whole)
    g.ingest_pages(st, panels(spark, FIRST), 7)
    assert st.table("characters").first()["appearance_count"] == 1 and st.table("source_evidence").count() == 1


def test_references_and_casts(spark, tmp_path):
    st = s.Store(spark, str(tmp_path))
    books = spark.createDataFrame([("w", "T", "A", ["x", "y"], "", None), ("v", " ", "B", None, "s", "z")], "work_id STRING, title STRING, author STRING, genres ARRAY<STRING>, status STRING, synopsis STRING")
    g.store_references(st, books)
    assert {(r["entity_key"], r["value"]) for r in st.table("source_evidence").collect()} == {("title", "T"), ("author", "A"), ("genres", "x, y")}
    g.store_cast(st, spark.createDataFrame([("w", " Guts ", "r" * 200, ""), ("w", "  ", "x", "y")], "work_id STRING, name STRING, role STRING, description STRING"))
    row = st.table("characters").first()
    assert (row["name"], len(row["role"]), row["description"], row["confidence"]) == ("Guts", 100, None, 0.7)


def test_people_whose_short_ids_are_one_stay_two(spark, tmp_path):
    st, names = s.Store(spark, str(tmp_path)), ["Customer#000411228", "Customer#000758870"]
    g.store_cast(st, spark.createDataFrame([("w0", n, f"role {n}", None) for n in names], "work_id STRING, name STRING, role STRING, description STRING"))
    people = st.table("characters").join(st.table("source_evidence").select("work_id", F.col("entity_key").alias("character_id"), "value"), ["work_id", "character_id"])
    assert {(r["i"], r["name"], r["value"]) for r in people.select(short_id(F.col("character_id")).alias("i"), "name", "value").collect()} == {("char_793e59cd", n, f"Name: {n}, Role: role {n}") for n in names}
    assert people.count() == 2


def test_facts_that_were_pushed_out_come_again(spark):
    log = [(1, i, 1 if f == "a" else None, f) for i, f in enumerate(["a", "b", "a", "c", "a", " ", "n/a", None, "d", "a"])] + [(2, 1, 0, "x"), (None, 1, None, "y")]
    got = {r["k"]: r["facts"] for r in g.remembered_facts(spark.createDataFrame(log, "k INT, seq INT, page INT, fact STRING"), "k", "seq", n=2).collect()}
    assert got == {1: ["page p.1: a", "d"], 2: ["x"], None: ["y"]}


def test_kinds(spark):
    df = spark.createDataFrame([("Places",), ("thread",), (" story ",), ("whatever",), (None,)], "k STRING")
    assert [r[0] for r in df.select(v.kind_of(F.col("k"))).collect()] == ["world", "story", "story", "character", "character"]
    records = spark.createDataFrame([("places", {"type": "place"}), ("world", {"type": "object"}), ("world", None), ("story", {"type": "thread"})], "kind STRING, value MAP<STRING, STRING>")
    assert v.typed(records, "world").count() == 3 and v.typed(records, "world", "object").count() == 1 and v.typed(records, "book").count() == 0


def test_transitions_by_type(spark):
    df = spark.createDataFrame([("s", i, d, k) for i, (d, k) in enumerate([(2.0, "dissolve"), (0.2, "fade"), (4.0, "zoom"), (1.0, "dissolve")])], "s STRING, i INT, d DOUBLE, k STRING")
    got = [(r["type"], r["length"], r["overlap"]) for r in v.typed_transitions(df, ["s"], ["i"], "d", "k").orderBy("i").collect()]
    assert got == [("dissolve", 0.1, 0.1), ("fade", 0.1, 0.0), ("cut", 0.0, 0.0), ("dissolve", 0.0, 0.0)]


def test_probe_stops_behind_its_characters(spark):
    pages = spark.createDataFrame([(1, p, "\n".join(f"{p}-{i}-" + "x" * 60 for i in range(50)) + "\nab\nsame line") for p in range(8)], "b INT, p INT, t STRING")
    got = [r["line"] for r in v.text_probe(pages, ["b"], "p", "t").orderBy("place").collect()]
    want, total = [], 0
    for p in range(6):
        for i in range(40):
            if total <= 2000:
                want.append(f"{p}-{i}-" + "x" * 60)
                total += len(want[-1])
    assert got == want


def test_tracks_audio_and_summaries(spark):
    files = spark.createDataFrame([(1, "b.mp3"), (1, "a.mp3"), (1, "z.wav"), (2, "n.txt")], "k INT, file STRING")
    asked = spark.createDataFrame([(1, None), (1, "a.mp3"), (1, "no.wav"), (2, None), (3, None)], "k INT, wanted STRING")
    assert {(r["k"], r["wanted"]): (r["track"], r["error"]) for r in v.music_track(files, asked, ["k"]).collect()} == {(1, None): ("z.wav", None), (1, "a.mp3"): ("a.mp3", None), (1, "no.wav"): (None, "not found"), (2, None): (None, "no music files"), (3, None): (None, "no music files")}
    entries = spark.createDataFrame([("w", 0, "/x/own.wav"), ("w", 1, "/x/gone.wav"), ("w", 2, None)], "work STRING, position INT, audio_path STRING")
    there = spark.createDataFrame([("w", "own.wav"), ("w", "segment_001.wav"), ("w", "segment_002.wav")], "work STRING, file STRING")
    assert {(r["position"], r["file"]) for r in v.segment_audio(entries, there).collect()} == {(0, "own.wav"), (1, "segment_002.wav")}
    chapters = spark.createDataFrame([("w", 1, 1, 5), ("w", 2, 6, 9)], "work STRING, chapter INT, start_page INT, end_page INT")
    ev = spark.createDataFrame([("w", 1, 1, "a", 0.9, ["G", "C"]), ("w", 1, 2, "b", 0.4, None), ("w", 1, 3, "c", 0.1, [])], "work STRING, chapter INT, seq INT, description STRING, importance DOUBLE, people ARRAY<STRING>")
    people = spark.createDataFrame([("w", "G", 5), ("w", "C", None), ("w", "A", 6)], "work STRING, name STRING, first_page INT")
    got = {r["chapter"]: r for r in v.chapter_summaries(chapters, ev, people, ["work"]).collect()}
    assert got[1]["short"] == "Chapter 1 covers 2 key moments. a" and got[1]["medium"] == "G, C · a\nb" and (got[1]["important"], got[1]["new_characters"]) == ("a", "G")
    assert got[2]["short"] == "Chapter 2: (no significant events detected)" and got[2]["new_characters"] == "A" and got[2]["n_events"] == 0
