"""Literal cases of the operators, on tiny tables."""

import random

import pytest
from pyspark.sql import functions as F

from storyloom.functions import geometry as g
from storyloom.functions import providers
from storyloom.functions import scoring as s
from storyloom.functions import text as t
from storyloom.operators import boxes as b
from storyloom.operators import entities as e
from storyloom.operators import extraction as x
from storyloom.operators import jobs
from storyloom.operators import matching as m
from storyloom.operators import rules
from storyloom.operators import sequence as q
from storyloom.operators import shots, states


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("name, want", [("Griffith's army", "Griffith army"), ('"Guts (warrior)"', "Guts"), ("  A   B ", "A B")])
def test_normalize_name(spark, name, want):
    assert one(spark, t.normalize_name(F.lit(name)))[0] == want


@pytest.mark.parametrize("a, b_, want", [("KING GRIFFITH", "Griffith", True), ("The Black Swordsman", "Black Swordsman", True), ("Guts-san", "Guts", False), ("Gattsu", "Guts", False), ("", "Guts", False)])
def test_fuzzy_similar(spark, a, b_, want):
    assert one(spark, t.fuzzy_similar(F.lit(a), F.lit(b_)))[0] is want


@pytest.mark.parametrize("text, want", [("「…」", "dialogue"), ("ドンッ", "sfx"), ("!!", "sfx"), ("こんにちは", "unknown"), ("  ", "unknown"), (None, "unknown")])
def test_block_class(spark, text, want):
    assert one(spark, t.block_class(F.lit(text).cast("string")))[0] == want


@pytest.mark.parametrize("title, want", [("Title v01 (2003) (Digital)", 1), ("Vol. 12", 12), ("#105", 105), ("none", 0)])
def test_volume(spark, title, want):
    assert one(spark, t.volume_number(F.lit(title)))[0] == want


def test_text_cleaning(spark):
    r = one(spark, t.elide(F.lit(" Unknown ")).alias("a"), t.elide(F.lit("x  y")).alias("b"), t.to_text(F.lit(" ")).alias("c"), t.to_confidence(F.lit("7")).alias("d"), t.to_confidence(F.lit("bad")).alias("e"), t.json_object(F.lit('ok {"a": 1} done')).alias("f"), t.json_object(F.lit("no")).alias("g"), t.strip_answer(F.lit('```\nNarration: "Hi"\n```')).alias("h"), t.slug(F.lit("É!")).alias("i"), t.strip_volume(F.lit("Monster (Naoki Urasawa) v2")).alias("j"), t.nfkc(F.lit("ｱ１")).alias("k"))
    assert tuple(r) == (None, "x y", "unknown", 1.0, 0.0, '{"a": 1}', None, "Hi", "item", "Monster (Naoki Urasawa)", "ア1")


def box(x, y, w, h):
    return F.struct(*(F.lit(v).alias(k) for v, k in zip((x, y, w, h), "xywh")))


def test_geometry(spark):
    r = one(spark, g.iou(box(0, 0, 10, 10), box(5, 0, 10, 10)).alias("i"), g.is_inside(box(1, 1, 2, 2), box(0, 0, 9, 9)).alias("in"), g.box(F.array(F.lit(1.0), F.lit(2.0), F.lit(0.0), F.lit(4.0))).alias("bad"), g.clamp(box(-5, 95, 20, 20), F.lit(100), F.lit(100)).alias("c"))
    assert r["i"] == pytest.approx(1 / 3) and r["in"] is True and r["bad"] is None and tuple(r["c"]) == (0, 80, 20, 20)


def test_suppress_keeps_first_and_last(spark):
    data = [(1, (10, 10, 100, 100)), (2, (12, 12, 100, 100)), (3, (150, 150, 40, 40)), (4, (146, 146, 200, 200))]
    df = rows(spark, data, "id INT, box STRUCT<x: INT, y: INT, w: INT, h: INT>").agg(F.collect_list(F.struct("box", "id")).alias("b"))
    assert {r["id"] for r in df.select(F.inline(b.suppress(F.col("b")))).collect()} == {1, 4}


GRID = [(32, 32, 157, 167), (222, 32, 147, 167), (32, 232, 157, 167), (222, 232, 147, 167), (32, 432, 157, 150), (222, 432, 147, 150)]
MIXED = [(260, 30, 120, 300), (30, 30, 200, 170), (30, 230, 200, 210), (260, 350, 120, 90)]
SPAN = [(200, 20, 140, 160), (20, 20, 140, 400), (200, 200, 140, 160), (200, 380, 140, 160)]


@pytest.mark.parametrize("boxes, rtl, want", [(GRID, True, [2, 1, 4, 3, 6, 5]), (GRID, False, [1, 2, 3, 4, 5, 6]), (MIXED, True, [1, 2, 3, 4]), (SPAN, True, [1, 2, 3, 4])])
def test_reading_order(spark, boxes, rtl, want):
    df = rows(spark, [(1, i + 1, *v) for i, v in enumerate(boxes)], "page INT, id INT, x INT, y INT, w INT, h INT")
    got = b.reading_order(df, ["page"], right_to_left=rtl).orderBy("rank").collect()
    assert [r["id"] for r in got] == want


def test_reading_order_leaves_out_bad_boxes(spark):
    df = rows(spark, [(1, 1, 0, 0, 0, 5), (1, 2, 0, 0, 5, 5), (1, 3, None, 0, 5, 5)], "page INT, id INT, x INT, y INT, w INT, h INT")
    assert {r["id"]: r["rank"] for r in b.reading_order(df, ["page"]).collect()} == {1: None, 2: 1, 3: None}


PANEL = "page INT, n INT, location STRING, characters ARRAY<STRING>, event STRING, dialogue STRING, actions ARRAY<STRING>"


def scored(spark, first, second, keywords=()):
    df = rows(spark, [(1, 1, *first), (1, 2, *second)], PANEL)
    prev = q.previous(df, ["page"], ["n"], ["location", "characters", "event", "dialogue", "actions"])
    return prev.where("n = 2").select(q.boundary_score(keywords)).first()[0]


@pytest.mark.parametrize("first, second, keywords, want", [
    (("a", None, None, None, None), ("b", None, None, None, None), (), 0.45),
    (("a", None, "e", None, None), ("a", None, "e", None, None), (), 0.0),
    ((None, None, None, None, None), (None, [], None, None, None), (), 0.0),
    ((None, ["x"], None, None, None), (None, ["y"], None, None, None), (), 0.55),
    ((None, None, "e", None, None), (None, None, None, "Meanwhile", None), ("meanwhile",), 0.5),
])
def test_boundary_score(spark, first, second, keywords, want):
    assert scored(spark, first, second, keywords) == pytest.approx(want)


def marks(spark, data):
    return rows(spark, [("w", *r) for r in data], "work STRING, page INT, number INT, confidence DOUBLE, source STRING")


def test_chapter_merge(spark):
    got = x.merge_marks(marks(spark, [(5, None, 0.8, "a"), (7, None, 0.9, "b")]), 90).collect()
    assert [(r["start_page"], r["chapter"], r["n_marks"], r["sources"]) for r in got] == [(7, 1, 2, ["a", "b"])]
    got = x.merge_marks(marks(spark, [(1, None, 0.8, "a"), (30, None, 0.8, "a"), (60, None, 0.8, "a")]), 90).orderBy("start_page").collect()
    assert [(r["end_page"], r["chapter"]) for r in got] == [(29, 1), (59, 2), (90, 3)]


def test_chapter_marks(spark):
    pages = rows(spark, [("w", 1, "Chapter 3: Dawn"), ("w", 2, "Meanwhile, far away"), ("w", 3, None)], "work STRING, page INT, text STRING")
    assert [(r["page"], r["number"], round(r["confidence"], 2)) for r in x.chapter_marks(pages).collect()] == [(1, 3, 0.8)]
    assert [r["page"] for r in x.opener_marks(pages).collect()] == [2]


def test_fill_numbers(spark):
    df = rows(spark, [(1, 1, None), (1, 2, None), (1, 3, 7), (1, 4, None)], "k INT, p INT, n INT")
    assert [r["c"] for r in q.fill_numbers(df, ["k"], ["p"], "n", "c").orderBy("p").collect()] == [1, 2, 7, 8]


def test_ranges(spark):
    ranges = rows(spark, [(1, 50, "first"), (51, 100, "second")], "lo INT, hi INT, title STRING")
    got = m.lookup_in_ranges(rows(spark, [(25,), (60,), (200,)], "page INT"), "page", ranges, "lo", "hi", 16, ["title"])
    assert {r["page"]: r["title"] for r in got.collect()} == {25: "first", 60: "second", 200: None}


def test_mapping(spark):
    panels = rows(spark, [(i,) for i in range(1, 7)], "p INT")
    links = rows(spark, [(5, "s1"), (3, "s1"), (3, "s2"), (1, "s3"), (4, "s3"), (1, "s3"), (99, "s4")], "p INT, s STRING")
    got = {r["p"]: r["cardinality"] for r in m.mapping(panels, links, "p", "s").collect()}
    assert got == {1: "many_to_one", 2: "unmatched", 3: "one_to_many", 4: "many_to_one", 5: "many_to_one", 6: "unmatched"}
    assert [r["p"] for r in m.unknown_links(panels, links, "p").collect()] == [99]


def test_overlaps_and_as_of(spark):
    a = rows(spark, [(1, 0, 100, "x"), (1, 300, 400, "y")], "k INT, s INT, e INT, n STRING")
    c = rows(spark, [(1, 50, 350, "z"), (2, 0, 9, "w")], "k INT, s INT, e INT, n STRING")
    assert {(r["l"]["n"], r["r"]["n"]) for r in m.overlaps(a, c, ["k"], "s", "e", 40).collect()} == {("x", "z"), ("y", "z")}
    facts = rows(spark, [(1, 5, 1), (1, 1, 2)], "k INT, t INT, id INT")
    states = rows(spark, [(1, 3, 9, "on")], "k INT, t INT, id INT, v STRING")
    assert {r["id"]: r["state"] for r in m.as_of(facts, states, ["k"], "t", "id", "v", "state").collect()} == {1: "on", 2: None}


def test_best_two(spark):
    df = rows(spark, [(1, "a", 0.9), (1, "b", 0.89), (2, "a", 0.3), (3, "a", 0.9), (3, "b", 0.2)], "k INT, i STRING, s DOUBLE")
    got = {r["k"]: (r["best"], r["second"], r["needs_review"]) for r in m.best_two(df, ["k"], "s", "i", 0.02, 0.55).collect()}
    assert got == {1: ("a", "b", True), 2: ("a", None, True), 3: ("a", None, False)}


def test_best_two_of_rounded_scores(spark):
    df = rows(spark, [(1, "a", 100.1), (1, "b", 60.1), (2, "a", 100.1), (2, "b", 60.11)], "k INT, i STRING, s DOUBLE")
    assert 100.1 - 60.1 < 40
    got = {r["k"]: (r["second"], r["needs_review"]) for r in m.best_two(df, ["k"], "s", "i", 40.0, 50.0, digits=2).collect()}
    assert got == {1: (None, False), 2: ("b", True)}


def test_fold_and_snapshots(spark):
    log = rows(spark, [(1, 1, "a", 5, None), (1, 2, None, 9, "x"), (1, 3, "c", 2, "y")], "k INT, seq INT, name STRING, page INT, note STRING")
    r = e.fold(log, ["k"], ["seq"], overwrite=["name"], fill=["note"], least=["page"], count="n").first()
    assert (r["name"], r["note"], r["page"], r["n"]) == ("c", "x", 2, 3)
    assert e.last_write(log, ["k"], ["seq"]).first()["name"] == "c"
    old, new = rows(spark, [(1, "a"), (2, None)], "k INT, v STRING"), rows(spark, [(2, None), (3, "c")], "k INT, v STRING")
    assert {r["k"]: r["change"] for r in e.diff(old, new, ["k"]).collect()} == {1: "removed", 3: "added"}
    assert {r["k"]: r["v"] for r in e.merge_snapshot(old, rows(spark, [(1, None), (2, "z"), (4, "q")], "k INT, v STRING"), ["k"]).collect()} == {1: "a", 2: "z", 4: "q"}
    assert sorted(r["k"] for r in e.insert_missing(old, new, ["k"]).collect()) == [1, 2, 3]


@pytest.mark.parametrize("values, want", [("xx", ("x", "auto", 2)), ("xy", ("x", "conflicted", 2)), ("xyx", ("x", "conflicted", 3)), ("xyz", ("z", "auto", 3))])
def test_memory_states(spark, values, want):
    log = rows(spark, [(i, v, "auto", 0.5, i) for i, v in enumerate(values)], "seq INT, value STRING, state STRING, confidence DOUBLE, page INT")
    r = states.fold_states(log.withColumn("key", F.lit(1)), "key", "seq").first()
    assert (r["value"], r["state"], r["seen_count"]) == want


def test_conflicts(spark):
    log = rows(spark, [("k", 1, "A", "internet"), ("k", 2, " a ", "ocr"), ("k", 3, "B", "pdf"), ("l", 1, "A", "user"), ("l", 2, "C", "pdf")], "key STRING, seq INT, value STRING, source STRING")
    got = {r["key"]: (r["value_b"], r["resolved_value"], r["resolved_by"]) for r in e.resolve_conflicts(e.open_conflicts(log, ["key"], ["seq"], "value", "source"), "pdf").collect()}
    assert got == {"k": ("B", "B", "auto"), "l": ("C", "A", "user")}


def test_timeline_and_split(spark):
    df = rows(spark, [(1, 1, 10.0), (1, 2, 10.0), (1, 3, 5.0)], "k INT, i INT, d DOUBLE")
    got = q.timeline(q.transitions(df, ["k"], ["i"], "d"), ["k"], ["i"], "d", "transition").orderBy("i").collect()
    assert [(r["start_time"], r["end_time"]) for r in got] == [(0.0, 10.0), (9.7, 19.7), (19.4, 24.4)]
    parts = shots.split_long(rows(spark, [(20.0,), (4.0,)], "d DOUBLE"), "d").collect()
    assert sorted(r["piece_seconds"] for r in parts) == [4.0, 5.0, 5.0, 10.0]


def test_keyframes(spark):
    frames = F.array(*(F.struct(*(F.lit(float(v)).alias(k) for k, v in zip("txywh", f))) for f in ((0, 0, 0, 1, 1), (1, 0.25, 0.25, 0.5, 0.5))))
    r = one(spark, s.sample(frames, F.lit(0.5)).alias("a"), s.sample(frames, F.lit(2.0)).alias("b"), F.size(s.keyframes(F.lit("pan_left"), F.lit(100.0), F.lit(50.0), F.lit(3.0))).alias("n"))
    assert tuple(r["a"]) == (0.125, 0.125, 0.75, 0.75) and tuple(r["b"]) == (0.25, 0.25, 0.5, 0.5) and r["n"] == 12


def test_rules(spark):
    df = rows(spark, [(1, "a"), (-1, None)], "n INT, s STRING")
    checked = rules.check(df, {"positive": (F.col("n") > 0, True), "named": (F.col("s") != "", False)})
    assert {r["rule"]: (r["n_failed"], r["status"]) for r in checked.collect()} == {"positive": (1, "error"), "named": (1, "warning")}
    assert rules.overall(checked).first()["status"] == "error"
    good, bad = rules.split_valid(df, {"positive": F.col("n") > 0})
    assert good.count() == 1 and bad.first()["errors"] == ["positive"]


def test_jobs_resume(spark, tmp_path):
    calls, broken = [], [True]

    def second(_):
        if broken[0]:
            raise ValueError("lost")
        calls.append("b")

    p = jobs.Pipeline(spark, str(tmp_path / "state"), [("a", lambda _: calls.append("a")), ("b", second)])
    with pytest.raises(ValueError):
        p.run("f1")
    broken[0] = False
    assert p.next_pending() == "b" and p.run("f1") == ["b"] and p.run("f1") == [] and p.run("f2") == ["a", "b"]
    assert calls == ["a", "b", "a", "b"] and p.load()["b"]["attempts"] == 3


def test_fingerprint_ignores_order(spark):
    a = spark.range(10)
    assert jobs.fingerprint(a) == jobs.fingerprint(a.orderBy(F.desc("id"))) != jobs.fingerprint(spark.range(11))


def test_providers(spark):
    df = rows(spark, [("hello\nworld",), (None,)], "prompt STRING")
    got = providers.apply(df, "text", ["mock"], "prompt").collect()
    assert [r["provider"] for r in got] == ["mock", "mock"] and '"hello"' in got[0]["answer"]
    with pytest.raises(ValueError):
        providers.create("ocr", "nothing")


def test_fuzzy_names_meet_inside_longer_words(spark):
    from storyloom.functions.text import name_blocks
    from storyloom.operators.matching import resolve_fuzzy

    names = spark.createDataFrame([("silver",), ("old goldsmithery",), ("short",)], "name STRING")
    known = spark.createDataFrame([(1, "a silverware set", 1), (2, "Goldsmith", 2), (3, "shorts", 3)], "entity_id LONG, entity_name STRING, rank LONG")
    got = {r["name"]: r["entity_id"] for r in resolve_fuzzy(names, "name", known, name_blocks("n", "e"), name_blocks("e", "n")).collect()}
    assert got == {"silver": 1, "old goldsmithery": 2, "short": None}


def test_keyframes_lie_in_as_many_tasks_as_their_rows_ask_for(spark, sf, monkeypatch):
    from storyloom import tables
    from storyloom.plans import catalogue

    monkeypatch.setattr(tables, "ROWS", 20)
    got = catalogue.queries()["keyframes"](spark, sf)
    parts = spark.read.parquet(f"{sf}/part.parquet").count()
    assert got.count() == 12 * parts and got.rdd.getNumPartitions() == -(-parts // 20) > 1
    # Nothing tests the frames before the rows are dealt.
    assert "size(" not in got._jdf.queryExecution().optimizedPlan().toString()
