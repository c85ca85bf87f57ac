"""Aliases against all pairs, casts and texts by literal cases, sums over ranges of a key."""

import random

import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as t
from storyloom.operators import aliases as a
from storyloom.operators import cast as c
from storyloom.operators import extraction as x
from storyloom.operators import retrieval as r
from storyloom.operators import sequence as q
from storyloom.operators import store
from storyloom.tables import running


def value(spark, column, *texts):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i INT, v STRING")
    return [row["o"] for row in df.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize("few", [0, 100_000])
def test_mentions_equal_contains_over_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(a, "FEW_RUNS", few)
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice("aabなに xyz") for _ in range(rng.randint(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, "ab" * 5000)]
    names = ["a", "な", "ab", "なに", "aba", "xyzx", "aaaa", "に x", "nowhere", "", None, "ab" * 30, "ab"]
    got = {(m["i"], m["alias"]) for m in a.mentions(spark.createDataFrame(texts, "i INT, v STRING"), "i", "v", spark.createDataFrame([(n,) for n in names], "alias STRING")).collect()}
    assert got == {(i, n) for i, v in texts for n in names if v and n and n in v}
    none = spark.createDataFrame([], "i INT, v STRING")
    assert a.mentions(none, "i", "v", spark.createDataFrame([("a",)], "alias STRING")).count() == 0


def test_candidates(spark):
    known = spark.createDataFrame([(1, 1, "Guts", None), (1, 2, "Griffith", "leader; rival of Casca"), (1, 3, "Casca Smith", "a captain"), (1, 4, "guts", "again"), (2, 1, None, None)], "page INT, place INT, candidate STRING, description STRING")
    asked = [(1, "guts's"), (1, "Casca"), (1, "captain"), (1, "Unknown 3"), (1, "nobody"), (2, "Guts"), (3, "Guts"), (1, None)]
    got = {(g["page"], g["name"]): (g["candidate"], g["score"]) for g in a.identified(spark.createDataFrame(asked, "page INT, name STRING"), known, ["page"]).collect()}
    assert got == {(1, "guts's"): ("Guts", 1.0), (1, "Casca"): ("Casca Smith", 0.7), (1, "captain"): ("Casca Smith", 0.6), (1, "Unknown 3"): (None, None), (1, "nobody"): (None, None), (2, "Guts"): (None, None), (3, "Guts"): (None, None), (1, None): (None, None)}


def test_candidates_that_repeat_meet_once(spark):
    known = spark.range(2_000).select(F.lit(1).alias("page"), F.col("id").alias("place"), F.concat(F.lit("Casca "), (F.col("id") % 3).cast("string")).alias("candidate"), F.lit("a captain").alias("description"))
    asked = spark.range(2_000).select(F.lit(1).alias("page"), F.element_at(F.array(F.lit("Casca"), F.lit("CASCA's"), F.lit("captain")), (F.col("id") % 3 + 1).cast("int")).alias("name"))
    got = a.identified(asked, known, ["page"])
    assert {(g["name"], g["candidate"], g["score"], g["n"]) for g in got.groupBy("name", "candidate", "score").agg(F.count("*").alias("n")).collect()} == {("Casca", "Casca 0", 0.7, 667), ("CASCA's", "Casca 0", 0.7, 667), ("captain", "Casca 0", 0.6, 666)}
    joins = [0]

    def rows_of(node):
        if node.nodeName().endswith("Join") or node.nodeName() == "CartesianProduct":
            joins[0] = max(joins[0], node.metrics().get("numOutputRows").get().value())
        for i in range(node.children().size()):
            rows_of(node.children().apply(i))

    plan = got._jdf.queryExecution().executedPlan()
    got.collect()
    rows_of(plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
    assert joins[0] <= 2_000


def test_what_is_remembered_of_a_name(spark):
    records = spark.createDataFrame([(i, i, p, v) for i, (p, v) in enumerate([(3, "Ｇuts fights"), (None, "guts rests"), (9, "ガッツ が来た"), (3, "guts again"), (1, "gutsy"), (None, None)])], "record INT, place INT, page INT, text STRING")
    spelt = spark.createDataFrame([("ガッツ", "Guts")], "alias STRING, canonical STRING")
    got = a.remembered_of(records, spark.createDataFrame([("ガッツ",), ("Guts",), ("",), (None,), ("two words",)], "name STRING"), spelt)
    assert [(g["name"], g["record"]) for g in got.orderBy("name", "rank").collect()] == [("Guts", 0), ("Guts", 3), ("Guts", 1), ("ガッツ", 2), ("ガッツ", 0), ("ガッツ", 3), ("ガッツ", 1)]
    assert got.where("rank > 6").count() == 0


def test_tokens_of_japanese_and_of_compatible_forms(spark):
    got = value(spark, t.memory_tokens, "The ｶﾞｯﾂ と Ｇｕｔｓ, ﬁre! 第3話", "é", None)
    assert sorted(got[0]) == sorted(["ガッツ", "と", "guts", "fire", "第3話"]) and got[1] == [] and got[2] is None
    assert value(spark, t.plan_tokens, "A null Ox, no 7 42 ox") == [["ox", "42"]]
    assert value(spark, t.slug, "Ｂｅｒｓｅｒｋ ② !", "ベルセルク") == ["berserk-2", "item"]
    records = spark.createDataFrame([("k", "ガッツ の剣", 3, 0.9, "auto"), ("l", "other", 3, 0.9, "auto")], "key STRING, value STRING, page INT, confidence DOUBLE, state STRING")
    assert r.retrieve(records, extra="ｶﾞｯﾂ", k=1).first()["key"] == "k"


def test_json_objects(spark):
    assert value(spark, t.json_object, 'say {"v": 1} now', '{"v": 1}\n{"w": 2}', '{"v": {"w": [1]}}', "none", '{"v": }', None) == ['{"v": 1}', None, '{"v": {"w": [1]}}', None, None, None]


def test_names(spark):
    assert value(spark, t.normalize_name, "  Guts's  (young) sword ", "“Guts”", "「Casca」", "Griffith’s", "O'sullivan", "") == ["Guts sword", "Guts", "Casca", "Griffith", "O'sullivan", ""]


def test_all_ways_to_write_a_chapter(spark):
    texts = ["Chapter 7: The Brand", "x" * 90 + " ch. 3", "#12 Dawn of it", "# 5 lower", "第 21 話", "Volume 2 Chapter 9", "nothing", ""]
    pages = spark.createDataFrame([("w", i, v, n) for i, (v, n) in enumerate(zip(texts, (1, 3, 4, None, 2, 0, 1, 1)))], "work STRING, page INT, text STRING, n_panels INT")
    got = {(m["page"], m["number"], m["title"], round(m["confidence"], 2)) for m in x.chapter_marks(pages).collect()}
    assert got == {(0, 7, "The Brand", 0.8), (1, 3, "", 0.5), (2, 12, "Dawn of it", 0.8), (3, 5, "", 0.6), (4, 21, "", 0.6), (5, 9, "", 0.5), (5, 2, "9", 0.8)}
    assert {(m["page"], m["number"], m["confidence"]) for m in x.title_pages(pages).collect()} == {(0, 7, 0.75), (1, 3, 0.75), (3, 5, 0.75), (4, 21, 0.75), (5, 9, 0.75)}
    zero = spark.createDataFrame([("w", 1, "Chapter 0 第4話", 1)], pages.schema)
    assert x.title_pages(zero).first()["number"] == 4
    opened = spark.createDataFrame([("w", i, v) for i, v in enumerate(["しかし", "Meanwhile", "そして彼は", "しかし彼は", "x" * 101 + "later"])], "work STRING, page INT, text STRING")
    assert sorted(m["page"] for m in x.opener_marks(opened).collect()) == [2, 3]


WIKI = """lead text
== Main characters ==
=== ''Guts'' ===
{{Nihongo|x}} Guts is a [[mercenary|swordsman]]. He fights.
=== Band ===
==== Casca ====
Not a leaf above.
=== Kara ===
a denied group is here.
=== guts ===
shorter.
=== Griffith Hawk ===
Voiced by Someone here. "Griffith" leads the band! More.
== Other ==
=== Farnese===
"""


def test_cast_from_sections(spark):
    pages = spark.createDataFrame([(1, WIKI), (2, WIKI.replace("Main characters", "Islands")), (3, None), (4, "== Cast ==")], "page INT, text STRING")
    got = {(m["page"], m["name"], m["role"]) for m in c.cast_of(pages, ["page"], "text").collect()}
    assert got == {(1, "Guts", "a swordsman."), (1, "Griffith Hawk", "leads the band!"), (1, "Farnese", "")}
    blocks = c.sections(pages, ["page"], "text").where("page = 1").orderBy("block").collect()
    assert [b["level"] for b in blocks] == [2, 3, 3, 4, 3, 3, 3, 2, 3] and blocks[1]["heading"] == "''Guts''"


def test_marks_of_other_lengths_make_no_heading(spark):
    text = "== Cast ==\n=== Guts ===\nis a swordsman.\n===Puck ====\n====\n==== Casca ===\n=== a\u2028b ===\nis a line."
    pages = spark.createDataFrame([(1, text)], "page INT, text STRING")
    assert [(b["level"], b["heading"]) for b in c.sections(pages, ["page"], "text").orderBy("block").collect()] == [(2, "Cast"), (3, "Guts"), (3, "a\u2028b")]
    assert {m["name"] for m in c.cast_of(pages, ["page"], "text").collect()} == {"Guts", "a\u2028b"}


def test_linked_names(spark):
    body = "[[Guts]] and [[Guts (sword)]] [[Casca|Cas]] [[File:x.png]] " + "y" * 100 + " [[Guts]] [[Cas]] voiced by nobody " + "z" * 90 + "[[Puck|Puck Elf]][[Puck|Puck Elf]] [[the]] [[the]] [[Netflix Inc]] [[Netflix Inc]] [[a b c d e]] [[a b c d e]]\n==References\n[[Puck]] [[Puck]] [[Puck]]"
    got = c.linked_names(spark.createDataFrame([(1, 1, body), (1, 2, "[[Cas]] x [[Cas]]"), (2, 1, None), (3, 1, "[[Once]]")], "w INT, p INT, t STRING"), ["w"], "p", "t")
    assert [(m["w"], m["name"], m["n"], m["rank"]) for m in got.orderBy("w", "rank").collect()] == [(1, "Cas", 3, 1), (1, "Puck Elf", 2, 2)]


@pytest.mark.parametrize("n", [1, 400])
def test_sums_over_ranges_equal_windows(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, 1, 1, 1, 2]), rng.choice([None, *range(50)]), i, rng.randint(0, 9), rng.random() < 0.3) for i in range(n)]
    df = spark.createDataFrame(rows, "k INT, o INT, i INT, v INT, s BOOLEAN").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {m["i"]: m["b"] for m in running(df, ["k"], [F.desc("o"), F.col("i")], {"b": F.col("v")}).collect()}
        groups = {m["i"]: m["g"] for m in q.numbered(df, ["k"], ["o", "i"], F.col("s"), "g").collect()}
        gaps = {m["i"]: m["g"] for m in q.gap_groups(df.where("o is not null"), ["k"], ["o", "i"], "o", 2, "g").collect()}
        places = {m["i"]: m["position"] for m in store.listed(df, ["k"], [F.desc("v"), "i"], F.col("s")).collect()}
        times = {m["i"]: (m["start_time"], m["end_time"]) for m in q.timeline(df.withColumn("x", F.lit(0.5)), ["k"], ["i"], "v", "x").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for k in (None, 1, 2):
        mine = [r for r in rows if r[0] == k]
        total = 0
        for row in sorted(mine, key=lambda r: (r[1] is None, -(r[1] or 0), r[2])):
            assert got[row[2]] == total
            total += row[3]
        g = 0
        for j, row in enumerate(sorted(mine, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))):
            g += bool(row[4]) and j > 0
            assert groups[row[2]] == g
        g, was = 0, None
        for row in sorted((r for r in mine if r[1] is not None), key=lambda r: (r[1], r[2])):
            g += was is not None and row[1] - was > 2
            was = row[1]
            assert gaps[row[2]] == g
        for j, row in enumerate(sorted((r for r in mine if r[4]), key=lambda r: (-r[3], r[2]))):
            assert places[row[2]] == j + 1
        at = 0.0
        for row in sorted(mine, key=lambda r: r[2]):
            assert times[row[2]] == pytest.approx((at, at + row[3]))
            at += row[3] - 0.5


@pytest.mark.parametrize("few", [0, 100_000])
def test_keyword_hits_equal_counts_over_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(r, "FEW_TOKENS", few)
    monkeypatch.setattr(r, "CELLS", 40)
    rng = random.Random(3)
    said = lambda most: " ".join(rng.choice("abc cat dog éa ガッツ x1 sun the".split()) for _ in range(rng.randint(0, most)))
    texts = [(i, said(6)) for i in range(200)] + [(7, "cat dog"), (7, "cat sun"), (None, "dog x1"), (None, "dog sun"), (900, None), (901, "")]
    asked = [(f"q{i}", said(4)) for i in range(8)] + [("q1", "cat cat"), (None, "sun"), ("none", "")]
    words = lambda v: {w.replace("é", "") for w in (v or "").split() if w != "the"} - {"a"}
    hits = {}
    for q, v in asked:
        for d, w in texts:
            if n := len(words(v) & words(w)):
                hits[q, d] = hits.get((q, d), 0) + n
    want = {(q, d, n, i + 1) for q in {q for q, _ in hits} for i, (n, d) in enumerate(sorted(((n, d) for (p, d), n in hits.items() if p == q), key=lambda x: (-x[0], x[1] is not None, x[1] or 0))[:5])}
    df = spark.createDataFrame(texts, "d INT, v STRING").repartition(3)
    got = r.keyword_hits(df, spark.createDataFrame(asked, "q STRING, v STRING"), "d", "q", "v", 5)
    assert {(g["q"], g["d"], g["hits"], g["rank"]) for g in got.collect()} == want and got.schema.names == ["q", "d", "hits", "rank"]


def test_only_the_best_of_a_query_leave_a_task(spark):
    """No exchange takes the pairs of record and query: each task sends on k rows a query."""
    df = spark.range(0, 4_000, 1, 4).select("id", F.concat(F.lit("sun w"), (F.col("id") % 7).cast("string")).alias("v"))
    got = r.keyword_hits(df, spark.createDataFrame([(q, "sun w1") for q in range(10)], "q INT, v STRING"), "id", "q", "v", 3)
    assert {(g["id"], g["hits"], g["rank"]) for g in got.collect()} == {(1, 2, 1), (8, 2, 2), (15, 2, 3)}
    most = [0]

    def rows_of(node):
        node = node.plan() if node.nodeName().endswith("QueryStage") else node
        for i in range(node.children().size()):
            rows_of(node.children().apply(i))
        if node.nodeName() == "Exchange":
            most[0] = max(most[0], node.metrics().get("shuffleRecordsWritten").get().value())

    plan = got._jdf.queryExecution().executedPlan()
    rows_of(plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
    assert 0 < most[0] <= 4 * 10 * 3


@pytest.mark.parametrize("few", [0, 2_000])
def test_mentions_with_few_and_many_aliases(spark, monkeypatch, few):
    monkeypatch.setattr(a, "FEW_ALIASES", few)
    texts = [(1, "abab なに"), (1, "ab xyz"), (2, None), (3, ""), (None, "xyz"), (4, "zzz ab")]
    names = ["a", "ab", "なに", "xyz", "none of it", "", None, "ab"]
    got = [tuple(m) for m in a.mentions(spark.createDataFrame(texts, "i INT, v STRING").repartition(3), "i", "v", spark.createDataFrame([(n,) for n in names], "alias STRING")).collect()]
    assert {g for g in got if g[0]} == {(1, "a"), (1, "ab"), (1, "なに"), (1, "xyz"), (4, "a"), (4, "ab")} and len(got) == len(set(got))


def test_few_aliases_move_no_texts(spark):
    """Pairs leave the task that reads a text: there is no exchange, and nothing is written but ids that repeat."""
    texts = spark.range(50).select("id", F.concat(F.lit("sun "), F.col("id").cast("string")).alias("v"))
    got = a.mentions(texts, "id", "v", spark.createDataFrame([("sun",), ("4",)], "alias STRING"))
    assert got.count() == 50 + 14 and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
