"""The versioned store: writes that fail, deletes of everything, repeated keys, two writers."""

import pytest
from pyspark.sql import functions as F

from storyloom.operators import entities as e
from storyloom.operators import store as s
from storyloom.sources import sinks
from storyloom.sources.versions import Versions

DDL = "k INT, w STRING, x INT"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def at(spark, tmp_path):
    return Versions(spark, str(tmp_path / "t"), DDL, ("w",))


def test_failed_write_keeps_the_old_rows(spark, at, tmp_path):
    at.replace(spark.createDataFrame([(1, "a", 1)], DDL))
    bad = spark.createDataFrame([(2, "a", 2), (3, "b", None)], DDL).withColumn("x", F.when(F.col("x").isNull(), F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("x")))
    for write in (at.replace, at.add):
        with pytest.raises(Exception, match="lost"):
            write(bad)
        assert rows(at.read()) == [(1, "a", 1)]
    path = str(tmp_path / "snapshot")
    sinks.write_snapshot(spark.createDataFrame([(i, "a", i) for i in range(5)], DDL), path)
    with pytest.raises(Exception, match="lost"):
        sinks.write_snapshot(bad, path)
    assert sinks.read_snapshot(spark, path, DDL).count() == 5
    assert at.vacuum() == 2 and rows(at.read()) == [(1, "a", 1)]


def test_keys_null_keys_and_deletes(spark, at):
    assert at.read().count() == 0 and at.vacuum() == 0
    at.replace(spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, "b", 3)], DDL))
    before = at.read()
    at.replace(spark.createDataFrame([(9, None, 9)], DDL), touched=spark.createDataFrame([("a",)], "w STRING"))
    assert rows(at.read()) == [(3, "b", 3), (9, None, 9)] and len(rows(before)) == 3
    at.add(spark.createDataFrame([(3, "b", 3), (4, "a", 4)], DDL))
    assert rows(at.read()) == [(3, "b", 3), (3, "b", 3), (4, "a", 4), (9, None, 9)]
    at.compact()
    assert len(rows(at.read())) == 4 and at.vacuum() > 0 and len(rows(at.read())) == 4


def test_many_versions_are_folded(spark, tmp_path):
    at = Versions(spark, str(tmp_path / "t"), DDL, ("w",), most=3)
    for i in range(6):
        at.replace(spark.createDataFrame([(i, "ab"[i % 2], i)], DDL))
    assert rows(at.read()) == [(4, "a", 4), (5, "b", 5)] and len(at._state()["versions"]) <= 3


def test_marks_see_replays(spark, at):
    one = spark.createDataFrame([(1, "a", 1)], DDL)
    assert at.add(one, ("q", 0)) and not at.add(one, ("q", 0)) and at.add(one, ("other", 0)) and at.add(one, ("q", 1)) and not at.replace(one, mark=("q", 0))
    assert len(rows(at.read())) == 3 and at.marks() == {"q": 1, "other": 0}


def test_second_writer_is_refused(spark, at):
    at.replace(spark.createDataFrame([(1, "a", 1)], DDL))
    state = at._state()
    at.replace(spark.createDataFrame([(2, "b", 2)], DDL))
    with pytest.raises(FileExistsError):
        at._commit(state | {"n": state["n"] + 1})
    assert rows(at.read()) == [(1, "a", 1), (2, "b", 2)]


def test_store_deletes_all_and_makes_repeated_keys_one(spark, tmp_path):
    st = s.Store(spark, str(tmp_path))
    ddl = "work_id STRING, term STRING, definition STRING, source STRING, seq INT"
    new = spark.createDataFrame([("w1", "a", "one", None, 1), ("w1", "a", "two", None, 2), ("w1", "a", None, "pdf", 3), ("w1", "b", "x", None, 1), ("w2", "a", "y", None, 1), (None, "a", "z", None, 1)], ddl)
    st.upsert("terminology", new, ["seq"])
    assert rows(st.table("terminology")) == rows(spark.createDataFrame([("w1", "a", "two", "pdf"), ("w1", "b", "x", None), ("w2", "a", "y", None), (None, "a", "z", None)], "a STRING, b STRING, c STRING, d STRING"))
    st.upsert("terminology", new.drop("seq"))
    assert st.table("terminology").count() == 4
    st.delete("terminology", "w1", F.lit(True))
    assert rows(st.rows("terminology", "w1")) == [] and st.table("terminology").count() == 2
    st.delete("terminology", spark.createDataFrame([("w2",), (None,)], "work_id STRING"), F.col("definition") == "z")
    assert rows(st.table("terminology").select("work_id")) == [("w2",)]
    st.log("timeline", spark.createDataFrame([("w1", "e1"), ("w1", "e1")], "work_id STRING, entry_id STRING"))
    assert st.rows("timeline", "w1").count() == 2 and st.stats().where("n_rows > 0").count() == 2


def test_one_row_without_an_order_is_the_same_each_time(spark):
    df = spark.createDataFrame([(1, "b", None), (1, "a", 3), (2, None, None)], DDL.replace("w", "v"))
    got = [rows(e.one_row(df.repartition(n), ["k"])) for n in (1, 3)]
    assert got[0] == got[1] and len(got[0]) == 2 and got[0][0][2] == 3


def test_merge_maps(spark):
    table = spark.createDataFrame([(1, {"a": True, "b": True}), (2, {"a": True})], "p INT, m MAP<STRING, BOOLEAN>")
    log = spark.createDataFrame([(1, "a", True, 1), (1, "a", False, 2), (3, "z", None, 1), (1, None, True, 1)], "p INT, n STRING, v BOOLEAN, seq INT")
    assert {r["p"]: r["m"] for r in e.merge_maps(table, log, "p", "m", "n", "v", "seq").collect()} == {1: {"a": False, "b": True}, 3: {"z": None}}


def test_scratch_tables_go_but_for_the_kept(spark):
    import os

    from storyloom.tables import materialize, scratch

    kept = []
    with scratch(kept):
        a = materialize(spark.range(3), "a")
        kept.append(materialize(a.where("id > 0"), "b"))
    assert not os.path.exists(a._written_to) and kept[0].count() == 2
    with pytest.raises(ValueError), scratch():
        a = materialize(spark.range(3), "a")
        raise ValueError
    assert a.count() == 3
