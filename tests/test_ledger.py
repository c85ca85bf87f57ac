"""Records and conflicts against folds that take one event after the other."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from storyloom.operators import ledger, states
from storyloom.streaming import events as ev
from storyloom.streaming import incremental as inc

LOG = "key INT, seq INT, event STRING, value STRING, state STRING, confidence DOUBLE, page INT"


def random_log(n, seed, deletes=0.05):
    rng = random.Random(seed)
    kind = lambda: "delete" if (x := rng.random()) < deletes else "correct" if x < deletes + 0.05 else rng.choice(["observe", None])
    return [(rng.choice([1, 1, 1, 2, 3, None]), i, kind(), rng.choice(["x", "y", "z", None]), "verified" if rng.random() < 0.01 else rng.choice(["auto", "auto", "auto", "uncertain", None]), rng.choice([0.2, 0.5, 0.9, None]), rng.choice([i, None])) for i in range(n)]


class Memory:
    """The rules of a record, told as a class."""

    def __init__(self):
        self.all = {}

    def take(self, key, event, value, state, confidence, page):
        r = self.all.get(key)
        if event == "delete":
            self.all.pop(key, None)
        elif event == "correct":
            r = r or {"n": 0, "page": None, "bad": []}
            self.all[key] = r | {"v": value, "s": "user_corrected", "c": 1.0, "n": r["n"] + 1}
        elif r is None:
            self.all[key] = {"v": value, "s": state or "auto", "c": confidence, "n": 1, "page": page, "bad": []}
        else:
            r["n"] += 1
            if page is not None:
                r["page"] = page
            if r["v"] == value or r["s"] in ("verified", "user_corrected"):
                return
            if r["s"] == "uncertain" or state == "uncertain":
                if confidence is not None and r["c"] is not None and confidence > r["c"] + 0.15:
                    r["v"] = value
                r["s"] = "conflicted"
            elif r["s"] == "conflicted":
                r["v"], r["s"] = value, "auto"
            else:
                old = r["bad"]
                r["bad"] = [x for i, x in enumerate([r["v"], value, *old]) if x not in [r["v"], value, *old][:i]]
                r["s"] = "conflicted"

    def rows(self):
        return sorted(((k, r["v"], r["s"], r["c"], r["n"], r["page"], tuple(r["bad"])) for k, r in self.all.items()), key=str)


def told(log):
    m = Memory()
    for key, _, *event in log:
        m.take(key, *event)
    return m.rows()


def rows(df):
    return sorted(((r["key"], r["value"], r["state"], r["confidence"], r["seen_count"], r["page"], tuple(r["conflicting"])) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_batch_fold(spark, seed):
    log = random_log(700, seed, deletes=0.02)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows(states.fold_states(spark.createDataFrame(log, LOG).repartition(5), "key", "seq")) == told(log)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert states.fold_states(spark.createDataFrame([], LOG), "key", "seq").count() == 0


def last_of(stream, name, spark):
    """The last record that a stream gave out for each key."""
    out = {}

    def keep(batch, _):
        for r in batch.collect():
            out[r["key"]] = r

    stream.writeStream.outputMode("update").foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", name).start().awaitTermination()
    return sorted(((r["key"], r["value"], r["state"], r["confidence"], r["seen_count"], r["page"], tuple(r["conflicting"])) for r in out.values() if r["state"] != "deleted"), key=str)


@pytest.mark.parametrize("cuts", [(120,), (1, 50, 51)])
def test_stream_equals_batch_under_any_cut(spark, tmp_path, cuts):
    log = [r for r in random_log(150, 8) if r[0] is not None]
    for a, b in zip((0, *cuts), (*cuts, len(log))):
        if log[a:b]:
            spark.createDataFrame(log[a:b], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert last_of(ev.merge_memory(stream), str(tmp_path / "c"), spark) == told(log)


def test_stream_goes_on_from_a_snapshot(spark, tmp_path):
    log = [r for r in random_log(80, 5) if r[0] is not None]
    snapshot = states.fold_states(spark.createDataFrame(log[:40], LOG), "key", "seq")
    spark.createDataFrame(log[40:], LOG).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = dict((r[0], r) for r in last_of(ev.merge_memory(spark.readStream.schema(LOG).parquet(str(tmp_path / "in")), snapshot=snapshot), str(tmp_path / "c"), spark))
    want = {r[0]: r for r in told(log)}
    touched = {r[0] for r in log[40:]}
    assert {k: v for k, v in got.items() if k in touched} == {k: v for k, v in want.items() if k in touched}


def test_idle_keys_are_dropped(spark, tmp_path):
    kind = "key INT, seq INT, value STRING, page INT, ts TIMESTAMP"
    for i, part in enumerate(([(1, 1, "x", None, "2024-01-01 00:00:00"), (2, 1, "x", 4, "2024-01-20 00:00:00")], [(3, 1, "x", 1, "2024-02-10 00:00:00")], [(1, 2, "y", 2, "2024-02-11 00:00:00"), (2, 2, "x", 5, "2024-02-11 00:00:00")])):
        spark.createDataFrame(part, kind.replace("TIMESTAMP", "STRING")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    seen = []
    for i in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"in{i}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i}-{f.name}")
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in")).withWatermark("ts", "0 seconds")
        ev.merge_memory(stream, idle=dt.timedelta(days=30)).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend((r["key"], r["state"], r["seen_count"]) for r in b.collect()) and None).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert (1, "expired", 0) in seen and (2, "expired", 0) not in seen
    assert (1, "auto", 1) in seen[seen.index((1, "expired", 0)) :] and (2, "auto", 2) in seen


def by_hand(entities, events):
    """Conflicts and values of one key, an event at a time."""
    stored, kind = dict(entities).get("value"), entities["kind"]
    evidence, current, out = [], None, []
    for seq, event, value, source, confidence in events:
        if event == "evidence":
            evidence.append((confidence, -seq, source))
            clean = lambda s: (s or "").strip(" ").lower()
            if clean(stored) and clean(value) and clean(stored) != clean(value):
                if current is None:
                    of = min(evidence)[2] if kind == "metadata" else max(evidence)[2]
                    current = {"a": (stored, of), "b": (value, source), "opened": seq, "n": 0}
                current["n"] += 1
        else:
            if event == "correct":
                evidence.append((1.0, -seq, "user"))
            if current:
                (va, sa), (vb, sb) = current["a"], current["b"]
                kept = value if event == "correct" else va if sa == "user" else vb if sb == "user" else va if sa == source else vb if sb == source else va if sa == "pdf" else vb
                out.append((va, sa, vb, sb, current["opened"], current["n"], kept, "user" if event == "correct" or "user" in (sa, sb) else "auto", seq))
                current = None
            if event == "correct":
                stored = value
    if current:
        out.append((*current["a"], *current["b"], current["opened"], current["n"], None, None, None))
    return out, stored


def test_ledger_against_one_event_after_the_other(spark):
    rng = random.Random(2)
    entities = {k: {"kind": rng.choice(["metadata", "character"]), "value": rng.choice(["A", " a ", "b", "", None])} for k in range(12)}
    logs = {k: [(i, rng.choice(["evidence"] * 5 + ["resolve", "correct"]), rng.choice(["A", "a", "B", "c ", "", None]), rng.choice(["pdf", "internet", "ocr", "user", "vlm"]), rng.choice([0.2, 0.5, 0.5, 0.9])) for i in range(rng.choice([0, 3, 60]))] for k in range(14)}
    e = spark.createDataFrame([(k, v["kind"], v["value"]) for k, v in entities.items()], "key INT, kind STRING, value STRING")
    log = spark.createDataFrame([(k, *x) for k, s in logs.items() for x in s], "key INT, seq INT, event STRING, value STRING, source STRING, confidence DOUBLE").repartition(7)
    conflicts, values = ledger.conflict_ledger(e, log, ["key"])
    got = {}
    for r in conflicts.orderBy("key", "number").collect():
        got.setdefault(r["key"], []).append(tuple(r)[2:])
    want = {k: by_hand(v, logs[k]) for k, v in entities.items()}
    assert got == {k: c for k, (c, _) in want.items() if c}
    known = {r["key"]: r["value"] for r in values.collect()}
    assert {k: known[k] for k in entities} == {k: v for k, (_, v) in want.items()}
    none = ledger.conflict_ledger(e.limit(0), log.limit(0), ["key"])
    assert none[0].count() == 0 and none[1].count() == 0


def work(items):
    bad = F.when(F.col("x") < 0, "negative")
    return items.where("x <> 7").select("k", (F.col("x") * 2).alias("y"), bad.alias("error"))


def test_crash_before_the_record_writes_once(spark, tmp_path, monkeypatch):
    run = inc.Incremental(spark, str(tmp_path / "out"), ("k",), "k INT", "y INT", work)
    items = spark.createDataFrame([(1, 1), (1, 1), (2, -1), (3, 7)], "k INT, x INT")
    commit = inc.Versions._commit

    def crash(self, state):
        raise RuntimeError("lost")

    monkeypatch.setattr(inc.Versions, "_commit", crash)
    with pytest.raises(RuntimeError):
        run.process(items, 0)
    monkeypatch.setattr(inc.Versions, "_commit", commit)
    assert run.outcomes.read().count() == 0
    assert run.process(items, 0) and not run.process(items, 0)
    assert [tuple(r) for r in run.done().collect()] == [(1, 2, 0)]
    assert {(r["k"], r["error"], r["attempts"]) for r in run.dead_letters().collect()} == {(2, "negative", 1), (3, "no answer", 1)}
    better = spark.createDataFrame([(1, 5), (2, 4), (3, 7)], "k INT, x INT")
    assert run.process(better, 1)
    assert {tuple(r) for r in run.tallies().collect()} == {(0, 1, 0, 2), (1, 1, 1, 1)}
    assert {(r["k"], r["attempts"]) for r in run.dead_letters().collect()} == {(3, 2)}
    assert run.process(better, 2, force=True) and run.done().count() == 4
    assert run.outcomes.vacuum() >= 1 and run.done().count() == 4


def test_batches_lie_in_as_many_tasks_as_their_rows_ask_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inc, "ROWS", 5)
    run = inc.Incremental(spark, str(tmp_path / "out"), ("k",), "k INT", "y INT", work)
    first = spark.range(60).select((F.col("id") % 30).cast("int").alias("k"), F.when(F.col("id") % 30 < 5, -1).otherwise(1).alias("x"))
    assert run.process(first, 0) and run.process(first.unionByName(spark.createDataFrame([(30, 7)], "k INT, x INT")), 1)
    assert {tuple(r) for r in run.tallies().collect()} == {(0, 25, 0, 5), (1, 0, 25, 6)}
    assert run.outcomes.read().select(F.input_file_name()).distinct().count() >= 10
    letters = run.dead_letters()
    assert {(r["k"], r["attempts"]) for r in letters.collect()} == {(k, 2) for k in range(5)} | {(30, 1)} and letters.rdd.getNumPartitions() >= 10


def test_restarted_stream_goes_on(spark, tmp_path):
    run = inc.Incremental(spark, str(tmp_path / "out"), ("k",), "k INT", "y INT", work)
    for part in ([(1, 1)], [(1, 1), (2, 2)]):
        spark.createDataFrame(part, "k INT, x INT").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):
            run.run(spark.readStream.schema("k INT, x INT").parquet(str(tmp_path / "in")), str(tmp_path / "c"))
    assert sorted(r["k"] for r in run.done().collect()) == [1, 2] and run.tallies().agg(F.sum("skipped")).first()[0] == 1


def test_lost_outputs_and_wrong_numbers(spark):
    items = spark.createDataFrame([(i,) for i in range(5)], "k INT")
    marks = spark.createDataFrame([(0, "completed"), (1, "completed"), (2, "skipped"), (3, "failed")], "k INT, status STRING")
    outputs = spark.createDataFrame([(0,), (0,), (3,)], "k INT")
    assert sorted(r["k"] for r in inc.still_to_do(items, marks, outputs, ["k"]).collect()) == [1, 3, 4]
    segments = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "s STRING, n INT")
    assert inc.picked(segments, ["s"], "n").where("error IS NULL").count() == 3
    assert {(r["s"], r["n"], r["error"]) for r in inc.picked(segments, ["s"], "n", 2).collect()} == {("a", 2, None), ("b", None, "segment 2 is out of range")}
