"""Signals in blocks against numpy on whole arrays."""

import re
from collections import Counter
from glob import glob

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators import signals as g
from storyloom.plans import catalogue

BLOCK = "k INT, at LONG, samples ARRAY<DOUBLE>"


def blocks(spark, signals, cuts):
    """signals: {key: array}, cut at the given places."""
    rows = []
    for k, x in signals.items():
        edges = sorted({0, len(x), *(c for c in cuts if c < len(x))})
        rows += [(k, a, x[a:b].tolist()) for a, b in zip(edges, edges[1:])]
    return spark.createDataFrame(rows, BLOCK)


def whole(df):
    out = {}
    for r in df.orderBy("k", "at").collect():
        part = out.setdefault(r["k"], [])
        assert len(part) == r["at"]
        part += r["samples"]
    return out


def by_numpy(x, rate, to):
    n = len(x) if rate == to else int(round(len(x) * to / rate))
    if rate == to or not n:
        return x[:n]
    return np.interp(np.linspace(0.0, len(x) - 1, n) if len(x) > 1 else np.zeros(n), np.arange(len(x)), x)


@pytest.mark.parametrize("cuts", [(), (1, 2, 3, 50, 51, 99), tuple(range(0, 400, 7))])
@pytest.mark.parametrize("rate,to", [(8, 8), (8, 22), (22, 8), (1000, 3), (7, 13)])
def test_resampling(spark, rate, to, cuts):
    rng = np.random.default_rng(1)
    signals = {i: rng.normal(size=n) for i, n in enumerate((1, 2, 3, 100, 333, 400))}
    got = whole(g.resampled(blocks(spark, signals, cuts), ["k"], F.lit(rate), F.lit(to)))
    for k, x in signals.items():
        want = by_numpy(x, rate, to)
        assert len(got.get(k, [])) == len(want) and np.allclose(got.get(k, []), want, atol=1e-12)


def test_fades(spark):
    def by_hand(x, sr, a, b):
        out, n = x.copy(), len(x)
        for seconds, up in ((a, True), (b, False)):
            m = min(max(0, int(round(seconds * sr))), n)
            if m > 1:
                ramp = np.linspace(0, 1, m) if up else np.linspace(1, 0, m)
                out[slice(0, m) if up else slice(n - m, n)] *= ramp
        return out

    signals = {i: np.ones(n) for i, n in enumerate((1, 2, 10, 100))}
    for a, b in ((0.0, 0.0), (0.3, 0.1), (9.0, 9.0), (0.01, 0.2), (-1.0, 0.05)):
        got = whole(g.faded(blocks(spark, signals, (3, 50)), ["k"], F.lit(100), F.lit(a), F.lit(b)))
        assert all(np.allclose(got[k], by_hand(x, 100, a, b), atol=1e-12) for k, x in signals.items())


def test_overlap_add_equals_a_dense_sum(spark):
    rng = np.random.default_rng(3)
    rows, dense = [], np.zeros((3, 4000))
    for _ in range(200):
        k, at, x = int(rng.integers(3)), int(rng.integers(-50, 3000)), rng.normal(size=rng.integers(0, 900))
        rows.append((k, at, x.tolist()))
        if len(x) and at + len(x) > 0:
            dense[k, max(0, at) : at + len(x)] += x[max(0, -at) :]
    pieces = spark.createDataFrame(rows, BLOCK)
    for size in (7, 256, 10_000):
        total = np.zeros((3, 20_000))
        for r in g.overlap_add(pieces.repartition(5), ["k"], size).collect():
            assert r["at"] % size == 0 and len(r["samples"]) == size
            total[r["k"], r["at"] : r["at"] + size] += r["samples"]
        assert np.allclose(total[:, :4000], dense, atol=1e-9) and not total[:, 4000:].any()
    assert g.overlap_add(pieces.limit(0), ["k"]).count() == 0


def test_drawn_samples_at_their_levels(spark):
    places = spark.createDataFrame([(1, 0, 3, 5, 2.0), (1, 3, 2, 5, 2.0), (2, -1, 4, 0, None), (3, 0, 0, 9, 1.0)], "k INT, at LONG, n INT, s LONG, level DOUBLE")
    got = g.drawn(places, ["k", "level"], "n", lambda i, s: i * 1.0 + s, ["s"])
    assert sorted((r["k"], r["at"], r["samples"]) for r in got.collect()) == [(1, 0, [5.0, 6.0, 7.0]), (1, 3, [8.0, 9.0]), (2, -1, [-1.0, 0.0, 1.0, 2.0])]
    mixed = {(r["k"], r["at"]): r["samples"] for r in g.overlap_add(got.where("k = 1"), ["k"], 4, "level").collect()}
    assert mixed == {(1, 0): [10.0, 12.0, 14.0, 16.0], (1, 4): [18.0, 0.0, 0.0, 0.0]}
    gaps = spark.createDataFrame([(1, None, [1.0]), (1, 0, None), (1, 1, [2.0])], "k INT, at LONG, samples ARRAY<DOUBLE>")
    assert [r["samples"] for r in g.overlap_add(gaps, ["k"], 2).collect()] == [[0.0, 2.0]]


def test_levels_and_limits(spark):
    signals = {1: np.array([0.5, -1.0, 0.25]), 2: np.zeros(5)}
    got = {r["k"]: r for r in g.levels(blocks(spark, signals, (1,)), ["k"]).collect()}
    assert got[1]["peak_db"] == 0 and not got[1]["silent"] and np.isclose(got[1]["rms"], np.sqrt(np.mean(signals[1] ** 2)))
    assert np.isclose(got[2]["peak_db"], -180) and got[2]["silent"] and got[2]["n"] == 5
    df = spark.createDataFrame([(1.0, 0.4, 0.6, 0.2), (0.1, 0.4, 0.6, 0.1), (1.0, 0.0, 0.6, 0.6), (1.0, 9.0, 0.6, 0.6), (1.0, 0.0, -1.0, 0.0)], "l DOUBLE, p DOUBLE, c DOUBLE, want DOUBLE")
    assert df.where(g.limited(F.col("l"), F.col("p"), F.col("c")) != F.col("want")).count() == 0
    times = spark.createDataFrame([(3.0, 1.0, 9.0, 3.0), (None, 1.0, 9.0, 10.0), (None, None, 9.0, 9.0), (None, 1.0, None, 1.0)], "s DOUBLE, o DOUBLE, g DOUBLE, want DOUBLE")
    assert times.where(g.event_start(F.col("s"), F.col("o"), F.col("g")) != F.col("want")).count() == 0


def test_effects_from_file_to_place(spark):
    x = np.sin(np.arange(300) / 9)
    ev = spark.createDataFrame([(1, None, 0.5, 2.0, 0.8, 0.0), (2, 0.25, None, None, 0.1, 0.1), (3, None, None, None, 0.0, 9.0)], "id INT, start_time DOUBLE, offset DOUBLE, segment_start DOUBLE, volume DOUBLE, duration DOUBLE")
    sound = spark.createDataFrame([(i, 1000, a, x[a : a + 128].tolist()) for i in (1, 2, 3) for a in (0, 128, 256)], "id INT, rate INT, at LONG, samples ARRAY<DOUBLE>")
    got = {}
    for r in g.effects(ev, sound, "id", 500, F.lit(0.5), F.lit(0.6)).orderBy("id", "at").collect():
        got.setdefault(r["id"], []).append(r)
    y = by_numpy(x, 1000, 500)
    edge = np.ones(len(y))
    edge[:10] *= np.linspace(0, 1, 10)
    edge[-10:] *= np.linspace(1, 0, 10)
    assert got[1][0]["at"] == 1250 and np.allclose(sum((r["samples"] for r in got[1]), []), y * edge * 0.25)
    assert got[2][0]["at"] == 125 and sum(len(r["samples"]) for r in got[2]) == 50
    third = sum((r["samples"] for r in got[3]), [])
    assert len(third) == 4500 and not any(third)


def moved(spark, df):
    """The columns of each exchange in the plan, where no join broadcasts a side."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return [re.findall(r"(\w+)#", x) for x in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)]


def test_effects_move_their_samples_once(spark):
    ev = spark.createDataFrame([(1, None, 0.5, 2.0, 0.8, 0.0)], "id INT, start_time DOUBLE, offset DOUBLE, segment_start DOUBLE, volume DOUBLE, duration DOUBLE")
    sound = spark.createDataFrame([(1, 1000, 0, [1.0])], "id INT, rate INT, at LONG, samples ARRAY<DOUBLE>")
    assert sum("samples" in columns for columns in moved(spark, g.effects(ev, sound, "id", 500, F.lit(0.5), F.lit(0.6)))) == 1


def test_drawn_effects_are_effects_of_drawn_sounds(spark):
    rng = np.random.default_rng(5)
    lengths, rates, wanted = (1, 2, 3, 10, 11, 20, 21, 95, 300), (250, 500, 1300), (None, 0.0, 0.002, 0.03, 9.5)
    rows = [(i, n, rate, i % 4, None if i % 3 else i / 9 - 1, 0.25, i % 5 * 1.0, float(rng.random() - 0.1), d) for i, (n, rate, d) in enumerate((n, r, d) for n in lengths for r in rates for d in wanted)]
    ev = spark.createDataFrame(rows + [(-1, 0, 500, 0, 0.0, 0.0, 0.0, 1.0, 1.0), (-2, None, 500, 0, 0.0, 0.0, 0.0, 1.0, 1.0)], "id INT, n INT, rate INT, s INT, start_time DOUBLE, offset DOUBLE, segment_start DOUBLE, volume DOUBLE, duration DOUBLE")
    value = lambda i, s: np.sin(i * 1.7 + s)
    sound = spark.createDataFrame([(r[0], r[2], a, value(np.arange(a, min(a + 10, r[1])), r[3]).tolist()) for r in rows for a in range(0, r[1], 10)], "id INT, rate INT, at LONG, samples ARRAY<DOUBLE>")
    got, want = ({k: {} for k in range(len(rows))} for _ in range(2))
    for held, df in ((got, g.drawn_effects(ev, ["id"], 500, F.lit(0.7), F.lit(0.6), 10, value, ["s"])), (want, g.effects(ev.drop("rate"), sound, "id", 500, F.lit(0.7), F.lit(0.6)))):
        for r in df.collect():
            assert not set(held[r["id"]]) & set(range(r["at"], r["at"] + len(r["samples"])))
            held[r["id"]].update(enumerate(r["samples"], r["at"]))
    assert got == want and all(bool(want[r[0]]) == (round(r[1] * 500 / r[2]) > 0) for r in rows)
    x = by_numpy(value(np.arange(300), rows[-2][3]), 1300, 500)[:15]
    assert np.allclose([v for _, v in sorted(got[len(rows) - 2].items())], x * np.minimum(1, np.arange(15) / 9) * np.minimum(1, np.arange(15)[::-1] / 9) * max(0.0, min(rows[-2][7], 0.35)))
    twice = g.drawn_effects(ev.union(ev), ["id"], 500, F.lit(0.7), F.lit(0.6), 10, value, ["s"])
    assert Counter(r["id"] for r in twice.collect()) == {k: 2 * n for k, n in Counter(r["id"] for r in g.drawn_effects(ev, ["id"], 500, F.lit(0.7), F.lit(0.6), 10, value, ["s"]).collect()).items()}


def test_effect_mix_moves_sums_alone_and_hears_equal_lines(spark, sf, tmp_path):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    lines.union(lines.limit(500)).write.parquet(str(tmp_path / "lineitem.parquet"))
    before = set(glob(spark.conf.get("spark.checkpoint.dir") + "/storyloom/*"))
    df = catalogue.queries()["effect_mix"](spark, str(tmp_path))
    columns = [sorted(r) for r in moved(spark, df)]
    got = sorted(tuple(r[c] for c in ("track", "at", "total", "peak", "n_sounding")) for r in df.collect())
    assert set(glob(spark.conf.get("spark.checkpoint.dir") + "/storyloom/*")) == before and len(columns) == 1
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.sql(f'SELECT track, "at", total, peak, n_sounding FROM ({catalogue.oracle_sql()["effect_mix"]})').fetchall())
    assert len(got) == len(want) and all(a[:2] == b[:2] and a[4] == b[4] and np.allclose(a[2:4], b[2:4], atol=1e-9) for a, b in zip(got, want))
