import numpy as np
import pytest

from storyloom.llm import ann

KIND = "vec_id LONG, embedding ARRAY<FLOAT>, rank STRING, score STRING"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else [None if x is None else float(x) for x in v], "r", "s") for i, v in zip(ids if ids is not None else range(len(vectors)), vectors)], KIND)


def brute(vectors, ids, asked, k=5):
    x = np.array(vectors, dtype=np.float32).astype(float)
    n = np.sqrt((x * x).sum(1))
    out = {}
    for q in asked:
        s = (x * x[q]).sum(1) / (n * n[q])
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[ids[q]] = [(ids[i], s[i]) for i in order]
    return out


def test_recall_order_and_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64))
    x[100:140] = x[100] + 0.01 * rng.standard_normal((40, 64))
    ids = np.arange(3000)
    df = table(spark, x)
    rows = ann.nearest(df, df.where("vec_id % 50 = 0"), block=700).collect()
    true, got = brute(x, ids, range(0, 3000, 50)), {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(true) and all(len(v) == 5 for v in got.values())
    hit = [len({a for a, _ in got[q]} & {a for a, _ in true[q]}) / 5 for q in true]
    assert np.mean(hit) >= 0.9
    exact = {(q, a): s for q in true for a, s in true[q]}
    for q, found in got.items():
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
        assert all(abs(exact[q, a] - s) < 1e-12 for a, s in found if (q, a) in exact)


def test_ties_go_to_the_smaller_id_whatever_the_blocks(spark):
    rng = np.random.default_rng(2)
    same = rng.standard_normal(16)
    x = [same] * 400 + list(rng.standard_normal((100, 16)))
    df = table(spark, x)
    rows = ann.nearest(df, df.where("vec_id IN (0, 50, 399)"), block=64).orderBy("query_id", "rank").collect()
    got = {q: [r["vec_id"] for r in rows if r["query_id"] == q] for q in (0, 50, 399)}
    assert got == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 399: [0, 1, 2, 3, 4]}


@pytest.mark.parametrize("n", [1, 2, 4])
def test_fewer_rows_than_asked(spark, n):
    df = table(spark, np.eye(4)[:n] + 0.1)
    assert ann.nearest(df, df).count() == n * (n - 1)


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    data = [[1, 0], [0.5, 0.1], None, [0, 0], [nan, 1], [inf, 1], [1, None], [1, 2, 3], [], [-1, 0]]
    df = table(spark, data)
    assert {(r["query_id"], r["vec_id"]) for r in ann.nearest(df, df).collect()} == {(a, b) for a in (0, 1, 9) for b in (0, 1, 9) if a != b}
    empty = df.limit(0)
    assert ann.nearest(empty, empty).count() == 0 and ann.nearest(df, empty).count() == 0


def test_rotation_keeps_lengths():
    x = np.random.default_rng(3).standard_normal((7, 50))
    assert np.allclose(np.linalg.norm(ann.rotate(x, 2), axis=1), np.linalg.norm(x, axis=1))


def test_repeated_rows_count_once(spark):
    x = np.random.default_rng(4).standard_normal((60, 16))
    ids = np.repeat(np.arange(60), 6)
    df = table(spark, np.repeat(x, 6, axis=0), ids)
    rows = ann.nearest(df, df.where("vec_id IN (0, 7)"), probes=64).orderBy("query_id", "rank").collect()
    true = brute(x, np.arange(60), (0, 7))
    assert {q: [r["vec_id"] for r in rows if r["query_id"] == q] for q in true} == {q: [i for i, _ in v] for q, v in true.items()}
    found = ann.exact_nearest(ann.usable(df, 16), [(0, x[0].tolist())], 5)
    assert {i for _, i, _ in found} == {i for i, _ in true[0]}


def test_doubles_whose_squares_overflow(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 8))
    big = x * 10.0 ** rng.integers(-200, 200, 300)[:, None]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(big)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    rows = ann.nearest(df, df.where("vec_id % 50 = 0"), block=64, tables=4).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(rows) == 30 and all(abs(unit[r["query_id"]] @ unit[r["vec_id"]] - r["score"]) < 1e-12 for r in rows)


def test_recall_on_queries_that_did_not_set_the_probes(spark):
    """The probes come from a sample of some queries; recall holds on the others."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((60, 32))
    x = (centres[rng.integers(0, 60, 2500)] + 0.6 * rng.standard_normal((2500, 32))).astype(np.float32)
    df = table(spark, x)
    probes = ann.probes_for(ann.usable(df, 32), ann.usable(df.where("vec_id % 50 = 0"), 32), 5, 8, 0.96, 128)
    others = df.where("vec_id % 50 = 7")
    true, got = brute(x, np.arange(2500), range(7, 2500, 50)), {}
    for r in ann.nearest(df, others, probes=probes, block=700).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & {a for a, _ in true[q]}) / 5 for q in true]) >= 0.9
