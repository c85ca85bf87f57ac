"""The rule ensemble: statistics by hand, rules against trees, the lasso by its optimality, held-out accuracy."""

import math

import numpy as np
from pyspark.sql import functions as F

from storyloom.llm import rulefit

BIG = "/root/testdata/sf0.01"


def by_hand(text):
    words = [w for w in text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    lines = [tuple(ws) for x in text.split("\n") if (ws := [w for w in x.split() if w])]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else []
    n = len(words)
    return {
        "words": n,
        "word_length": sum(len(w.encode()) for w in words) / n,
        "longest_word": max(len(w.encode()) for w in words),
        "distinct_words": len(set(words)) / n,
        "top_word": max(map(words.count, words)) / n,
        "repeated_windows": (len(windows) - len(set(windows))) / n,
        "lines": len(lines),
        "repeated_lines": (len(lines) - len(set(lines))) / len(lines),
        "line_words": n / len(lines),
        "symbols": sum(c in "#*$%&|<>" for c in text) / n,
        "marked_words": sum(w[-1] in "#*$%&|<>!" for w in words) / n,
        "entropy": -sum(p * math.log2(p) for b in set(text.encode()) for p in [text.encode().count(b) / len(text.encode())]),
    }


def test_statistics():
    for text in ("a b c a b c a b c d", "one\n\n two two \r\n two  two\nÜber# x$ !\n", "word", "x\n" * 40, "Größe 12,5 % – ja! ja!"):
        got = dict(zip(rulefit.STATISTICS, rulefit.statistics(text)))
        for name, want in by_hand(text).items():
            assert math.isclose(got[name], want, abs_tol=1e-12), (text, name)
    assert not any(rulefit.statistics(None) + rulefit.statistics("") + rulefit.statistics(" \n\t"))


def sample(n=600, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(rulefit.STATISTICS)))
    return x, ((x[:, 2] > 0.4) & (x[:, 5] <= 0.7)).astype(float)


def test_rules_are_tree_paths():
    """Every path's rule holds for just the rows that the tree sends along it."""
    x, y = sample()
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1], method="lower")) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    paths, value = rulefit.grow(bins, y - 0.5, np.full(len(y), 0.25), 3, 5, 32)
    assert len(paths) % 2 == 0 and {len(p) for p in paths} <= {1, 2, 3}
    for path in paths:
        inside = np.all([(bins[:, f] > c) == above for f, c, above in path], axis=0)
        raw = np.all([(x[:, f] > edges[f][c]) == above for f, c, above in path], axis=0)
        assert (inside == raw).all() and inside.any()
    assert ((value > 0) == (y == 1)).mean() > 0.95


def test_best_split_against_all_splits():
    rng = np.random.default_rng(0)
    bins, g, h = rng.integers(0, 6, (80, 3)), rng.normal(size=80), rng.random(80) + 0.1
    paths, _ = rulefit.grow(bins, g, h, 1, 5, 6)

    def gain(f, c):
        left = bins[:, f] <= c
        if left.sum() < 5 or (~left).sum() < 5:
            return -1.0
        return sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left))

    best = max(((f, c) for f in range(3) for c in range(5)), key=lambda fc: gain(*fc))
    assert gain(*paths[0][0][:2]) == gain(*best)


def test_lasso_meets_its_optimality_conditions():
    x, y = sample()
    y = np.where(np.random.default_rng(1).random(len(y)) < 0.1, 1 - y, y)
    r = rulefit.fires(x, rulefit.extract_rules(x, y, trees=10)).astype(float)
    penalties = np.array([0.1, 0.02])
    w, b = rulefit.lasso(r, y, penalties, rounds=3000)
    spread = np.maximum(r.std(0), 0.02)
    for penalty, wi, bi in zip(penalties, w, b):
        miss = 1 / (1 + np.exp(-(r @ wi + bi))) - y
        slope = ((r - r.mean(0)) / spread).T @ miss / len(y)
        on = np.abs(wi) > 1e-9
        assert abs(miss.mean()) < 1e-4 and np.abs(slope).max() < penalty + 1e-4
        assert np.allclose(slope[on], -penalty * np.sign(wi[on]), atol=1e-4)
    assert (np.abs(w[0]) > 1e-9).sum() < (np.abs(w[1]) > 1e-9).sum()


def test_learns_a_conjunction_and_is_sparse():
    x, y = sample(2000)
    model = rulefit.learn(x, y)
    new, truth = sample(1000, seed=9)
    assert ((model.score(new) >= 0.5) == truth).mean() > 0.95 and 0 < len(model.rules) < 80


def test_column_equals_numpy(spark):
    x, y = sample(800)
    model = rulefit.learn(x, y)
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], list(rulefit.STATISTICS))
    got = [r["score"] for r in df.select(model.column(F.col).alias("score")).collect()]
    assert np.allclose(sorted(got), sorted(model.score(x)), atol=1e-12)


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{BIG}/labels.parquet").where("quality is not null")
    rows = rulefit.op13_classify_quality(spark, BIG).where("held_out").join(labels, "doc_id").collect()
    for y in (0, 1):
        assert np.mean([r["predicted"] == y for r in rows if r["quality"] == y]) > 0.95, y
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_learns_from_the_others_only(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    changed = labels.withColumn("quality", F.when(rulefit.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    shuffled = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("s")}).orderBy(F.rand(1))
    assert rulefit.fit(docs, labels) == rulefit.fit(shuffled, changed)


def test_odd_documents(docs, none, spark):
    labels = spark.createDataFrame([(5, 1), (8, 0), (None, 1), (1, 0), (9, None), (4, 7)], "doc_id long, quality int")
    model = rulefit.fit(docs, labels)
    rows = rulefit.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    nothing = rulefit.fit(docs, labels.limit(0))
    assert {r["score"] for r in rulefit.score(docs, nothing).collect()} == {0.5}
    assert rulefit.score(none, model).count() == 0 and rulefit.fit(none, labels).rules == ()
    assert not spark.range(1).select(rulefit.held_out(F.lit(None).cast("long"))).first()[0]
