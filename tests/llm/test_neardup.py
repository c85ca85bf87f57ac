import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import hashing, neardup


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def runs(text, n=5):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def classes(texts, least=0.8):
    """Brute force: least id of each connected component of pairs of at least that similarity."""
    sets, parent = {k: runs(v) for k, v in texts.items()}, {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both >= least * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def corpus(seed, groups=6, size=40):
    """Groups of near copies, a passage that many texts share, and texts of their own."""
    rng, texts, k = random.Random(seed), {}, 0
    word = lambda: f"w{rng.randint(0, 5000)}"
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(size):
            copy = base[:]
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = word()
            texts[k] = " ".join(copy)
            k += 1
    passage = [word() for _ in range(60)]
    for _ in range(size * 2):
        texts[k] = " ".join([word() for _ in range(30)] + passage + [word() for _ in range(10)])
        k += 1
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING")
    rows = neardup.near_duplicates(df, block=8).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == classes(texts)
    assert sum(r["kept"] for r in rows) == len({r["class_id"] for r in rows})


def test_odd_documents(docs, none):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert by[1] == {1} and by[2] == {2} and by[3] == {3} and by[4] == {4} and by[5] == by[6] == by[7] == {5}
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["None", "1", "2", "3", "4", "5", "8", "9"])


def test_shingles_equal_runs():
    for text in ("", "a", "a b c d", "a b c d e f", " x\ty\nz\x0bq\x0cr\rs ", "é ü 🙂 日本 \x1c x " * 50, "w" * 3_000_000 + " x"):
        assert len(hashing.shingles(text)) == len(runs(text))


@pytest.mark.parametrize("share", [0.5, 0.8, 0.95])
def test_signatures_estimate_jaccard(share):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    same = int(900 * 2 * share / (1 + share))
    b = np.concatenate([a[:same], rng.integers(0, 2**63, 900 - same).astype(np.uint64)])
    assert np.mean(hashing.dart_signature(a, 4096) == hashing.dart_signature(b, 4096)) == pytest.approx(same / (1800 - same), abs=0.03)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    e, w = rng.integers(0, 2**63, 500).astype(np.uint64), rng.random(500) * 4
    v = w * rng.random(500)
    got = np.mean(hashing.dart_signature(e, 4096, w) == hashing.dart_signature(e, 4096, v))
    assert got == pytest.approx(np.minimum(w, v).sum() / np.maximum(w, v).sum(), abs=0.03)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a LONG, b LONG").where(F.col("a") != F.col("b"))
    got = {r["node"]: r["label"] for r in neardup.components(df).collect()}
    assert all(got[n] == find(n) for n in got) and {n for n in parent if find(n) != n} == set(got)


def test_null_id_joins_its_near_copies(spark):
    words = [f"a{i}" for i in range(200)]
    base, near = " ".join(words), " ".join(words[:100] + ["other"] + words[101:])
    df = spark.createDataFrame([(None, base), (3, base), (5, near), (None, "x y z"), (7, " ".join(f"b{i}" for i in range(50)))], "doc_id LONG, text STRING")
    got = neardup.near_duplicates(df).collect()
    assert sorted((str((r["doc_id"], r["class_id"], r["kept"])) for r in got)) == sorted(map(str, [(None, 3, False), (3, 3, True), (5, 3, False), (None, None, True), (7, 7, True)]))
    alone = neardup.near_duplicates(df.where("doc_id is null or doc_id = 5")).collect()
    assert sum(r["class_id"] == 5 for r in alone) == 2


def test_crowded_key_parts_no_similar_pair(spark):
    """Pairs that agree in the crowded key alone still share a key after it is split."""
    rng = random.Random(7)
    sets = {}
    for i in range(0, 40, 2):
        base = [rng.randint(100, 10**9) for _ in range(90)] + list(range(10))
        sets[i], sets[i + 1] = base, base[:80] + [rng.randint(100, 10**9) for _ in range(10)] + list(range(10))
    table = spark.createDataFrame([(k, sorted(set(v))) for k, v in sets.items()], "node LONG, shingles ARRAY<LONG>")
    members = spark.createDataFrame([(1, k, len(set(v))) for k, v in sets.items()], "key LONG, node LONG, n LONG")
    by = {}
    for r in neardup._split(members, table, 0.8, 8).collect():
        by.setdefault(r["node"], set()).add(r["key"])
    assert all(by[i] & by[i + 1] for i in range(0, 40, 2)) and not by[0] & by[2]
