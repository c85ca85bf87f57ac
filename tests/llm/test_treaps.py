"""Ranked search against scores of every document, and the treaps by what they must hold."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from storyloom.llm import treaps

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def words(text):
    return [t.translate(FOLD) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    """(item_id, rank, doc_id, score), all documents scored."""
    have = [(i, Counter(w)) for i, t in docs if (w := words(t))]
    n_docs, n_terms = len(have), sum(sum(c.values()) for _, c in have)
    df = Counter(t for _, c in have for t in c)
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        found = []
        for doc, c in have:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        found.sort(key=lambda x: x[:3])
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(found[:k])]
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def searched(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS rank", "2 AS query")
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 AS doc_id")
    rows = treaps.rank_documents(d, q, **more).collect()
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def corpus(n, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "数字", "A1"]
    return [(int(i) if i % 17 else None, " ".join(rng.choice(vocabulary, size=rng.integers(0, 30), p=np.arange(64, 0, -1) / 2080))) for i in range(n)]


def test_equals_scores_of_all_documents(spark):
    docs = corpus(400) + [(1, None), (2, ""), (3, " .,\t"), (4, "w1 w1 w2"), (4, "w1 w1 w2"), (5, "W1 _w2-" * 5000)]
    items = [(1, "w1 W2 été 数字"), (2, None), (3, "nothing here"), (4, "w9"), (4, "w9 w3"), (None, "a1 w5"), (6, " ".join(f"w{i}" for i in range(60)))]
    for k in (1, 7, 1000):
        assert searched(spark, docs, items, k=k) == brute(docs, items, k)


def test_items_in_blocks_are_alike(spark):
    docs = corpus(200)
    items = [(i, f"w{i} w{i + 1} w{i + 2}") for i in range(20)]
    assert searched(spark, docs, items, k=5, block_bytes=20) == brute(docs, items, 5)


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == [] and searched(spark, [(1, "a b")], []) == [] and searched(spark, [(1, "a b"), (2, "b")], [(1, None)]) == []


def test_shards_are_cut_by_documents_and_bytes(spark):
    docs = spark.createDataFrame(corpus(300), "doc_id long, text string").coalesce(1)
    many = treaps.build_index(docs, shard_docs=50).collect()
    assert len(many) > 4 and all(r["n_docs"] <= 50 for r in many)
    assert len(treaps.build_index(docs, shard_bytes=200).collect()) > len(many)
    assert sum(r["n_docs"] for r in many) == sum(bool(words(t)) for _, t in corpus(300))


@pytest.mark.parametrize("seed", range(4))
def test_treaps_keep_both_orders_and_prune(seed):
    rng = np.random.default_rng(seed)
    n = 3000
    place = np.concatenate([np.sort(rng.choice(n, 900, replace=False)) for _ in range(5)])
    impact = np.floor(rng.exponential(100, len(place))).astype(np.int64) + 1
    shard = treaps.Treaps.build([bytes([i]) for i in range(5)], np.full(5, 900), place, impact)
    for child, sign in ((shard.left, -1), (shard.right, 1)):
        has = np.flatnonzero(child >= 0)
        assert (impact[child[has]] <= impact[has]).all() and (np.sign(place[child[has]] - place[has]) == sign).all()
    best = treaps.Best(1, 10)
    looked = treaps.traverse(shard, [[shard.root[bytes([i])] for i in range(5)]], np.arange(n), np.zeros(n, bool), best, room=64)
    total = np.zeros(n, np.int64)
    np.add.at(total, place, impact)
    want = sorted(((-int(s), d) for d, s in enumerate(total)))[:10]
    assert [(-int(s), int(d)) for s, d in zip(best.score[0], best.doc[0])] == want
    assert looked < len(place) * 2 and treaps.traverse(shard, [[]], np.arange(n), np.zeros(n, bool), treaps.Best(1, 10)) == 0


def test_high_thresholds_leave_subtrees_unread():
    """One document far above all others: with k = 1, most nodes are never looked at."""
    n = 4000
    impact = np.ones(n, np.int64)
    impact[n // 3] = 1000
    shard = treaps.Treaps.build([b"a"], np.array([n]), np.arange(n), impact)
    assert treaps.traverse(shard, [[shard.root[b"a"]]], np.arange(n), np.zeros(n, bool), treaps.Best(1, 1)) <= 3
