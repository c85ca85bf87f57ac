import random

import pytest
from pyspark.sql import functions as F

from storyloom.llm import mixing
from storyloom.llm.common import word_count


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        if not free:
            return held
        rate = (total - sum(held.values())) / sum(w[s] for s in free)
        over = [s for s in free if rate * w[s] > cap * sizes[s]]
        if not over:
            return held | {s: rate * w[s] for s in free}
        held |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 50, None: 7}, {"a": 1, "b": 1000}, {"x": 5}, {"a": 0, "b": 3}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source STRING, source_size LONG")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix_meets_targets_and_caps(spark):
    rng = random.Random(1)
    data = [(i, rng.choice(["hot", "hot", "hot", "b", "c", None]), rng.randint(0, 300)) for i in range(800)] + [(5, "b", 40), (5, "b", 40)]
    df = spark.createDataFrame(data, "doc_id LONG, source STRING, size LONG")
    mixed = mixing.mix(df)
    taken = mixing.taken_words(mixed).collect()
    assert len(taken) == len(data) and all(0 <= r["taken"] <= 3 * r["size"] for r in taken)
    for s in ("hot", "b", "c", None):
        own = [r for r in taken if r["source"] == s]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], rel=0.02, abs=2)
        assert own[0]["source_size"] == sum(d[2] for d in data if d[1] == s)
    again = mixing.taken_words(mixing.mix(df)).select("doc_id", "source", "size", "taken").collect()
    assert sorted(map(str, again)) == sorted(map(str, [r.__class__(**{k: r[k] for k in ("doc_id", "source", "size", "taken")}) for r in taken]))


def test_pieces_are_the_blocks_of_the_schedule(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], 10 + i) for i in range(60)], "doc_id LONG, source STRING, size LONG")
    mixed = mixing.mix(df, block_words=16)
    rows = mixing.pieces(mixed).collect()
    slots = {r["slot"]: r["source"] for r in mixed["schedule"].collect()}
    assert all(slots[r["slot"]] == r["source"] and 0 < r["n_words"] <= 16 and r["from_word"] + r["n_words"] <= r["size"] for r in rows)
    early = [slots[k] for k in sorted(slots)][:70]
    assert early.count("a") == pytest.approx(50, abs=3)  # weights 5 and 2 hold in every stretch


def test_odd_documents(docs, none):
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), "shard")
    assert mixing.taken_words(mixing.mix(sized)).count() == docs.count()
    assert mixing.taken_words(mixing.mix(none.select("doc_id", "source", F.lit(1).cast("long").alias("size")))).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.where("text is null or trim(text) = ''").count() == 0


def test_small_sources_meet_their_targets_in_large_blocks(spark):
    small = {"s10": 10, "s50": 50, "s200": 200, "s300": 300}
    df = spark.createDataFrame([(i, "big", 300) for i in range(700)] + [(1000 + n, s, n) for s, n in small.items()], "doc_id LONG, source STRING, size LONG")
    mixed = mixing.mix(df, block_words=256)
    taken = {r["source"]: r["taken"] for r in mixing.taken_words(mixed).where("source <> 'big'").collect()}
    assert taken == {s: 3 * n for s, n in small.items()}
    slots = [r["slot"] for r in mixed["schedule"].collect()]
    assert len(slots) == len(set(slots))
