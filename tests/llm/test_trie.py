"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import random
from binascii import crc32

import pytest
from pyspark.sql import functions as F

from storyloom.llm import trie
from storyloom.tables import materialize


def brute(sequences):
    """sequences: {conv_id: [(role, text)]}. The rows of NODE."""
    members = {}
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        inner = [below(x) for x in children.get(p, [])]
        own = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        return sum(x[0] for x in inner) or 1, own + sum(x[1] for x in inner)

    out = []
    for p, ids in members.items():
        ends = sorted(c for c in ids if len(sequences[c]) == len(p))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(children.get(p, [])), *below(p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def nodes(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[1], r[0]))


def built(spark, sequences, **more):
    kinds = {t: i for i, t in enumerate(sorted({t for s in sequences.values() for t in s}))}
    rows = [(c, i, kinds[t], len(t[1].encode())) for c, s in sequences.items() for i, t in enumerate(s)]
    rows = materialize(spark.createDataFrame(rows, "conv_id long, pos long, id long, bytes long"), "rows")
    totals = spark.createDataFrame([(c, len(s)) for c, s in sequences.items()], "conv_id long, total long")
    return nodes(trie.prefix_trie(rows, totals, **more))


@pytest.mark.parametrize("local_rows", [0, 6, 10_000])
def test_random_conversations(spark, local_rows):
    rng = random.Random(local_rows)
    sequences = {c: [("u", rng.choice("aab")) for _ in range(rng.randint(0, 5))] for c in range(-20, 40)}
    hot = [("u", "é" * 3)] * 9
    sequences |= {100 + i: hot for i in range(12)} | {200 + i: hot + [("a", str(i % 3))] * 2 for i in range(9)}
    assert built(spark, sequences, local_rows=local_rows) == brute(sequences)


def test_all_alike_and_alone(spark):
    for sequences in ({7: []}, {7: [("u", "x")]}, {c: [("u", "x")] * 4 for c in range(30)}, {c: [] for c in range(3)}):
        assert built(spark, sequences, local_rows=3) == brute(sequences)


def test_quicksort_alone():
    rng = random.Random(5)
    sequences = {c: [("u", rng.choice("abc")) for _ in range(rng.randint(1, 6))] for c in range(200)}
    found = trie.multikey_quicksort([(c, [ord(t) for _, t in s], [1] * len(s)) for c, s in sequences.items()], 0)
    want = {(r[0], r[1], r[3], r[4]) for r in brute(sequences) if r[1]}
    assert {(n[0], n[1], n[3], n[4]) for n in found} == want and len(found) == len(want)


def by_hand(rows):
    """The contract's rebuilt conversations."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, s in own.items():
        h = crc32(str(c).encode()) % 9
        base = c - int(c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + s[h:]
    return out


def test_whole_operator(spark, tmp_path):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", None, "assistant"]), rng.choice(["hi", "", None, "yes", "né"])) for c in range(-12, 30) for t in range(rng.randint(0, 12))]
    rows += [(3, None, "user", "first"), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a"), (None, 1, "user", "lost"), (10**12, 0, None, "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit("x"), "id": F.lit("y"), "depth": F.lit(0)})
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert nodes(trie.op12_prefix_trie(spark, str(tmp_path))) == brute(by_hand(rows))


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert trie.op12_prefix_trie(spark, str(tmp_path)).count() == 0


def test_joined_hashes_of_many_ids(spark):
    ends = spark.range(5000).selectExpr("0 AS bucket", "2 AS depth", "id AS conv_id").union(spark.createDataFrame([(1, 2, -5), (1, 2, 4)], "bucket long, depth long, conv_id long"))
    got = {r["bucket"]: r["ends_sha256"] for r in trie.joined_hashes(ends, piece=50).collect()}
    assert got == {0: hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest(), 1: hashlib.sha256(b"-5,4").hexdigest()}
