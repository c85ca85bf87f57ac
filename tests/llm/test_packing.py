import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from storyloom.llm import packing


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(packing.tokenizer_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_encoder_equals_tokenizers(reference):
    encode, rng = packing.encoder(packing.tokenizer_path()), random.Random(3)
    signs = " \t\n\x0b\r\x1c\x85 　aeZé19²'slve!._日本🙂"
    texts = ["", "<|endoftext|>", "a" * 5000, " " * 3000, *("".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(400))]
    assert all(encode(t).tolist() == reference(t) for t in texts)


@pytest.mark.parametrize("run", [" ", "\t", "\n", " \u3000"])
def test_runs_of_two_million_white_spaces(reference, run):
    encode = packing.encoder(packing.tokenizer_path())
    for text in (run * (2_000_000 // len(run)), "a" + run * (2_000_000 // len(run)) + "word"):
        assert np.array_equal(encode(text), reference(text))


def brute_exact(have, length, capacity):
    """Whether one to three further pieces fill the gap beside one of that length."""
    left = dict(have)
    left[length] -= 1
    gap, flat = capacity - length, [x for x, n in left.items() for _ in range(min(n, 3))]
    return any(sum(c) == gap for k in (1, 2, 3) for c in itertools.combinations(flat, k))


@pytest.mark.parametrize("seed", range(40))
def test_no_exact_filling_is_missed(seed):
    """Sequences that are not full come only after no available length has an exact filling, longest first."""
    rng, capacity = random.Random(seed), 40
    counts = {}
    for _ in range(rng.randint(1, 14)):
        n = rng.randint(1, capacity)
        counts[n] = counts.get(n, 0) + rng.choice([1, 1, 2, 5])
    have = dict(counts)
    made = [parts for parts, n in packing.plan(dict(counts), capacity) for _ in range(n)]
    for parts in made:
        longest = max(x for x, n in have.items() if n)
        if sum(parts) == capacity and 1 < len(parts) <= 4:
            assert brute_exact(have, parts[0], capacity)
        elif len(parts) == 1 and parts[0] < capacity:
            assert parts[0] <= longest and not brute_exact(have, parts[0], capacity)
        for x in parts:
            have[x] -= 1
    assert not any(have.values())


def test_pieces_and_sequences(spark, docs, reference):
    packed = packing.pack_documents(docs, with_ids=True).collect()
    by_doc = {}
    for r in packed:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 2048
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in ((1, ""), (8, docs.where("doc_id = 8").first()["text"]), (9, docs.where("doc_id = 9").first()["text"])):
        parts = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [x for r in parts for x in r["ids"]] == [*reference(text), 0]
        assert [r["start"] for r in parts] == [sum(p["length"] for p in parts[:i]) for i in range(len(parts))] and all(r["length"] == 2048 for r in parts[1:])
    assert len(by_doc[4]) == 2 and len(by_doc[None]) == 1
    rows = {}
    for r in packed:
        rows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in rows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_table(none):
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_near_the_bound(seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(rng.choice([1, 50, 3000])):
        n = min(2047, max(1, int(rng.lognormvariate(6, 1))))
        counts[n] = counts.get(n, 0) + 1
    made = packing.plan(dict(counts))
    used = {}
    for parts, times in made:
        assert times > 0 and sum(parts) <= 2048
        for x in parts:
            used[x] = used.get(x, 0) + times
    assert used == counts
    bound = -(-sum(k * v for k, v in counts.items()) // 2048)
    assert sum(t for _, t in made) <= max(bound * 1.01 + 2, sum(v for k, v in counts.items() if k > 1024))


def test_exact_complements_are_found():
    made = dict(packing.plan({1000: 5, 1048: 5, 2000: 1, 20: 2, 8: 1}))
    assert made == {(1048, 1000): 5, (2000, 20, 20, 8): 1}


def test_sequences_hold_ids(spark, docs):
    packed = packing.pack_documents(docs, with_ids=True)
    assert packing.sequences(packed).selectExpr("max(size(ids)) AS m").first()["m"] <= 2048
