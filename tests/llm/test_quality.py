import collections
import random
import re

import numpy as np
import pytest

from storyloom.llm import quality


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    threes = list(zip(w, w[1:], w[2:]))
    often, covered = collections.Counter(threes), set()
    for i, x in enumerate(threes):
        if often[x] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered))


@pytest.mark.parametrize("seed", range(4))
def test_counts_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(80):
        text = "".join(rng.choice(["a", "b ", "c\n", "ü ", "🙂", "\t", "#", "<x>", "\x0b", "\x1c", " the", "a b c "]) for _ in range(rng.randint(0, 200)))
        assert quality.measure(text)[0] == brute(text)


def test_odd_documents(docs, none):
    rows = quality.quality(docs).collect()
    assert len(rows) == docs.count() and quality.quality(none).count() == 0
    long = next(r for r in rows if r["doc_id"] == 8)
    assert tuple(long[c] for c in quality.BASE) == brute(docs.where("doc_id = 8").first()["text"])
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 50)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rows if r["kept"])


def test_distance():
    p = np.array([[1.0, 0.0], [1.0, 1.0], [0.0, 0.0]])
    assert quality.js_distance(p, np.array([0.0, 3.0]))[0] == pytest.approx(1.0)
    assert quality.js_distance(p, np.array([2.0, 2.0]))[1] == pytest.approx(0.0)


def test_clean_stay_and_junk_goes(spark, sf):
    found = quality.op6_quality_rules(spark, "/root/testdata/sf0.01")
    labelled = found.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality"), "doc_id").where("NOT base_failed").collect()
    good = [r["kept"] for r in labelled if r["quality"] == 1]
    bad = [r["kept"] for r in labelled if r["quality"] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.4
