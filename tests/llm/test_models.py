"""Classifiers and the language model, by held-out accuracy and by what cannot be otherwise."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import langid, scoring, toxicity

BIG = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang")
    rows = langid.op10_identify_language(spark, BIG).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98 and not any(r["rejected"] for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_learns_from_the_others_only(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    changed = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = (langid.fit(d.select("doc_id", "text", "lang"), per_lang=60) for d in (docs, changed))
    assert a.langs == b.langs and np.array_equal(a.table, b.table)


def test_language_sample_stays_off_the_driver(spark, monkeypatch):
    """What the fit collects is a row a language and the model, however long the texts of its sample are."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text", "lang")
    got, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: got.extend(rows := collect(df)) or rows)
    model = langid.fit(docs)
    most = 4 * langid.BUCKETS * len(model.langs)
    assert got and len(got) <= len(model.langs) + 1
    assert sum(len(v) for r in got for v in r if isinstance(v, (bytes, bytearray))) <= most + 8 * len(model.langs)


def test_language_odd_documents(docs, none):
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    rows = langid.predict(docs, model).collect()
    assert len(rows) == docs.count()
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {1, 2, 3} and all(r["lang_rejected"] for r in rows if r["lang_pred"] == "und")
    empty = langid.fit(none.select("doc_id", "text", "lang"))
    assert empty.langs == () and {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0


def test_only_letters_make_a_language():
    assert not any(map(langid.has_letter, ("", " 12 ", "½ ² Ⅳ", "_!?", "🙂")))
    assert all(map(langid.has_letter, ("1a", "é", "日", " ñ ")))


def test_subwords_do_not_depend_on_chunks(monkeypatch):
    text = "Straße and naïve words " * 400
    whole = langid.histogram(text)
    monkeypatch.setattr(langid, "CHUNK", 1000)
    assert np.allclose(whole, langid.histogram(text), atol=2e-4)


def test_toxicity_held_out(spark):
    """In every language: labelled documents are named rightly, toxic ones found, clean ones left alone."""
    big = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{big}/labels.parquet").where("toxic is not null")
    rows = toxicity.op8_score_toxicity(spark, big).where("held_out").join(labels, "doc_id").join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").select("lang", "toxic", "predicted").collect()
    for lang in ("en", "de", "fr", "es"):
        toxic, clean = ([r["predicted"] for r in rows if r["lang"] == lang and r["toxic"] == y] for y in (1, 0))
        assert np.mean(toxic) >= 0.8 and np.mean(clean) <= 0.05, lang
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.97


def test_toxicity_odd_documents(spark, docs, none):
    labels = spark.createDataFrame([(4, None, 1), (5, 1, 0), (None, 1, 1), (8, None, None)], "doc_id LONG, quality INT, toxic INT")
    for some in (labels, labels.limit(0)):
        model = toxicity.fit(docs, some)
        rows = toxicity.score(docs, model).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert toxicity.score(none, model).count() == 0


def test_grammar_marks_clauses():
    lexicon = toxicity.Lexicon({"idiot": 2.0}, {4: {"scum": 3.0}})
    value = lambda text: dict(zip(toxicity.FEATURES, toxicity.features(text, lexicon)))
    assert value("You are an idiot.")["insult aimed"] == 2.0
    assert value("He is not an idiot.")["insult negated"] == 2.0
    assert value("She said idiot! The scumbag left.")["insult reported"] == 2.0
    assert value("She said idiot! The scumbag left.")["insult"] == 5.0
    assert value("I will kill you")["threat aimed"] == 1.0 and value("said nothing. fine")["clauses"] == 0
    assert value("not here. idiot")["insult negated"] == 0  # a mark ends with its clause


def every_path(machine, symbols, state=None, at=0):
    """(weight, marks) of all paths of a transducer that hold."""
    state = machine.start if at == 0 else state
    if at == len(symbols):
        return [(0.0, ())] if state in machine.finals else []
    return [(arc.weight + w, (arc.marks, *m)) for arc in machine.arcs[state].get(symbols[at], ()) for w, m in every_path(machine, symbols, arc.to, at + 1)]


def marked(symbols):
    """The marks by their definition."""
    out = []
    for i, s in enumerate(symbols):
        near = range(max(0, i - 4), min(len(symbols), i + 5))
        found = {"aimed": any(symbols[j] == "target" for j in near), "negated": "negation" in symbols[max(0, i - 3) : i], "reported": "report" in symbols[:i]}
        out.append({k for k, v in found.items() if v} if s in toxicity.HITS else set())
    return out


def test_grammar_reads_the_heaviest_of_all_paths():
    rng = np.random.default_rng(4)
    for _ in range(400):
        symbols = rng.choice(toxicity.SYMBOLS, rng.integers(1, 9), p=(0.25, 0.15, 0.15, 0.1, 0.1, 0.25)).tolist()
        weight, marks = toxicity.GRAMMAR.reading(symbols)
        paths = every_path(toxicity.GRAMMAR, symbols)
        assert weight == max(w for w, _ in paths) and (weight, tuple(marks)) in paths
        assert [set(m) for m in marks] == marked(symbols)


def test_scoring_odd_documents(docs, none):
    rows = {r["doc_id"]: r for r in scoring.score_documents(docs).collect()}
    assert rows[1]["n_tokens"] == rows[2]["n_tokens"] == rows[3]["n_tokens"] == 0 and rows[1]["log_prob"] == 0 and rows[1]["mean_log_prob"] is None
    assert rows[8]["n_tokens"] == 240_000 and math.isfinite(rows[8]["log_prob"])
    assert scoring.score_documents(none).count() == 0


def learned(spark, docs, known):
    counts = scoring.word_counts(docs).cache()
    words = scoring.vocabulary(counts, known)
    tokens = scoring.materialize(scoring.tokenized(docs, words).withColumn("row", F.monotonically_increasing_id()), "lm")
    return {r["word"]: r["n"] for r in counts.collect()}, counts, words, tokens, scoring.train(tokens, words)


def test_every_word_has_a_probability_of_its_own(spark):
    """All words' probabilities sum to 1 in any window, and a document's score is the sum over its words."""
    texts = [" ".join(f"w{(i * i + j) % 230}" for i in range(300)) for j in range(40)] + [" ".join(f"u{j}" for j in range(k)) for k in (50, 120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    n, counts, words, tokens, net = learned(spark, docs, 150)
    assert len(words.known) == 150 and words.beyond == sum(sorted(n.values())[:-150])
    hashes = np.array(list(n), dtype=np.int64).view(np.uint64)
    leaf = words.read(hashes)[1]

    def every(context):
        logp = net.logp(words, np.tile(np.array([context], np.uint8), (len(leaf), 1)), leaf)
        return logp + np.where(leaf == 150, np.log(np.array(list(n.values())) / words.beyond), 0)

    for context in ([0, 1, 2, 100], [scoring.PAD] * 4):
        assert np.exp(every(context)).sum() == pytest.approx(1, abs=1e-4)
    rows = {r["doc_id"]: r for r in scoring.score(tokens, counts, words, net).collect()}
    place = {h: i for i, h in enumerate(hashes.tolist())}
    for doc_id in (0, 40):
        h = scoring._hashes(texts[doc_id])
        line = [scoring.PAD] * 2 + words.read(h)[0].tolist() + [scoring.PAD] * 2
        total = sum(every([line[i], line[i + 1], line[i + 3], line[i + 4]])[place[x]] for i, x in enumerate(h.tolist()))
        assert rows[doc_id]["log_prob"] == pytest.approx(total, rel=1e-4) and rows[doc_id]["n_tokens"] == len(h)


def test_training_beats_the_corpus_shares(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    n, counts, words, tokens, net = learned(spark, docs, scoring.KNOWN)
    total = sum(n.values())
    unigram = sum(x * math.log(x / total) for x in n.values())
    scored, blank = (scoring.score(tokens, counts, words, x).agg(F.sum("log_prob"), F.sum("n_tokens")).first() for x in (net, scoring.Network.start(words)))
    assert scored[1] == total and blank[0] == pytest.approx(unigram, rel=1e-4) and scored[0] / total > unigram / total + 0.02


def test_average_of_equal_networks_is_that_network(spark, monkeypatch):
    text = " ".join(f"w{i % 50}" for i in range(4000))
    docs = spark.createDataFrame([(i, text) for i in range(6)], "doc_id LONG, text STRING")
    whole = learned(spark, docs.limit(1), 30)[-1]
    monkeypatch.setattr(scoring, "GROUP", 400)  # each document a group of its own, or nearly
    counts = scoring.word_counts(docs.limit(1)).cache()
    words = scoring.vocabulary(counts, 30)
    tokens = scoring.materialize(scoring.tokenized(docs.limit(1), words), "lm")
    assert np.allclose(scoring.train(tokens, words).out, whole.out, atol=1e-6)


def test_words_of_one_class_do_not_score_alike(spark):
    common = [f"c{i}" for i in range(96)] * 30
    a, b = [w for w in (f"x{i}" for i in range(2000)) if int(scoring._hashes(w)[0]) % scoring.RARE == 3][:2]
    docs = spark.createDataFrame([(0, " ".join(common)), (1, " ".join([a] * 9)), (2, a), (3, b)], "doc_id LONG, text STRING")
    rows = {r["doc_id"]: r["log_prob"] for r in scoring.score_documents(docs, known=96).collect()}
    assert rows[2] - rows[3] == pytest.approx(math.log(10), abs=1e-5)


def test_scores_do_not_depend_on_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(scoring, "GROUP", 4000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a, b = ({r["doc_id"]: r["log_prob"] for r in scoring.score_documents(docs.repartition(n)).collect()} for n in (1, 7))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-6) for k in a)
