"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .langid import held_out

# The words that the grammar starts from, in the four languages.
INSULTS = "idiot moron stupid scum loser trash worthless pathetic disgusting clown imbecile dumb idiota estúpido imbécil basura idiote stupide ordure crétin dummkopf abschaum trottel widerlich".split()
THREATS = "kill hurt destroy strangle stab punish töten umbringen verletzen tuer frapper détruire matar destruir golpear".split()
TARGETS = "you your yours he she him her they them people all everyone du dich dir euch ihr sie tu toi te vous ils elles tú ti usted ustedes ellos ellas".split()
NEGATIONS = "not no never without nobody isn aren wasn don doesn didn nicht kein keine nie niemals ohne pas jamais sans nunca jamás sin".split()
REPORTS = "said says say told wrote writes claimed called quoted reported according sagte sagt schrieb behauptete laut dit disait écrit affirme selon dijo dice escribió según".split()

_token = re.compile(r"[^\W\d_]+|[.!?;:\n]")
STOPS = frozenset(".!?;:\n")
STEMS = (4, 5, 6, 7, 8)


#: The score from which on a text counts as toxic.
THRESHOLD = 0.3
SYMBOLS = ("insult", "threat", "target", "negation", "report", "other")
HITS = ("insult", "threat")


@dataclass(frozen=True)
class Arc:
    """A way on: the marks written behind a symbol, the weight of taking it, and the state that it leads to."""

    marks: frozenset[str]
    weight: float
    to: object


@dataclass(frozen=True)
class Transducer:
    """A weighted finite-state transducer over classes of words. arcs[state][symbol]: the ways on; without one, a path
    ends in vain. Paths begin in start and hold if they end in one of finals; the heaviest is a clause's reading."""

    start: object
    finals: frozenset
    arcs: dict

    def then(self, other: "Transducer") -> "Transducer":
        """The composition: both read the clause, the other one behind this one's marks. Its states are the pairs that
        can be reached, its weights the sums."""
        start, arcs = (self.start, other.start), {}
        todo = [start]
        while todo:
            state = todo.pop()
            if state in arcs:
                continue
            arcs[state] = {s: tuple(Arc(x.marks | y.marks, x.weight + y.weight, (x.to, y.to)) for x in self.arcs[state[0]].get(s, ()) for y in other.arcs[state[1]].get(s, ())) for s in SYMBOLS}
            todo += [x.to for ways in arcs[state].values() for x in ways]
        return Transducer(start, frozenset(x for x in arcs if x[0] in self.finals and x[1] in other.finals), arcs)

    def reading(self, symbols: list[str]) -> tuple[float, list[frozenset[str]]]:
        """Weight and marks of the heaviest path over a clause (of equal ones, the first found), a state at a time."""
        best, steps = {self.start: 0.0}, []
        for symbol in symbols:
            new, back = {}, {}
            for state, weight in best.items():
                for arc in self.arcs[state].get(symbol, ()):
                    if arc.to not in new or weight + arc.weight > new[arc.to]:
                        new[arc.to], back[arc.to] = weight + arc.weight, (state, arc.marks)
            best = new
            steps.append(back)
        state = max((x for x in best if x in self.finals), key=best.get)
        weight, marks = best[state], []
        for back in reversed(steps):
            state, found = back[state]
            marks.append(found)
        return weight, marks[::-1]


def phrase(symbol: str, reach: int | None, mark: str) -> Transducer:
    """Marks insults and threats at most reach symbols behind `symbol`, or all of them to the clause's end."""
    left = range((reach or 1) + 1)
    after = lambda n, s: left[-1] if s == symbol else n if reach is None else max(0, n - 1)
    marks = lambda n, s: frozenset([mark] if n and s in HITS else [])
    return Transducer(0, frozenset(left), {n: {s: (Arc(marks(n, s), 0.0, after(n, s)),) for s in SYMBOLS} for n in left})


def around(symbol: str, reach: int, mark: str) -> Transducer:
    """Marks insults and threats with `symbol` at most reach symbols before or behind them. A state is how long the last
    one still reaches, and within how many symbols one is owed: a path may mark a hit on credit, and holds only if
    the symbol comes in time. A mark weighs 1, so the heaviest path marks all that can be."""
    arcs = {}
    for reaches in range(reach + 1):
        for owed in range(reach + 1):
            ways = arcs[reaches, owed] = {}
            for s in SYMBOLS:
                met, due = s == symbol, owed - 1
                if owed and not met and not due:
                    continue
                on = (reach if met else max(0, reaches - 1), 0 if met or not owed else due)
                ways[s] = (Arc(frozenset(), 0.0, on),)
                if s in HITS:
                    sure = Arc(frozenset([mark]), 1.0, on if reaches else (on[0], on[1] or reach))
                    ways[s] = (sure,) if reaches else (sure, *ways[s])
    return Transducer((0, 0), frozenset(x for x in arcs if not x[1]), arcs)


#: The composed grammar of a clause: its insults and threats with what is said about them.
GRAMMAR = around("target", 4, "aimed").then(phrase("negation", 3, "negated")).then(phrase("report", None, "reported"))


@lru_cache(maxsize=1 << 16)
def _marks(symbols: tuple[str, ...]) -> list[frozenset[str]]:
    """The marks of a clause; the same symbols are read once."""
    return GRAMMAR.reading(list(symbols))[1]


FEATURES = ("insult", "insult aimed", "insult negated", "insult reported", "threat", "threat aimed", "threat negated", "threat reported", "clauses", "strongest")


@dataclass(frozen=True)
class Lexicon:
    """Weights of insult words and of insult stems (by their length); the other classes of words."""

    words: dict[str, float]
    stems: dict[int, dict[str, float]] = field(default_factory=dict)
    classes: dict[str, str] = field(default_factory=lambda: {w: c for c, ws in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in ws})

    @cached_property
    def threats(self) -> frozenset[str]:
        return frozenset(w for w, c in self.classes.items() if c == "threat")

    def insult(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n, stems in self.stems.items():
            best = max(best, stems.get(word[:n], 0.0))
        return best


def features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """What the grammar finds in a whole text: weights of insults and threats by their marks, clauses that match, and
    the strongest match. Clauses end at sentence marks and line ends; those without an insult or threat count nothing."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    low = text.lower()
    tokens = _token.findall(low)
    hot = {w: weight for w in set(tokens) if (weight := lexicon.insult(w)) > 0}
    if not hot and lexicon.threats.isdisjoint(tokens):
        return out
    at = 0
    ends = [i for i, t in enumerate(tokens) if t in STOPS] + [len(tokens)]
    for end in ends:
        clause, at = tokens[at:end], end + 1
        symbols = ["insult" if w in hot else lexicon.classes.get(w, "other") for w in clause]
        if "insult" not in symbols and "threat" not in symbols:
            continue
        total = 0.0
        for word, symbol, marks in zip(clause, symbols, _marks(tuple(symbols))):
            if symbol not in HITS:
                continue
            weight = hot.get(word, 1.0)
            for i, name in enumerate(FEATURES[:8]):
                kind, _, mark = name.partition(" ")
                if kind == symbol and (not mark or mark in marks):
                    out[i] += weight
            total += weight * (0.5 if marks & {"negated", "reported"} else 1.0)
        out[8] += 1
        out[9] = max(out[9], total)
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    return np.log1p(np.maximum(x, 0.0))


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        z = float(_scaled(features(text, self.lexicon)) @ self.weights + self.bias)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _units(text: str) -> set[str]:
    words = {w for w in _token.findall(text.lower()) if w not in STOPS}
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def learn_lexicon(sample: DataFrame, least_odds: tuple[float, ...] = (2.0,)) -> list[dict[str, float]]:
    """sample: text, toxic, one row a distinct text. For each of least_odds, units (words, and stems as "abcd*") with
    their log-odds.

    Document counts of all units are summed on Spark; those in enough toxic texts whose odds are e^least_odds times
    the usual are candidates. Of them a cover is kept: the unit in most texts that no kept unit explains, again and
    again, so that words which merely stand beside an insult drop out. Candidates are bounded by the sample."""

    def count(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                (toxic if label.as_py() else clean).update(_units(text.as_py()))
        units = list(toxic)
        if units:
            yield pa.RecordBatch.from_arrays([pa.array(units), pa.array([toxic[u] for u in units], pa.int64()), pa.array([clean[u] for u in units], pa.int64())], names=["unit", "a", "b"])
        rest = [u for u in clean if u not in toxic]
        if rest:
            yield pa.RecordBatch.from_arrays([pa.array(rest), pa.array([0] * len(rest), pa.int64()), pa.array([clean[u] for u in rest], pa.int64())], names=["unit", "a", "b"])

    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return [{} for _ in least_odds]
    least = max(3, int(0.002 * n1))
    odds = lambda a, b: F.log((a + 0.5) / (n1 + 1.0)) - F.log((b + 0.5) / (n0 + 1.0))
    sums = sample.select("text", "toxic").mapInArrow(count, "unit string, a long, b long").groupBy("unit").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rows = sums.where(F.col("a") >= least).withColumn("odds", odds(F.col("a"), F.col("b"))).where(F.col("odds") >= min(least_odds)).collect()
    weight = {r["unit"]: r["odds"] for r in rows}
    names = set(weight)

    def where(batches):
        for batch in batches:
            held = [sorted(_units(t.as_py()) & names) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string()))], names=["units"])

    texts = sample.where("toxic = 1").select("text").mapInArrow(where, "units array<string>").collect()
    every = defaultdict(set)
    for i, r in enumerate(texts):
        for u in r["units"]:
            every[u].add(i)

    def cover(odds: float) -> dict[str, float]:
        kept, holds = {}, {u: s for u, s in every.items() if weight[u] >= odds}
        while holds:
            best = max(holds, key=lambda u: (len(holds[u]), weight[u], not u.endswith("*"), len(u), u))
            if len(holds[best]) < least:
                break
            kept[best], done = weight[best], holds[best]
            holds = {u: left for u, s in holds.items() if (left := s - done)}
        return kept

    return [cover(odds) for odds in least_odds]


def _lexicon(units: dict[str, float]) -> Lexicon:
    words = {w: 2.0 for w in INSULTS} | {u: v for u, v in units.items() if not u.endswith("*")}
    stems: dict[int, dict[str, float]] = {}
    for u, v in units.items():
        if u.endswith("*"):
            stems.setdefault(len(u) - 1, {})[u[:-1]] = v
            words.setdefault(u[:-1], v)
    return Lexicon(words, stems)


def _featured(sample: DataFrame, lexicons: list[Lexicon]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled features (text x lexicon x feature), labels, and whether a text is one of the fifth that chooses."""

    def run(batches):
        for batch in batches:
            x = [[v for lexicon in lexicons for v in features(t.as_py(), lexicon)] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "toxic", "chooses"])

    rows = sample.select("text", "toxic", _chooses()).mapInArrow(run, "x array<double>, toxic int, chooses boolean").collect()
    # Sums of floats depend on their order, and Spark gives none.
    rows.sort(key=lambda r: (r["x"], r["toxic"], r["chooses"]))
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(lexicons), len(FEATURES))
    return _scaled(x), np.array([r["toxic"] for r in rows], float), np.array([r["chooses"] for r in rows], bool)


def _chooses():
    return (F.pmod(F.xxhash64("text", F.lit(9)), F.lit(5)) == 0).alias("chooses")


def least_odds_for(sample: DataFrame, odds: tuple[float, ...]) -> float:
    """Which of odds to learn a lexicon with: lexicon and weights are learned from four fifths of the sample, and the
    errors that THRESHOLD makes on the last fifth, as shares of each label, decide (of equal ones, the higher odds)."""
    found = [_lexicon(units) for units in learn_lexicon(sample.where(~_chooses()), odds)]
    x, y, chooses = _featured(sample, found)
    if len(set(y[chooses])) < 2 or len(set(y[~chooses])) < 2:
        return odds[-1]
    errors = []
    for i in range(len(odds)):
        w, b = fit_weights(x[~chooses, i], y[~chooses])
        wrong = (x[chooses, i] @ w + b >= np.log(THRESHOLD / (1 - THRESHOLD))) != (y[chooses] == 1)
        errors.append((wrong[y[chooses] == 1].mean() + wrong[y[chooses] == 0].mean(), -odds[i]))
    return -min(errors)[1]


def fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression of labels on scaled features, by gradient descent."""
    w, b = np.zeros(x.shape[1]), -1.0
    spread = np.maximum(x.std(0), 1e-6)
    z = x / spread
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
        w -= rate * (z.T @ (p - y) / len(y) + ridge * w)
        b -= rate * float((p - y).mean())
    return w / spread, b


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 6000, odds: tuple[float, ...] = (1.5, 2.0, 2.5, 3.0)) -> ToxicityModel:
    """docs: doc_id, text; labels: doc_id, toxic. Learns from labelled rows that are not held out: about per_class of
    each label, drawn by a hash of the id, copies of a text once. How rare a word must be in clean texts to count as an
    insult is one of odds, chosen on a fifth of these rows. Null ids and labels teach nothing; a text labelled both
    ways is toxic; without labels of both kinds, the grammar's own words score with set weights."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = lambda y: int(min(1.0, per_class / max(1, counts.get(y, 0))) * 1e6)
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < F.when(F.col("toxic") == 1, share(1)).otherwise(share(0)))
    # At most 3 * per_class rows, so they can go to every task; the texts stay where they are.
    drawn = F.broadcast(drawn.orderBy(F.xxhash64("doc_id"), "toxic").limit(3 * per_class))
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(drawn, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    sample = materialize(sample, "toxic-sample")
    if not counts.get(0) or not counts.get(1):
        return ToxicityModel(_lexicon({}), np.where([f in ("insult", "insult aimed", "threat aimed") for f in FEATURES], 2.0, 0.0), -2.0)
    lexicon = _lexicon(learn_lexicon(sample, (least_odds_for(sample, odds),))[0])
    x, y, _ = _featured(sample, [lexicon])
    return ToxicityModel(lexicon, *fit_weights(x[:, 0], y))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs: doc_id, text; other columns are ignored. A row a row: doc_id, score (0 to 1). Null and empty texts match
    no clause and score as such; whole texts are read; repeated rows score alike; an empty table gives no rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            scores = [float(model.score(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op8_score_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
