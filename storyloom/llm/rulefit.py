"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics, compiled into column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import _ODD, mix, word_bounds, word_hashes
from .quality import CLASSES, _CLASS, _KEYS

STATISTICS = ("words", "word_length", "longest_word", "distinct_words", "top_word", "repeated_windows", "common_words", "lines", "repeated_lines", "line_words", "vowels", "capitals", "digits", "stops", "marks", "symbols", "others", "beyond", "entropy", "marked_words")
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>!", np.uint8))
Rule = tuple[tuple[str, float, float], ...]


def statistics(text: str | None) -> list[float]:
    """The numbers that rules speak of, over a whole text: counts, and shares of words, lines, letters or characters. A text
    without words (null too) has all of them 0."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    starts, ends = word_bounds(data)
    n = len(starts)
    if not n:
        return [0.0] * len(STATISTICS)
    sizes, hashes = ends - starts, word_hashes(data, starts, ends)
    kinds = np.unique(hashes, return_counts=True)[1]
    repeated = 0
    if n > 3:
        windows = mix((hashes[:-2] * _ODD + hashes[1:-1]) * _ODD + hashes[2:])
        repeated = len(windows) - len(np.unique(windows))
    lines, lengths = np.unique(_lines(data, starts, hashes), return_counts=True)
    n_lines = int(lengths.sum())
    bytes_of = np.bincount(data, minlength=256)
    inside = _CLASS >= 0
    by_class = dict(zip(CLASSES, np.bincount(_CLASS[inside], weights=bytes_of[inside], minlength=len(CLASSES))))
    chars = sum(by_class.values())
    letters = max(1.0, by_class["vowel"] + by_class["consonant"] + by_class["upper"] + by_class["beyond"])
    share = bytes_of[bytes_of > 0] / len(data)
    common = np.isin(hashes, _KEYS).sum()
    last = _SYMBOL[data[ends - 1]]
    return [float(v) for v in (n, sizes.mean(), sizes.max(), len(kinds) / n, kinds.max() / n, repeated / n, common / n, n_lines, (n_lines - len(lines)) / n_lines, n / n_lines, by_class["vowel"] / letters, by_class["upper"] / letters, by_class["digit"] / chars, by_class["stop"] / n, by_class["mark"] / n, by_class["symbol"] / n, by_class["other"] / chars, by_class["beyond"] / letters, -(share * np.log2(share)).sum(), last.mean())]


def _lines(data: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A hash of the words of each line that has one."""
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    place = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
    return np.add.reduceat(mix(hashes + place.astype(np.uint64) * _ODD), first)


def measured(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc_id and stats, an array of STATISTICS."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            got = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, stats array<double>")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def grow(bins: np.ndarray, gain_of: np.ndarray, weight: np.ndarray, depth: int, least: int, cuts: int) -> tuple[list[tuple], np.ndarray]:
    """A regression tree on binned statistics by second-order gain. Returns the paths of all its nodes but the root, as
    ((feature, cut, above?), ...), and the leaf value of every row."""
    n, f = bins.shape
    value, paths = np.zeros(n), []
    todo = [(np.arange(n), ())]
    flat = bins + np.arange(f) * cuts
    while todo:
        rows, path = todo.pop()
        g, h = gain_of[rows], weight[rows]
        best = (1e-6, None)
        if len(path) < depth and len(rows) >= 2 * least:
            cells = flat[rows].ravel()
            sums = [np.bincount(cells, weights=np.repeat(w, f), minlength=f * cuts).reshape(f, cuts).cumsum(1) for w in (g, h, np.ones(len(rows)))]
            gl, hl, nl = (s[:, :-1] for s in sums)
            gr, hr, nr = g.sum() - gl, h.sum() - hl, len(rows) - nl
            gain = np.where((nl >= least) & (nr >= least), gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1), -1.0)
            at = int(gain.argmax())
            if gain.flat[at] > best[0]:
                best = (gain.flat[at], divmod(at, cuts - 1))
        if best[1] is None:
            value[rows] = g.sum() / (h.sum() + 1)
            continue
        feature, cut = best[1]
        above = bins[rows, feature] > cut
        for side in (False, True):
            paths.append((*path, (feature, cut, side)))
            todo.append((rows[above == side], paths[-1]))
    return paths, value


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, cuts: int = 32, seed: int = 7) -> list[Rule]:
    """Rules of boosted trees, each grown on half of the rows: every path is the conjunction of its conditions, one
    interval (above low, at most high) a statistic. Rules that say the same stand once."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    rng, margin, found = np.random.default_rng(seed), np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        half = rng.random(len(y)) < 0.5
        paths, _ = grow(bins[half], (y - p)[half], (p * (1 - p))[half], depth, max(5, len(y) // 200), cuts)
        rules = []
        for path in paths:
            within: dict[int, tuple[float, float]] = {}
            for feature, cut, above in path:
                low, high = within.get(feature, (-np.inf, np.inf))
                edge = float(edges[feature][cut]) if cut < len(edges[feature]) else np.inf
                within[feature] = (max(low, edge), high) if above else (low, min(high, edge))
            rules.append(tuple((STATISTICS[j], *within[j]) for j in sorted(within)))
        for rule in rules:
            found.setdefault(rule, None)
        # The tree's own leaves move the margin, so that the next tree looks at what is still wrong.
        leaves = [rule for path, rule in zip(paths, rules) if not any(other[: len(path)] == path and len(other) > len(path) for other in paths)]
        for rule in leaves:
            hit = fires(x, [rule])[:, 0]
            margin[hit] += rate * ((y - p)[hit].sum() / ((p * (1 - p))[hit].sum() + 1))
    return list(found)


def fires(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    """Which rules hold for which rows of statistics."""
    out = np.ones((len(x), len(rules)), bool)
    for i, rule in enumerate(rules):
        for name, low, high in rule:
            v = x[:, STATISTICS.index(name)]
            out[:, i] &= (v > low) & (v <= high)
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalties: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Logistic weights of the columns of r (scaled by their spread) under each penalty, largest first, by accelerated
    proximal gradient from the solution before. Returns weights (penalty x rule, of the unscaled columns) and biases."""
    mean, spread = r.mean(0), np.maximum(r.std(0), 0.02)
    z = (r - mean) / spread
    step = 4.0 * len(y) / max(1e-9, _top_eigenvalue(z) + len(y))
    w, b = np.zeros(z.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    weights, biases = [], []
    for penalty in penalties:
        vw, vb, t = w, b, 1.0
        for _ in range(rounds):
            miss = 1 / (1 + np.exp(-np.clip(z @ vw + vb, -30, 30))) - y
            new = vw - step * (z.T @ miss) / len(y)
            new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0.0)
            new_b, new_t = vb - step * float(miss.mean()), (1 + np.sqrt(1 + 4 * t * t)) / 2
            vw, vb = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
            w, b, t = new, new_b, new_t
        weights.append(w / spread)
        biases.append(b - float((w / spread) @ mean))
    return np.array(weights), np.array(biases)


def _top_eigenvalue(z: np.ndarray) -> float:
    v = np.ones(z.shape[1])
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= max(1e-12, np.linalg.norm(v))
    return float(np.linalg.norm(z @ v) ** 2)


@dataclass(frozen=True)
class RuleModel:
    """Rules with weights other than 0, and the bias."""

    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def column(self, stat) -> Column:
        """The score as one Spark expression; stat gives the column of a statistic."""

        def holds(rule: Rule) -> Column:
            sides = [(stat(n) > F.lit(low)) if np.isfinite(low) else None for n, low, _ in rule] + [(stat(n) <= F.lit(high)) if np.isfinite(high) else None for n, _, high in rule]
            return reduce(lambda a, b: a & b, [s for s in sides if s is not None], F.lit(True))

        z = reduce(lambda a, b: a + b, (F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in zip(self.rules, self.weights)), F.lit(self.bias))
        return 1 / (1 + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The same in numpy."""
        return 1 / (1 + np.exp(-(fires(x, list(self.rules)) @ np.array(self.weights) + self.bias)))


def learn(x: np.ndarray, y: np.ndarray, folds: int = 3, steps: int = 8) -> RuleModel:
    """Rules from all rows; the penalty is the largest whose cross-validated log-loss is within a standard error of the
    least (folds take rows in turn, and each fold's rules and weights come from the other folds alone)."""
    if len(y) < 20 or y.min() == y.max():
        return RuleModel((), (), float(np.log((y.sum() + 1.0) / (len(y) - y.sum() + 1.0))))
    penalties = np.geomspace(0.1, 0.0005, steps)
    loss = []
    for fold in range(folds):
        own = np.arange(len(y)) % folds == fold
        if min(y[own].min(), 1 - y[own].max()) or y[~own].min() == y[~own].max():
            continue
        rules = extract_rules(x[~own], y[~own])
        w, b = lasso(fires(x[~own], rules).astype(float), y[~own], penalties)
        p = np.clip(1 / (1 + np.exp(-np.clip(fires(x[own], rules) @ w.T + b, -30, 30))), 1e-6, 1 - 1e-6)
        loss.append(-(y[own, None] * np.log(p) + (1 - y[own, None]) * np.log(1 - p)).mean(0))
    loss = np.array(loss) if loss else np.zeros((1, steps))
    mean, error = loss.mean(0), loss.std(0) / np.sqrt(len(loss))
    least = int(mean.argmin())
    pick = int(np.flatnonzero(mean <= mean[least] + error[least])[0])
    rules = extract_rules(x, y)
    w, b = lasso(fires(x, rules).astype(float), y, penalties[: pick + 1])
    kept = [i for i in np.flatnonzero(np.abs(w[-1]) > 1e-9)]
    return RuleModel(tuple(rules[i] for i in kept), tuple(float(w[-1][i]) for i in kept), float(b[-1]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4_000) -> RuleModel:
    """docs: doc_id, text; labels: doc_id, quality. Learns from labelled rows that are not held out: about per_class of
    each label and at most 3 * per_class rows, drawn by hashes; texts of equal statistics once, and as of the lower
    quality where labels differ. Null ids, texts and labels teach nothing; without labels of both kinds every
    document scores as the share of good ones."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = lambda y: int(min(1.0, per_class / max(1, counts.get(y, 0))) * 1e6)
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_000)) < F.when(F.col("quality") == 1, share(1)).otherwise(share(0)))
    # At most 3 * per_class rows, so they can go to every task; the texts stay where they are.
    drawn = F.broadcast(drawn.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(3 * per_class).groupBy("doc_id").agg(F.min("quality").alias("quality")))
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(drawn, "doc_id").select(F.struct("doc_id", "quality").alias("doc_id"), "text")
    rows = measured(sample).groupBy("stats").agg(F.min("doc_id.quality").alias("quality")).orderBy(F.xxhash64("stats"), "stats").limit(3 * per_class).collect()
    x = np.array([r["stats"] for r in rows], float).reshape(len(rows), len(STATISTICS))
    return learn(x, np.array([r["quality"] for r in rows], float))


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """docs: doc_id, text; other columns are ignored. A row a row: doc_id, score (0 to 1). Null, empty and wordless texts
    have statistics of 0 and score by the rules that hold there; whole texts are measured; repeated rows score
    alike; an empty table gives no rows. Python measures the texts, the rules run as a Spark expression."""
    stats = measured(docs).select("doc_id", *(F.col("stats")[i].alias(n) for i, n in enumerate(STATISTICS)))
    return stats.select("doc_id", model.column(F.col).alias("score"))


def op13_classify_quality(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
