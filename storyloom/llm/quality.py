"""Quality rules: exact base counts and divergence of character-class and common-word histograms from references."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, unused
from .hashing import _ODD, mix, word_bounds, word_hashes

#: Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on with as are this be by at from or an".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es lo como más".split(),
}
#: The symbols that n_symbols counts.
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"

CLASSES = ("vowel", "consonant", "upper", "digit", "space", "stop", "mark", "symbol", "other", "beyond")


def _class_of_byte() -> np.ndarray:
    of = np.full(256, CLASSES.index("other"))
    for name, members in (("vowel", "aeiou"), ("consonant", "bcdfghjklmnpqrstvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("space", _SPACES), ("stop", ".,"), ("mark", "!?;:'\"()-"), ("symbol", SYMBOLS)):
        of[[ord(c) for c in members]] = CLASSES.index(name)
    of[0xC0:] = CLASSES.index("beyond")
    of[0x80:0xC0] = -1
    return of


_CLASS = _class_of_byte()
WORDS = tuple(sorted({w for words in COMMON_WORDS.values() for w in words}))


def _word_table() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the common words as they stand in texts (small, capital or all capital letters, a mark
    behind them or not) and the number of the word that each stands for."""
    known: dict[int, int] = {}
    for i, w in enumerate(WORDS):
        for form in {w, w.capitalize(), w.upper()}:
            for tail in ("", ".", ",", ";", ":", "!", "?"):
                data = np.frombuffer((form + tail).encode(), dtype=np.uint8)
                known.setdefault(int(word_hashes(data, *word_bounds(data))[0]), i)
    keys = np.array(sorted(known), dtype=np.uint64)
    return keys, np.array([known[int(k)] for k in keys])


_KEYS, _WORD_OF = _word_table()


def measure(text: str | None) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), class counts, common-word counts (last: others)."""
    classes, words = np.zeros(len(CLASSES), np.int64), np.zeros(len(WORDS) + 1, np.int64)
    if not text:
        return (0, 0, 0, 0, 0), classes, words
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.bincount(data, minlength=256)
    inside = _CLASS >= 0
    classes = np.bincount(_CLASS[inside], weights=counts[inside], minlength=len(CLASSES)).astype(np.int64)
    w = word_hashes(data, *word_bounds(data))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            dup += line in seen
            seen.add(line)
    repeats = 0
    if len(w) > 3:
        three = mix((w[:-2] * _ODD + w[1:-1]) * _ODD + w[2:])
        order = np.argsort(three, kind="stable")
        same = three[order][1:] == three[order][:-1]
        if same.any():
            twice = np.zeros(len(three), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(len(w), bool)
            for j in range(3):
                covered[j : len(w) - 2 + j] |= twice
            repeats = int(covered.sum())
    at = np.minimum(np.searchsorted(_KEYS, w), len(_KEYS) - 1)
    hit = _KEYS[at] == w
    words = np.bincount(_WORD_OF[at[hit]], minlength=len(WORDS) + 1).astype(np.int64)
    words[-1] = len(w) - hit.sum()
    space, symbol = CLASSES.index("space"), CLASSES.index("symbol")
    return (len(w), int(classes.sum() - classes[space]), int(classes[symbol]), dup, repeats), classes, words


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of p from q; rows and q are counts or shares."""
    p = p / np.maximum(p.sum(-1, keepdims=True), 1e-12)
    q = q / max(q.sum(), 1e-12)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0.0).sum(-1)
        return np.sqrt(np.maximum(0.0, (kl(p) + kl(np.broadcast_to(q, p.shape))) / 2))


@dataclass(frozen=True)
class Rules:
    """Thresholds. min_words and most_repeated (percent of words in repeated 3-word windows) make base_failed. The
    divergence tests hold for texts of at least class_chars word characters and word_words words. A text fails where
    its class distance from the nearest reference is above max_class_distance, or both distances are above both_*:
    texts of mixed languages lie far from every reference in words, and lists and tables do so in both."""

    min_words: int = 50
    most_repeated: int = 50
    class_chars: int = 200
    word_words: int = 100
    max_class_distance: float = 0.30
    both_class_distance: float = 0.13
    both_word_distance: float = 0.32


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(docs: DataFrame) -> DataFrame:
    """docs' columns but text, then the base counts (long) and class_counts, word_counts (arrays)."""
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*rest, *(T.StructField(f"__{n}", T.LongType()) for n in BASE), T.StructField("__classes", T.ArrayType(T.LongType())), T.StructField("__common", T.ArrayType(T.LongType()))])
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            got = [measure(t.as_py()) for t in batch.column(place)]
            base = list(zip(*(g[0] for g in got))) or [()] * len(BASE)
            arrays = [*(batch.column(i) for i in range(batch.num_columns) if i != place), *(pa.array(b, pa.int64()) for b in base), *(pa.array([g[i] for g in got], pa.list_(pa.int64())) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(run, schema)


def references(measured: DataFrame, rules: Rules) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Histograms of each language, summed over all documents that pass the base rules: some hundred numbers for each
    value of lang, of which there are as many as languages."""
    good = measured.where(F.col("lang").isNotNull() & ~_base_failed(rules))
    sums = good.groupBy("lang").agg(F.count("*").alias("n"), *(F.sum(F.col(c)[i]).alias(f"{c}{i}") for c, n in (("__classes", len(CLASSES)), ("__common", len(WORDS) + 1)) for i in range(n)))
    rows = sums.orderBy(F.desc("n"), "lang").collect()
    return {r["lang"]: (np.array([r[f"__classes{i}"] for i in range(len(CLASSES))], float), np.array([r[f"__common{i}"] for i in range(len(WORDS) + 1)], float)) for r in rows}


def _base_failed(rules: Rules):
    return (F.col("__n_words") < rules.min_words) | (100 * F.col("__n_repeat_words") > rules.most_repeated * F.col("__n_words"))


def judge(measured: DataFrame, refs: dict, rules: Rules) -> DataFrame:
    """Adds __base_failed, __class_distance, __word_distance (from the reference that is nearest in both together;
    null without references or words) and __kept."""
    schema = T.StructType([*measured.schema.fields, T.StructField("__class_distance", T.DoubleType()), T.StructField("__word_distance", T.DoubleType())])
    ends = [measured.columns.index(c) for c in ("__classes", "__common", "__n_words")]

    def run(batches):
        for batch in batches:
            a, b = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float) if batch.num_rows else np.zeros((0, 1)) for i in ends[:2])
            if refs and batch.num_rows:
                da = np.stack([js_distance(a, q) for q, _ in refs.values()])
                db = np.stack([js_distance(b, q) for _, q in refs.values()])
                near = (da + db).argmin(0), np.arange(batch.num_rows)
                none = batch.column(ends[2]).to_numpy(zero_copy_only=False) == 0
                out = [pa.array(d[near], pa.float64(), mask=none) for d in (da, db)]
            else:
                out = [pa.nulls(batch.num_rows, pa.float64())] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=schema.names)

    out = measured.mapInArrow(run, schema)
    odd = (F.col("__word_chars") >= rules.class_chars) & (F.col("__class_distance") > rules.max_class_distance)
    far = odd | ((F.col("__n_words") >= rules.word_words) & (F.col("__class_distance") > rules.both_class_distance) & (F.col("__word_distance") > rules.both_word_distance))
    return out.withColumn("__base_failed", _base_failed(rules)).withColumn("__kept", ~F.col("__base_failed") & ~F.coalesce(far, F.lit(False)))


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs: doc_id, text, lang (null: in no reference); other columns are ignored. A row a row: doc_id, the five base
    counts, base_failed, kept, class_distance, word_distance. Null and empty texts have no words and fail the base
    rules; very long lines and texts are measured whole; repeated rows each count; an empty table gives no rows."""
    measured = materialize(_measured(docs.select("doc_id", "lang", "text")), "quality")
    out = judge(measured, references(measured, rules), rules)
    return out.select("doc_id", *(F.col(f"__{n}").alias(n) for n in (*BASE, "base_failed", "kept", "class_distance", "word_distance")))


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs without the rows that quality rejects; all columns kept. Verdicts join back by doc_id and md5 of the text,
    on which they depend alone."""
    key, (own, copy) = F.md5(F.encode("text", "UTF-8")), unused(docs, "own_id", "md5")
    keyed = docs.select(F.col("doc_id").alias(own), key.alias(copy), "lang", "text")
    measured = materialize(_measured(keyed), "quality")
    bad = judge(measured, references(measured, rules), rules).where(~F.col("__kept")).select(own, copy).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(own)) & key.eqNullSafe(F.col(copy))
    return docs.join(bad, same, "left_anti")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, base counts, base_failed, kept and the two distances."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
