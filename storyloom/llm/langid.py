"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.tables import running

from .common import unused

UNKNOWN = "und"
BUCKETS = 1 << 14
ORDERS = (2, 3, 4)
CHUNK = 1 << 20


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def has_letter(text: str) -> bool:
    """Whether a text holds a letter of any script; digits, number forms and marks are none."""
    return any(map(str.isalpha, text))


def subwords(text: str):
    """Arrays of bucket numbers of a text's byte 2-, 3- and 4-grams in lower case, over the whole text, by chunks."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", dtype=np.uint8)
    for at in range(0, len(data), CHUNK):
        b = data[at : at + CHUNK + max(ORDERS) - 1].astype(np.uint32)
        h = b
        for order in range(2, max(ORDERS) + 1):
            h = h[: len(b) - order + 1] * np.uint32(257) + b[order - 1 :]
            if order in ORDERS and len(h):  # those that start in this chunk
                yield ((h[:CHUNK] + np.uint32(order)) * np.uint32(2654435761) >> np.uint32(18)).astype(np.int32)


def histogram(text: str) -> np.ndarray:
    """Share of each bucket among a text's subwords; sums to 1, or 0 for a text without any."""
    out = np.zeros(BUCKETS, dtype=np.float64)
    for ids in subwords(text):
        out += np.bincount(ids, minlength=BUCKETS)
    return (out / max(out.sum(), 1.0)).astype(np.float32)


@dataclass(frozen=True)
class LanguageModel:
    """langs: learned values; table: logits of each bucket (embedding times softmax weights); bias; temperature;
    reject_below: calibrated confidence under which a document is rejected."""

    langs: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, text: str | None) -> np.ndarray | None:
        if not text or not self.langs or not has_letter(text):
            return None
        total, n = np.zeros(len(self.langs)), 0
        for ids in subwords(text):
            total += np.bincount(ids, minlength=BUCKETS) @ self.table if len(ids) > 4 * BUCKETS else self.table[ids].sum(0, dtype=np.float64)
            n += len(ids)
        z = (total / n + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


@dataclass(frozen=True)
class Histograms:
    """Histograms kept as their filled buckets and the shares there (little-endian int32 and float32)."""

    filled: list[tuple[bytes, bytes]]

    def __len__(self) -> int:
        return len(self.filled)

    def only(self, rows: np.ndarray) -> Histograms:
        return Histograms([self.filled[i] for i in rows])

    def dense(self, rows: np.ndarray) -> np.ndarray:
        """Those rows as full histograms; meant for a batch at a time."""
        out = np.zeros((len(rows), BUCKETS), dtype=np.float32)
        for i, row in enumerate(rows):
            ids, values = self.filled[row]
            out[i, np.frombuffer(ids, "<i4")] = np.frombuffer(values, "<f4")
        return out


def train(x: Histograms, y: np.ndarray, n_langs: int, dim: int = 16, epochs: int = 30, rate: float = 0.5, batch: int = 32, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent on cross-entropy; a document is the average of its subwords' embeddings. Only one
    batch of histograms is full at a time. Returns (buckets x langs logits, bias)."""
    rng = np.random.default_rng(seed)
    embed = (rng.standard_normal((BUCKETS, dim)) * 0.1).astype(np.float32)
    weight, bias = (rng.standard_normal((dim, n_langs)) * 0.1).astype(np.float32), np.zeros(n_langs, dtype=np.float32)
    scale = np.float32(BUCKETS**0.5)
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            part = x.dense(rows)
            mean = part @ embed * scale
            z = mean @ weight + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = p @ weight.T
            weight -= step * mean.T @ p
            bias -= step * p.sum(0)
            embed -= step * scale * (part.T @ back)
    return embed @ weight * scale, bias


def _learn(x: Histograms, y: np.ndarray, n_langs: int, reject_rate: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Logits, bias, temperature and the confidence to reject below, of a sample of at least one row."""
    fifth = np.arange(len(x)) % 5 == 4 if len(x) >= 20 else np.zeros(len(x), bool)
    table, bias = train(x.only(np.flatnonzero(~fifth)), y[~fifth], n_langs)
    at = np.flatnonzero(fifth) if fifth.any() else np.arange(len(x))
    z = np.concatenate([x.dense(at[i : i + 32]) @ table for i in range(0, len(at), 32)]) + bias

    def softmax(t: float) -> np.ndarray:
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    own = np.arange(len(z)), y[at]
    temperature = min(np.geomspace(0.25, 8, 21), key=lambda t: -np.log(softmax(t)[own] + 1e-12).mean())
    p = softmax(temperature)
    right = p.max(1)[p.argmax(1) == y[at]]
    reject = min(0.5, float(np.quantile(right, reject_rate)) * 0.9) if len(right) else 0.0
    return table.astype(np.float32), bias.astype(np.float64), float(temperature), reject


def fit(docs: DataFrame, per_lang: int = 500, reject_rate: float = 0.002, most_rows: int = 32_000, most_bytes: int = 1 << 29) -> LanguageModel:
    """docs: doc_id, text, lang. Learns from rows that are not held out and have a text with a letter and a lang; every
    such value of lang can be predicted. Rows without a lang teach nothing; of equally likely languages the first in
    order counts; without rows to learn from, every document is und.

    The fit takes a bounded sample: about per_lang documents of each language, or fewer where all together would be more
    than most_rows, drawn by a hash of the id and computed to histograms on the executors; of these, each language's first in a
    hashed order, up to its even share of most_bytes and one more, meet in one task, so what it holds is bounded in bytes. That
    task learns, and the driver gets the model alone. A fifth of the sample calibrates (all of it where it has fewer than
    20 rows): the temperature that makes its log-loss least, and the confidence that all but reject_rate of its rightly
    named documents reach."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = tuple(sorted(counts))
    per_lang = max(1, min(per_lang, most_rows // max(1, len(langs))))
    if not langs:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    share = F.create_map(*(F.lit(v) for k in langs for v in (k, min(1.0, per_lang / counts[k]) * 1e6)))
    drawn = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < F.try_element_at(share, F.col("lang")))

    def sparse(batches):
        for batch in batches:
            ids, values, names = [], [], []
            for text, lang in zip(batch.column(0), batch.column(1)):
                if has_letter(t := text.as_py()):
                    h = histogram(t)
                    at = np.flatnonzero(h).astype("<i4")
                    ids.append(at.tobytes())
                    values.append(h[at].tobytes())
                    names.append(lang.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(values, pa.binary()), pa.array(names, pa.string())], names=["ids", "values", "lang"])

    found = drawn.select("text", "lang").mapInArrow(sparse, "ids binary, values binary, lang string")
    sized = running(found, ["lang"], [F.xxhash64("ids"), F.xxhash64("values")], {"before": F.octet_length("ids") + F.octet_length("values")}, "languages")
    sample = sized.where(F.col("before") <= most_bytes // len(langs)).select("ids", "values", "lang")
    in_order = sample.repartition(1).sortWithinPartitions(F.xxhash64("ids"), "values", "lang").limit(2 * per_lang * len(langs))

    def learned(batches):
        filled, names = [], []
        for batch in batches:
            filled += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            names += map(langs.index, batch.column(2).to_pylist())
        if names:
            table, bias, temperature, reject = _learn(Histograms(filled), np.array(names), len(langs), reject_rate)
            yield pa.RecordBatch.from_pydict({"table": [table.astype("<f4").tobytes()], "bias": [bias.astype("<f8").tobytes()], "temperature": [temperature], "reject": [reject]})

    made = in_order.mapInArrow(learned, "table binary, bias binary, temperature double, reject double").collect()
    if not made:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    m = made[0]
    return LanguageModel(langs, np.frombuffer(m["table"], "<f4").reshape(BUCKETS, len(langs)), np.frombuffer(m["bias"], "<f8"), m["temperature"], m["reject"])


def predict(docs: DataFrame, model: LanguageModel, added: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_rejected")) -> DataFrame:
    """Adds three columns to docs, a row for a row, of whole texts: the language, its score (0 to 1) and whether it is
    rejected. Every other column passes through; columns of these three names are replaced. Text null or without a
    letter: und, 0, rejected."""
    docs = docs.drop(*added)
    place = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(added, (T.StringType(), T.DoubleType(), T.BooleanType())))])

    def run(batches):
        for batch in batches:
            names, scores, out = [], [], []
            for text in batch.column(place):
                p = model.probabilities(text.as_py())
                best = -1 if p is None else int(p.argmax())
                names.append(UNKNOWN if p is None else model.langs[best])
                scores.append(0.0 if p is None else float(p[best]))
                out.append(p is None or scores[-1] < model.reject_below)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], names=[*batch.schema.names, *added])

    return docs.mapInArrow(run, schema)


def keep_named(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs without the rows that the model rejects; all columns kept."""
    added = tuple(unused(docs, "lang_pred", "lang_score", "lang_rejected"))
    return predict(docs, model, added).where(~F.col(added[2])).select(*docs.columns)


def op10_identify_language(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, lang_pred, score, rejected."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.select("doc_id", "text", "lang"))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
