"""Document scores by masked pseudo-likelihood under a small bidirectional window network.

The network reads the classes of the words on both sides of a word (a frequent word is a class of its own, the others
share hashed classes) and predicts the word by a hierarchical softmax: the KNOWN most frequent words are leaves of one
Huffman tree, whose nodes decide by the window. All other words share one more leaf, times the word's share of the
corpus counts beyond the known words, which a join with the table of all words' counts gives. So every word has a
probability of its own, the probabilities sum to 1, the network is of fixed size, and the table grows with the corpus."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy
from .hashing import word_bounds, word_hashes

FREQUENT, RARE = 96, 32
V = FREQUENT + RARE
#: Stands between documents; its embeddings are zero and it is never predicted.
PAD = V
#: Words that are leaves of their own.
KNOWN = 8192
#: Words that one network learns from, about: how many groups there are depends on the corpus alone.
GROUP = 1 << 20
OFFSETS = (-2, -1, 1, 2)
DIM = 12
BATCH = 2048


def _hashes(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return word_hashes(data, *word_bounds(data)) if len(data) else np.zeros(0, np.uint64)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), n: every word of all documents, counted a batch at a time and the counts summed on Spark."""

    def run(batches):
        for batch in batches:
            found = [_hashes(t.as_py()) for t in batch.column(0)]
            words, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            for at in range(0, len(words), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000].astype(np.int64))], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def huffman(weights: list[int]) -> tuple[list[list[tuple[int, int]]], list[float]]:
    """Each leaf's path as (node, sign), and each node's log-odds of sign 1. One leaf has an empty path."""
    heap = [(int(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    up, bias, n = {}, [], len(heap)
    while len(heap) > 1:
        (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
        up[a], up[b] = (len(bias), 1), (len(bias), -1)
        heapq.heappush(heap, (wa + wb, n + len(bias)))
        bias.append(float(np.log(wa / wb)))
    paths = []
    for i in range(n):
        path = []
        while i in up:
            path.append(up[i])
            i = n + up[i][0]
        paths.append(path)
    return paths, bias


@dataclass
class Vocabulary:
    """known: sorted hashes of the words that are leaves; the next leaf is that of all others, beyond: their corpus
    count. classes: the class of each known word. A leaf's path is size decisions from start on in node and sign; bias:
    log-odds of each node by the corpus counts."""

    known: np.ndarray
    classes: np.ndarray
    beyond: int
    start: np.ndarray
    size: np.ndarray
    node: np.ndarray
    sign: np.ndarray
    bias: np.ndarray

    def read(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class (a byte) and leaf (two) of each word."""
        rare = (hashes % np.uint64(RARE)).astype(np.uint8) + np.uint8(FREQUENT)
        if not len(self.known):
            return rare, np.zeros(len(hashes), "<u2")
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hit = self.known[at] == hashes
        return np.where(hit, self.classes[at], rare), np.where(hit, at, len(self.known)).astype("<u2")

    def paths(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For all decisions of the leaves, a leaf's own side by side: place in leaf, node, sign; and where each begins."""
        size = self.size[leaf]
        first = np.cumsum(size) - size
        at = np.arange(size.sum(), dtype=np.int32) + np.repeat(self.start[leaf] - first, size)
        return np.repeat(np.arange(len(leaf), dtype=np.int32), size), self.node[at], self.sign[at], first


def vocabulary(counts: DataFrame, known: int = KNOWN) -> Vocabulary:
    """counts: word, n. The known most frequent words (ties by hash) and one sum reach the driver."""
    rows = counts.orderBy(F.desc("n"), "word").limit(known).collect()
    words, n = np.array([r["word"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    classes = (words % np.uint64(RARE)).astype(np.uint8) + np.uint8(FREQUENT)
    classes[:FREQUENT] = np.arange(min(FREQUENT, len(words)))
    order = np.argsort(words)
    beyond = int((counts.agg(F.sum("n")).first()[0] or 0) - n.sum())
    paths, bias = huffman([*n[order].tolist(), *([beyond] if beyond else [])])
    size = np.array([len(p) for p in paths] + [0] * (not beyond), np.int32)
    flat = np.array([d for p in paths for d in p], dtype=np.int32).reshape(-1, 2)
    return Vocabulary(words[order], classes[order], beyond, (np.cumsum(size) - size).astype(np.int32), size, flat[:, 0].astype(np.int16), flat[:, 1].astype(np.float32), np.array(bias, np.float32))


def tokenized(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """doc_id, ids (classes of the whole text's words, a byte each), leaves (two bytes each) and beyond (hashes of the
    words that share a leaf)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, leaves, beyond = [], [], []
            for text in batch.column(1):
                h = _hashes(text.as_py())
                i, leaf = words.read(h)
                ids.append(i.tobytes())
                leaves.append(leaf.tobytes())
                beyond.append(h[leaf == len(words.known)].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(leaves, pa.binary()), pa.array(beyond, pa.list_(pa.int64()))], names=["doc_id", "ids", "leaves", "beyond"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, leaves binary, beyond array<bigint>")


def windows(documents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All documents' ids with two PADs before, between and behind them, and the places of the ids."""
    gap = bytes([PAD] * 2)
    line = np.frombuffer(gap + gap.join(documents) + gap, dtype=np.uint8)
    return line, np.flatnonzero(line != PAD)


def _context(line: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([line[at + o] for o in OFFSETS], axis=1)


@dataclass
class Network:
    """Embeddings of the window's places (place x class x dim; the last class is PAD), weights and bias of the tree's
    nodes, and how often each node has been met."""

    embed: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    met: np.ndarray

    @staticmethod
    def start(words: Vocabulary, seed: int = 1) -> "Network":
        rng = np.random.default_rng(seed)
        embed = (rng.standard_normal((len(OFFSETS), V + 1, DIM)) * 0.3).astype(np.float32)
        embed[:, PAD] = 0
        m = len(words.bias)
        return Network(embed, np.zeros((m, DIM), np.float32), words.bias.copy(), np.zeros(m, np.float32))

    def pack(self) -> bytes:
        return np.concatenate([x.ravel() for x in (self.embed, self.out, self.bias, self.met)]).astype("<f4").tobytes()

    @staticmethod
    def unpack(data: bytes) -> "Network":
        flat = np.frombuffer(data, "<f4")
        a = len(OFFSETS) * (V + 1) * DIM
        m = (len(flat) - a) // (DIM + 2)
        return Network(flat[:a].reshape(len(OFFSETS), V + 1, DIM).copy(), flat[a : a + m * DIM].reshape(m, DIM).copy(), flat[a + m * DIM : a + m * (DIM + 1)].copy(), flat[a + m * (DIM + 1) :].copy())

    def hidden(self, context: np.ndarray) -> np.ndarray:
        hidden = self.embed[0].take(context[:, 0], 0)
        for k in range(1, len(OFFSETS)):
            hidden += self.embed[k].take(context[:, k], 0)
        return np.tanh(hidden, out=hidden)

    def logp(self, words: Vocabulary, context: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Log-probability of each leaf in its window."""
        owner, node, sign, _ = words.paths(leaf)
        z = (np.einsum("ij,ij->i", self.hidden(context).take(owner, 0), self.out.take(node, 0)) + self.bias[node]) * sign
        return np.bincount(owner, weights=np.minimum(z, 0) - np.log1p(np.exp(-np.abs(z))), minlength=len(leaf))

    def learn(self, words: Vocabulary, context: np.ndarray, leaf: np.ndarray, rate: float, node_rate: float) -> None:
        """One step of gradient descent on the negative log-probability of the leaves; a node's step is that of at most
        32 decisions."""
        owner, node, sign, first = words.paths(leaf)
        if not len(node):  # one leaf is certain
            return
        hidden = self.hidden(context)
        near, weight = hidden.take(owner, 0), self.out.take(node, 0)
        grad = sign / (1 + np.exp(np.clip((np.einsum("ij,ij->i", near, weight) + self.bias[node]) * sign, -60, 60)))
        weight *= grad[:, None]
        back = np.add.reduceat(weight, first, axis=0) * (1 - hidden * hidden) * np.float32(rate / len(leaf))
        order = np.argsort(node, kind="stable")
        node, grad = node[order], grad[order]
        begins = np.flatnonzero(np.diff(node, prepend=-1))
        met, times = node[begins], np.diff(begins, append=len(node))
        scale = np.float32(node_rate) / np.maximum(1, times / 32).astype(np.float32)
        near = near.take(order, 0)
        near *= grad[:, None]
        self.out[met] += np.add.reduceat(near, begins, axis=0) * scale[:, None]
        self.bias[met] += np.add.reduceat(grad, begins) * scale
        self.met[met] += times
        for k in range(len(OFFSETS)):
            step = np.stack([np.bincount(context[:, k], weights=back[:, d], minlength=V + 1) for d in range(DIM)], axis=1)
            step[PAD] = 0
            self.embed[k] += step.astype(np.float32)


def train(tokens: DataFrame, words: Vocabulary, rate: float = 2.0, node_rate: float = 0.02, fan_in: int = 64) -> Network:
    """tokens: as tokenized gives them, a written table. They are dealt by a hash of id and words to groups of about
    GROUP words and read in the order of that hash, so that nothing depends on files, partitions or cores. Every group
    starts from the same network and passes once over every word of its documents. The networks are averaged (embeddings
    by words, nodes by how often they were met) fan_in at a time in rounds of grouped tasks, so neither one task nor the
    driver takes in more than fan_in of them however many groups there are."""
    mark = F.xxhash64("doc_id", "ids", "leaves")
    filled = tokens.where(F.octet_length("ids") > 0).select("ids", "leaves", mark.alias("mark"))
    n_words = filled.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0]
    dealt = filled.withColumn("part", F.pmod("mark", F.lit(max(1, -(-n_words // GROUP)))))

    def run(rows: pa.Table) -> pa.Table:
        net, part = Network.start(words), rows.column("part")[0].as_py()
        rows = rows.take(np.argsort(rows.column("mark").to_numpy(), kind="stable"))
        line, at = windows(rows.column("ids").to_pylist())
        leaf = np.frombuffer(b"".join(rows.column("leaves").to_pylist()), "<u2")
        for i in range(0, len(at), BATCH):
            net.learn(words, _context(line, at[i : i + BATCH]), leaf[i : i + BATCH], rate, node_rate)
        return pa.table({"part": pa.array([part], pa.int64()), "seen": pa.array([len(at)], pa.int64()), "net": pa.array([net.pack()], pa.binary())})

    def average(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("part").to_numpy())
        seen, start = rows.column("seen").to_numpy(), Network.start(words)
        embed, out, bias, met = (np.zeros(x.shape) for x in (start.embed, start.out, start.bias, start.met))
        for i in order:
            net = Network.unpack(rows.column("net")[int(i)].as_py())
            embed += net.embed * (seen[i] / seen.sum())
            out, bias, met = out + net.out * net.met[:, None], bias + net.bias * net.met, met + net.met
        known = np.maximum(met, 1)
        mean = Network(embed, np.where(met[:, None] > 0, out / known[:, None], start.out), np.where(met > 0, bias / known, start.bias), met)
        return pa.table({"part": pa.array([rows.column("part").to_numpy().min() // fan_in], pa.int64()), "seen": pa.array([seen.sum()], pa.int64()), "net": pa.array([mean.pack()], pa.binary())})

    schema = "part long, seen long, net binary"
    nets = materialize(dealt.groupBy("part").applyInArrow(run, schema), "lm-nets")
    while (n := nets.count()) > 1:
        nets = materialize(nets.groupBy(F.floor(F.col("part") / fan_in).alias("group")).applyInArrow(average, schema), "lm-nets")
    return Network.unpack(nets.first()["net"]) if n else Network.start(words)


def score(tokens: DataFrame, counts: DataFrame, words: Vocabulary, net: Network) -> DataFrame:
    """doc_id, n_tokens, log_prob (sum over the words of the log-probability of each given both sides), mean_log_prob
    (null without words). tokens: as tokenized gives them, and row, which tells rows apart; counts: word, n, which give
    the words that share a leaf their shares in a join."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids = [b.as_py() for b in batch.column(2)]
            size = np.array([len(x) for x in ids], dtype=np.int64)
            line, at = windows(ids)
            leaf = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2")
            logp = np.empty(len(at))
            for i in range(0, len(at), BATCH):
                logp[i : i + BATCH] = net.logp(words, _context(line, at[i : i + BATCH]), leaf[i : i + BATCH])
            logp -= np.where(leaf == len(words.known), np.log(max(1, words.beyond)), 0)
            total = np.bincount(np.repeat(np.arange(len(ids)), size), weights=logp, minlength=len(ids)).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(total)], names=["row", "doc_id", "n_tokens", "by_tree"])

    scored = tokens.select("row", "doc_id", "ids", "leaves").mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, by_tree double")
    # Whole numbers add up alike in any order.
    part = F.round(F.log("n") * 2.0**32).cast("long")
    shares = tokens.select("row", F.explode("beyond").alias("word")).join(counts, "word").groupBy("row").agg((F.sum(part) / 2.0**32).alias("shares"))
    out = scored.join(shares, "row", "left").withColumn("log_prob", F.col("by_tree") + F.coalesce("shares", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))


def score_documents(docs: DataFrame, known: int = KNOWN) -> DataFrame:
    """docs: doc_id, text; other columns are ignored. A row a row: doc_id, n_tokens, log_prob, mean_log_prob.

    Counts, vocabulary and the network come from all documents, and do not depend on how the table is cut into files or
    partitions. Null and empty texts have no words and log_prob 0; whole texts count, however long; repeated rows score
    alike; words of equal counts are known by their hash; an empty table gives no rows."""
    docs = docs.select("doc_id", "text")
    counts = materialize(word_counts(docs), "lm-words")
    words = vocabulary(counts, known)
    tokens = materialize(tokenized(docs, words).withColumn("row", F.monotonically_increasing_id()), "lm-tokens")
    with tidy(docs.sparkSession):
        net = train(tokens, words)
    return score(tokens, counts, words, net)


def op3_score_documents(spark, sf_dir: str) -> DataFrame:
    """All documents scored by the network that is trained on all documents."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
