"""Ranked lexical search over inverted treaps: doc_id search order, impact heap order."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, materialize, positions
from .hashing import mix

#: Each byte as it stands in a term: A-Z become small, letters, digits and bytes from 0x80 stay, all others end it.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: A term in SQL, whose regular expressions read code points.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LAST = np.iinfo(np.int64).max


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a whole UTF-8 text, with repeats."""
    return text.translate(_FOLD).split()


def build_index(docs: DataFrame, vocabulary: frozenset[bytes] | None = None, shard_docs: int = 8_192, shard_bytes: int = 32 << 20) -> DataFrame:
    """docs: doc_id (whole number), text. A row a shard of the index: n_docs, n_terms (of all its documents that have a
    term), ids, lengths (of its documents that are indexed, by doc_id, null last), postings (term, places in ids, tf).

    A task cuts the documents that stream by into shards of so many documents or bytes, so no document moves, a term
    of any frequency is split by shard, and a task holds one shard. Only terms of vocabulary are indexed (null: all);
    documents are counted all the same. Null and termless texts are in no shard; repeated rows are documents of their
    own; an empty table gives no rows."""

    def run(batches):
        def pack():
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            at = np.empty(len(ids), np.int32)
            at[order] = np.arange(len(ids), dtype=np.int32)
            rows = []
            for term, (where, tf) in held.items():
                place = at[where]
                by = np.argsort(place)
                rows.append({"term": term, "at": place[by], "tf": np.array(tf, np.int32)[by]})
            arrays = [pa.array([v], t) for v, t in zip((n_docs, n_terms, [ids[i] for i in order], [lengths[i] for i in order], rows), types)]
            return pa.RecordBatch.from_arrays(arrays, names=["n_docs", "n_terms", "ids", "lengths", "postings"])

        posting = pa.struct([("term", pa.binary()), ("at", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])
        types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(posting))
        ids, lengths, held, n_docs, n_terms, size = [], [], {}, 0, 0, 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or b""
                words = terms_of(text)
                if not words:
                    continue
                n_docs, n_terms, size = n_docs + 1, n_terms + len(words), size + len(text)
                counts = Counter(words)
                known = counts.keys() if vocabulary is None else counts.keys() & vocabulary
                if known:
                    for term in known:
                        entry = held.get(term)
                        if entry is None:
                            entry = held[term] = ([], [])
                        entry[0].append(len(ids))
                        entry[1].append(counts[term])
                    ids.append(doc)
                    lengths.append(len(words))
                if n_docs >= shard_docs or size >= shard_bytes:
                    yield pack()
                    ids, lengths, held, n_docs, n_terms, size = [], [], {}, 0, 0, 0
        if n_docs:
            yield pack()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text")).mapInArrow(run, "n_docs long, n_terms long, ids array<long>, lengths array<long>, postings array<struct<term: binary, at: array<int>, tf: array<int>>>")


@dataclass
class Treaps:
    """The treaps of a shard, one a term, in common arrays: places (search order) and impacts (heap order) of their
    nodes, left and right children (-1: none), the root of each term. Equal impacts stand in a hashed order, so
    that depth is logarithmic unless the impacts themselves rise or fall with doc_id."""

    place: np.ndarray
    impact: np.ndarray
    left: np.ndarray
    right: np.ndarray
    root: dict[bytes, int]

    @classmethod
    def build(cls, terms: list[bytes], sizes: np.ndarray, place: np.ndarray, impact: np.ndarray) -> Treaps:
        """Nodes of each term follow each other by place; a stack holds the right spine of the tree so far."""
        n = len(place)
        ends = np.cumsum(sizes)
        order = np.lexsort((mix(np.arange(n, dtype=np.uint64)), impact))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        ranks, left, right, roots = rank.tolist(), [-1] * n, [-1] * n, {}
        at = 0
        for term, end in zip(terms, ends.tolist()):
            spine = []
            for i in range(at, end):
                own, under = ranks[i], -1
                while spine and ranks[spine[-1]] < own:
                    under = spine.pop()
                left[i] = under
                if spine:
                    right[spine[-1]] = i
                spine.append(i)
            if spine:
                roots[term] = spine[0]
            at = end
        return cls(place, impact, np.array(left, np.int64), np.array(right, np.int64), roots)


@dataclass
class Best:
    """The k best documents found so far of each of n queries: score, then the smaller doc_id (null last)."""

    n: int
    k: int
    score: np.ndarray = field(init=False)
    doc: np.ndarray = field(init=False)
    null: np.ndarray = field(init=False)

    def __post_init__(self):
        self.score = np.zeros((self.n, self.k), np.int64)
        self.doc = np.full((self.n, self.k), _LAST)
        self.null = np.zeros((self.n, self.k), bool)

    def beats(self, q: np.ndarray, score: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a document of this score and id would be among the k best of query q."""
        worst = self.score[q, -1]
        return (score > worst) | ((score == worst) & (score > 0) & (doc < self.doc[q, -1]))

    def add(self, q: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        good = self.beats(q, score, doc)
        if not good.any():
            return
        q, score, doc, null = q[good], score[good], doc[good], null[good]
        touched = np.unique(q)
        rows = np.concatenate((np.repeat(touched, self.k), q))
        scores, docs, nulls = (np.concatenate((mine[touched].ravel(), new)) for mine, new in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((nulls, docs, -scores, rows))
        rows = rows[order]
        first = np.searchsorted(rows, touched)
        taken = order[first[:, None] + np.arange(self.k)]
        self.score[touched], self.doc[touched], self.null[touched] = scores[taken], docs[taken], nulls[taken]


def traverse(shard: Treaps, queries: list[list[int]], ids: np.ndarray, null: np.ndarray, best: Best, room: int = 1 << 18) -> int:
    """Search all treaps of each query at once; queries[q] lists the roots of its terms. Adds to best, returns how many
    nodes were looked at.

    A range of documents carries, for each term, the highest node within it. The sum of their impacts bounds every
    document of the range, so a range that cannot enter the k best is left with all its subtrees. Else the document of
    the node of largest impact is scored, by splitting every treap of the range at it; the halves of the split are
    the nodes of the two ranges beside it. All ranges of all queries go down a level together; where their nodes exceed
    room, one half waits, so memory is bounded by room and the depth."""
    place, impact, left, right = shard.place, shard.impact, shard.left, shard.right
    sizes = np.array([len(roots) for roots in queries], np.int64)
    asked = np.flatnonzero(sizes)
    if not len(asked):
        return 0
    looked = 0
    waiting = [(asked, np.zeros(len(asked), np.int64), np.full(len(asked), len(ids) - 1), sizes[asked], np.concatenate([queries[i] for i in asked]).astype(np.int64))]
    while waiting:
        q, lo, hi, size, node = waiting.pop()
        start = np.cumsum(size) - size
        if len(node) > room and len(q) > 1:
            half = max(1, int(np.searchsorted(start, len(node) // 2)))
            cut = int(start[half]) if half < len(q) else len(node)
            waiting += [(q[half:], lo[half:], hi[half:], size[half:], node[cut:]), (q[:half], lo[:half], hi[:half], size[:half], node[:cut])] if half < len(q) else [(q[:-1], lo[:-1], hi[:-1], size[:-1], node[: start[-1]]), (q[-1:], lo[-1:], hi[-1:], size[-1:], node[start[-1] :])]
            continue
        looked += len(node)
        weight = impact[node]
        alive = best.beats(q, np.add.reduceat(weight, start), ids[lo])
        if not alive.any():
            continue
        kept = np.repeat(alive, size)
        q, lo, hi, size, node, weight = q[alive], lo[alive], hi[alive], size[alive], node[kept], weight[kept]
        start = np.cumsum(size) - size
        entry = np.repeat(np.arange(len(q)), size)
        top = np.flatnonzero(weight == np.maximum.reduceat(weight, start)[entry])
        pivot = np.empty(len(q), np.int64)
        pivot[entry[top[::-1]]] = place[node[top[::-1]]]
        score = np.zeros(len(q), np.int64)
        below, above = np.full(len(node), -1), np.full(len(node), -1)
        # The split: each treap's search path to the pivot; the first nodes beside it within the range top the halves.
        at, path = np.arange(len(node)), node
        while len(at):
            mine = entry[at]
            x, d = place[path], pivot[mine]
            low, high = x < d, x > d
            same = ~(low | high)
            if same.any():
                np.add.at(score, mine[same], impact[path[same]])
                # Below the pivot itself both ways go on: to the right in its left subtree, to the left in its right one.
                for here, side, turn, within in ((below, left, right, lambda y, e: y >= lo[e]), (above, right, left, lambda y, e: y <= hi[e])):
                    who = at[same]
                    open_ = here[who] < 0
                    who, step = who[open_], side[path[same][open_]]
                    while len(who):
                        who, step = who[step >= 0], step[step >= 0]
                        fits = within(place[step], entry[who])
                        here[who[fits]] = step[fits]
                        who, step = who[~fits], turn[step[~fits]]
            first = low & (below[at] < 0) & (x >= lo[mine])
            below[at[first]] = path[first]
            first = high & (above[at] < 0) & (x <= hi[mine])
            above[at[first]] = path[first]
            path = np.where(low, right[path], np.where(high, left[path], -1))
            on = path >= 0
            at, path = at[on], path[on]
        best.add(q, score, ids[pivot], null[pivot])
        parts = []
        for found, a, b in ((below, lo, pivot - 1), (above, pivot + 1, hi)):
            there = found >= 0
            count = np.bincount(entry[there], minlength=len(q))
            some = count > 0
            parts.append((q[some], a[some], b[some], count[some], found[there]))
        joined = tuple(np.concatenate(p) for p in zip(*parts))
        if len(joined[0]):
            waiting.append(joined)
    return looked


def _shard_treaps(batch: pa.RecordBatch, i: int, n_docs: int, n_terms: int, weights: dict[bytes, int]) -> tuple[Treaps, np.ndarray, np.ndarray]:
    """The treaps of one index row for the terms in weights, its doc_ids and which are null."""
    column = lambda name: batch.column(batch.schema.get_field_index(name))[i].values
    ids = column("ids")
    null = np.asarray(ids.is_null())
    ids = np.asarray(ids.fill_null(_LAST))
    lengths = np.asarray(column("lengths"))
    sizes, back = np.unique(lengths, return_inverse=True)
    m = np.array([50 + (50 * int(n) * n_docs) // n_terms for n in sizes], np.int64)[back]  # in Python's integers, which do not overflow
    terms, at, tf = column("postings").flatten()
    terms = terms.to_pylist()
    place, times = np.asarray(at.flatten()).astype(np.int64), np.asarray(tf.flatten()).astype(np.int64)
    counts = np.asarray(at.value_lengths()).astype(np.int64)
    weight = np.array([weights.get(t, 0) for t in terms], np.int64)
    keep = np.repeat(weight > 0, counts)
    impact = np.repeat(weight, counts) * ((1_000_000_000 * times) // (1_000 * times + 20 * m[place]))
    used = weight > 0
    return Treaps.build([t for t, u in zip(terms, used) if u], counts[used], place[keep], impact[keep]), ids, null


def search(index: DataFrame, queries: list[list[bytes]], weights: dict[bytes, int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """queries: distinct terms of each. Returns query (its place in queries), doc_id, score: the k best of each task.

    Each index row is searched where it lies; a task carries its k best from shard to shard, so the bounds tighten."""

    def run(batches):
        best = Best(len(queries), k)
        for batch in batches:
            for i in range(batch.num_rows):
                shard, ids, null = _shard_treaps(batch, i, n_docs, n_terms, weights)
                traverse(shard, [[shard.root[t] for t in terms if t in shard.root] for terms in queries], ids, null, best)
        q, at = np.nonzero(best.score > 0)
        docs = pa.array(best.doc[q, at], pa.int64(), mask=best.null[q, at])
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), docs, pa.array(best.score[q, at], pa.int64())], names=["query", "doc_id", "score"])

    return index.mapInArrow(run, "query int, doc_id long, score long")


def weight_of(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, block_bytes: int = 8 << 20) -> DataFrame:
    """docs: doc_id, text; items: item_id, text; other columns are ignored. Returns item_id, rank, doc_id, score: the k
    documents of highest score above 0 of each item; equal scores by doc_id (null last).

    Items go through the documents in blocks of about block_bytes of distinct terms (at least one item each), so what a task is
    sent is bounded by that and the largest item. Each block is one pass over all documents that indexes its terms,
    sums over the index for the weights, and one search. Items that share an item_id (null is one) are one, with
    the terms of all; items without terms have no rows. Repeated documents rank side by side; empty tables give no rows."""
    spark = docs.sparkSession
    item = items.schema["item_id"].dataType.simpleString()

    def terms(batches):
        for batch in batches:
            got = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1)) for t in set(terms_of(text.as_py() or b""))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], batch.schema.field(0).type), pa.array([t for _, t in got], pa.binary())], names=["item_id", "term"])

    each = items.select("item_id", F.encode("text", "UTF-8").alias("text")).mapInArrow(terms, f"item_id {item}, term binary").distinct()
    asked = materialize(each.groupBy("item_id").agg(F.sum(F.length("term") + 1).alias("bytes"), F.sort_array(F.collect_list("term")).alias("terms")), "ranked-items")
    placed = materialize(positions(asked, [], ["item_id"], {"before": F.col("bytes")}), "ranked-placed")
    last = placed.agg(F.max((F.col("before") / block_bytes).cast("long"))).first()[0]
    found = []
    for block in range(0 if last is None else last + 1):
        rows = placed.where((F.col("before") / block_bytes).cast("long") == block).select("item_id", "terms").collect()
        if not rows:
            continue
        queries = [[bytes(t) for t in r["terms"]] for r in rows]
        vocabulary = frozenset(t for q in queries for t in q)
        index = materialize(build_index(docs, vocabulary), "ranked-index")
        n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_docs:
            drop(index)
            continue
        df = index.select(F.explode("postings").alias("p")).groupBy("p.term").agg(F.sum(F.size("p.at")).alias("df")).collect()
        weights = {bytes(r["term"]): w for r in df if (w := weight_of(n_docs, r["df"])) > 0}
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"query int, item_id {item}")
        hits = materialize(search(index, queries, weights, n_docs, n_terms, k).join(names, "query"), "ranked-hits")
        drop(index)
        found.append(hits.select("item_id", "doc_id", "score"))
    drop(asked, placed)
    if not found:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for each benchmark item."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return rank_documents(docs, items)


OP11_SQL = rf"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS r, unnest(regexp_extract_all(text, '{TERM}')) AS x FROM documents),
low AS (SELECT doc_id, r, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM t),
d AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM low GROUP BY r),
total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM low GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (
  SELECT DISTINCT item_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '{TERM}')) AS x FROM benchmark)),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, total),
scored AS (
  SELECT q.item_id, d.r, any_value(d.doc_id) AS doc_id,
    CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * d.n * big_n) // big_l)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d ON d.r = tf.r, total GROUP BY q.item_id, d.r),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""
