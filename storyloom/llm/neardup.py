"""Near-duplicate classes: DartMinHash bands find candidates, exact Jaccard on shingle sets decides."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, materialize, tidy, unused
from .hashing import band_keys, dart_signature, shingles


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, copy (md5 of the text), shingle_set (16 bytes that name it; null for a text
    without a word), n_shingles and bands (array<bigint>)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), words)
                sizes.append(len(s))
                nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(band_keys(dart_signature(s, bands * rows), bands) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "copy", "shingle_set", "n_shingles", "bands"])

    return docs.select("doc_id", "text", F.md5(F.encode("text", "UTF-8")).alias("copy")).mapInArrow(run, f"doc_id {kind}, copy string, shingle_set binary, n_shingles long, bands array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """Shingle sets of the nodes in wanted (node, doc_id, copy): node, shingles."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t.as_py(), words).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    keyed = docs.select("doc_id", "text", F.md5(F.encode("text", "UTF-8")).alias("copy"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("copy") == F.col("__copy"))
    return keyed.join(wanted.select("node", F.col("doc_id").alias("__id"), F.col("copy").alias("__copy")), same).select("node", "text").mapInArrow(run, "node long, shingles array<bigint>").dropDuplicates(["node"])


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns node, label: the least node of each node's component, by alternating large-star and
    small-star rounds until every node points at one node that points nowhere. A round is two grouped minima and two
    joins, and shortens paths by at least half."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("out")), F.struct(F.col("v").alias("x"), F.lit(0).alias("out")))))
        if ends.groupBy("x").agg(F.sum("out").alias("o"), F.count("*").alias("n")).where("o > 1 OR (o = 1 AND n > 1)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, edges = edges, materialize(small, "stars")
        drop(before)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of pairs (a, b) whose sets have at least that Jaccard similarity."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(one, "a").join(two, "b").where(both >= F.lit(least) * (F.size("sa") + F.size("sb") - both)).select(*pairs.columns)


def _split(members: DataFrame, sets: DataFrame, similarity: float, crowd: int) -> DataFrame:
    """members (key, node, n): a key of more than crowd nodes, such as a passage in many texts makes, is split by the
    rarest shingles of its nodes. Sets of at least that similarity share one of their n - similarity * n + 1 rarest, in
    one order of all shingles, so no similar pair is parted, however large a key stays."""
    sizes = members.groupBy("key").agg(F.count("*").alias("c"))
    sized = members.join(sizes, "key")
    crowded = sized.where(F.col("c") > crowd).select("key", "node", "n")
    each = sets.join(crowded.select("node").distinct(), "node").select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    counted = each.join(each.groupBy("shingle").agg(F.count("*").alias("f")), "shingle")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("f", "shingle"))
    prefix = counted.withColumn("r", rank).where(F.col("r") <= F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-6) + 1)
    split = crowded.join(prefix.where("f > 1").select("node", "shingle"), "node").select(F.xxhash64("key", "shingle").alias("key"), "node", "n")
    return sized.where(F.col("c") <= crowd).select("key", "node", "n").unionByName(split)


class _Classes:
    """Labels of nodes, merged round by round. A band key's nodes are never paired with each other while they are many:
    a round pairs each key's nodes with one of them."""

    def __init__(self, sets: DataFrame, labels: DataFrame, similarity: float):
        self.sets, self.labels, self.similarity, self.tested = sets, labels, similarity, None

    def open(self, members: DataFrame, name: str) -> DataFrame:
        """members with their labels, of keys whose nodes are not all of one class."""
        placed = members.join(self.labels, "node")
        span = placed.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("key")
        return materialize(placed.join(span, "key").select("key", "node", "n", "label"), name)

    def _merge(self, pairs: DataFrame) -> None:
        """Verify pairs (a, b, na, nb, la, lb) that are new and of fitting sizes, and join the classes of the links."""
        fits = F.least("na", "nb") >= F.lit(self.similarity) * F.greatest("na", "nb")
        new = pairs.where(fits).select("a", "b", "la", "lb").distinct()
        if self.tested is not None:
            new = new.join(self.tested, ["a", "b"], "left_anti")
        new = materialize(new, "dup-pairs")
        found = materialize(_verified(new, self.sets, self.similarity), "dup-links")
        pairs_tested = new.select("a", "b")
        self.tested = pairs_tested if self.tested is None else self.tested.unionByName(pairs_tested)
        self._join_classes(found.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        drop(found)

    def _join_classes(self, links: DataFrame) -> None:
        """links: a, b, labels of classes that are one."""
        edges = components(links).select(F.col("node").alias("label"), F.col("label").alias("to"))
        before = self.labels
        self.labels = materialize(before.join(edges, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "dup-labels")
        drop(before)

    def hub_round(self, placed: DataFrame, turn: int) -> DataFrame:
        """Pairs each key's nodes with its hub, the least by a hash, and returns members without the hubs: a hub has met
        all of its key, so its pairs there are settled one way or the other."""
        hubs = placed.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "label")).alias("hub"))
        met = placed.join(hubs, "key").where(F.col("label") != F.col("hub.label"))
        one, two = F.struct("node", "n", "label"), F.struct("hub.node", "hub.n", "hub.label")
        pairs = met.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y"))
        self._merge(pairs.select(F.col("x.node").alias("a"), F.col("x.n").alias("na"), F.col("x.label").alias("la"), F.col("y.node").alias("b"), F.col("y.n").alias("nb"), F.col("y.label").alias("lb")))
        return placed.join(hubs.select("key", F.col("hub.node").alias("node")), ["key", "node"], "left_anti").select("key", "node", "n")

    def last_round(self, placed: DataFrame, block: int) -> None:
        """Compares all nodes of different classes that share a key, a pair of blocks of at most about `block` nodes and
        BLOCK_SHINGLES shingles in one task, which gives back a class and its least linked one for each class that it
        merges, and no pairs."""
        sized = placed.join(placed.groupBy("key").agg(_blocks(block).alias("blocks")), "key")
        own = sized.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = own.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label")
        least = self.similarity

        def compare(rows: pa.Table) -> pa.Table:
            own, label = rows.column("own").to_numpy(), rows.column("label").to_numpy()
            sets = rows.column("shingles").combine_chunks()
            flat, ends = sets.values.to_numpy(), sets.offsets.to_numpy()
            size = np.diff(ends)
            found, at = np.unique(flat, return_inverse=True)
            order = np.argsort(at, kind="stable")
            at, owner = at[order], np.repeat(np.arange(len(size)), size)[order]
            cross = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
            shared = np.zeros((len(size), len(size)), dtype=np.float32)
            for low in range(0, len(found), 8192):  # a slice of the shingles at a time, so that it fits
                inside = slice(*np.searchsorted(at, (low, low + 8192)))
                has = np.zeros((len(size), min(8192, len(found) - low)), dtype=np.float32)
                has[owner[inside], at[inside] - low] = 1
                shared += has @ has.T
            alike = shared >= least * (size[:, None] + size[None, :] - shared) - 1e-6
            alike &= label[:, None] < label[None, :]
            if cross:
                alike &= own[:, None] != own[None, :]
            root = {int(x): int(x) for x in np.unique(label)}

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for x, y in np.unique(np.stack([label[x] for x in np.nonzero(alike)], axis=1).reshape(-1, 2), axis=0).tolist():
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
            merged = [(x, find(x)) for x in root if find(x) != x]
            return pa.table({"a": pa.array([x for x, _ in merged], pa.int64()), "b": pa.array([y for _, y in merged], pa.int64())})

        links = dealt.join(self.sets, "node").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")
        self._join_classes(materialize(links.distinct(), "dup-links"))


#: Shingles that one side of a pair of blocks holds, about; a larger set is a block of its own.
BLOCK_SHINGLES = 1 << 21


def _blocks(block: int):
    """Aggregate: into how many blocks the nodes of a key are cut, by their number and by their shingles."""
    return F.ceil(F.greatest(F.count("*") / block, F.sum("n") / BLOCK_SHINGLES)).cast("int")


def _across(placed: DataFrame, block: int) -> tuple[int, int]:
    """Rows of open keys, and the rows that comparing them in blocks takes."""
    each = placed.groupBy("key").agg(F.count("*").alias("c"), _blocks(block).alias("b"))
    rows, copies = each.agg(F.sum("c"), F.sum(F.col("c") * F.col("b"))).first()
    return rows or 0, copies or 0


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 20, rows: int = 4, block: int = 256, most_rounds: int = 8) -> DataFrame:
    """docs: doc_id, text; other columns are ignored. Returns a row a row: doc_id, copy (md5 of the text), class_id
    (least doc_id of the class; null where no row of it has one), kept (true for one row of each class).

    Texts with equal sets of word shingles are one node. Nodes that share a band are candidates; a link is a pair of
    nodes whose exact Jaccard similarity is at least similarity; a class is a connected component of links. Keys of
    a tenth, then a quarter, then all of the bands are compared, as far as their nodes are not of one class by then:
    in blocks, all pairs of a block pair inside one task. Where keys are so large that blocks would take more than four
    times their rows, rounds come first in which each key pairs its nodes with one hub; links are verified, classes
    merged and the hub leaves the key, so that large groups of near copies close early; what stays crowded is split by
    the rarest shingles, of which similar sets share one. No class lacks a link that a key shows. At 0.8, 20 bands of 4 miss a pair with probability 3e-5.

    A null text or one without a word is a class of its own; a shorter text than words is one shingle; repeated rows
    are one class; an empty table gives an empty result."""
    docs = docs.select("doc_id", "text")
    signed = materialize(signatures(docs, words, bands, rows), "dup-signed")
    sets_of = signed.where("shingle_set is not null").groupBy("shingle_set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "copy")).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    own = materialize(sets_of.withColumn("node", F.monotonically_increasing_id()), "dup-nodes")
    every = own.select("node", "n", F.posexplode("bands").alias("band", "key"))
    shared = materialize(every.join(every.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "key"), "dup-shared")
    alive = materialize(shared.select("node").distinct(), "dup-labels").withColumn("label", F.col("node"))
    sets = materialize(_sets(docs, alive.join(own.select("node", "first.doc_id", "first.copy"), "node"), words), "dup-sets")
    classes = _Classes(sets, alive, similarity)
    with tidy(docs.sparkSession):
        for upto in (max(1, bands // 10), max(1, bands // 4), bands):
            placed = classes.open(shared.where(F.col("band") < upto).select("key", "node", "n"), "dup-open")
            for turn in range(most_rounds + 1):
                n_open, copies = _across(placed, block)
                if not n_open:
                    break
                if turn == most_rounds or copies <= 4 * n_open:
                    if copies > 4 * n_open:  # still crowded
                        placed = classes.open(_split(placed.select("key", "node", "n"), sets, similarity, 8 * block), "dup-open")
                    classes.last_round(placed, block)
                    break
                placed = classes.open(classes.hub_round(placed, turn), "dup-open")
    named = own.select("node", "shingle_set", "first").join(classes.labels, "node", "left").select("shingle_set", "first", F.coalesce("label", "node").alias("label"))
    heads = named.groupBy("label").agg(F.min("first").alias("head"))
    found = named.join(heads, "label").select("shingle_set", "head")
    out = signed.select("doc_id", "copy", "shingle_set").join(found, "shingle_set", "left")
    alone = F.col("shingle_set").isNull()
    return out.select("doc_id", "copy", F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"), (alone | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & F.col("copy").eqNullSafe(F.col("head.copy")))).alias("kept"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each near-duplicate class, all columns kept; rows that agree in doc_id and text are one."""
    own, copy, md5 = unused(docs, "own_id", "copy", "md5")
    marks = near_duplicates(docs, **how).where("kept").select(F.col("doc_id").alias(own), F.col("copy").alias(copy)).distinct()
    keyed = docs.withColumn(md5, F.md5(F.encode("text", "UTF-8")))
    stays = keyed.join(marks, F.col("doc_id").eqNullSafe(F.col(own)) & F.col(md5).eqNullSafe(F.col(copy)), "left_semi")
    return stays.dropDuplicates(["doc_id", md5]).select(*docs.columns)


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, class_id (least doc_id of its near-duplicates), kept."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "class_id", "kept")
