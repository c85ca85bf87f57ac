"""Sharding by balanced label propagation, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, positions


def _best(counts: Column, shards: int, offset: Column) -> Column:
    """Index of the largest entry of an array of one count a shard; ties go to the first at or after offset."""
    order = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.pmod(i + offset, F.lit(shards)).cast("int"))
    top = F.array_max(counts)
    return F.element_at(F.filter(order, lambda s: F.get(counts, s) == top), 1)


def propagate(linked: DataFrame, shards: int, room: list[float], rounds: int = 6, split_above: float = 0.0) -> DataFrame:
    """linked: node, size, community (documents of one community are linked), shard. Returns it with new shards.

    Each round counts every community's bytes by shard (partially aggregated before the shuffle), joins the counts back
    to the documents, and lets them propose to move to the shard that holds most of their community among those with
    room, if it holds as much of it as their own. A shard accepts as much as its room (bytes) allows: where the
    proposals exceed it, a hash draws that share of the communities, and of the single documents where a community
    exceeds split_above bytes (a shard's room); the rest of such a community then gathers in the next shard. The driver sees the shards'
    loads and demands only. A community of any size is a few numbers on its own side of the join; its documents stay
    in as many tasks as the skew-join rule of Spark gives them."""
    state = linked
    for turn in range(rounds):
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
        free = [room[s] - load.get(s, 0) for s in range(shards)]
        held = [F.sum(F.when(F.col("shard") == s, F.col("size")).otherwise(0)).alias(f"s{s}") for s in range(shards)]
        votes = state.groupBy("community").agg(*held)
        counts = F.array(*(F.col(f"s{s}") for s in range(shards)))
        spare = F.array(*(F.col(f"s{s}") if free[s] > 0.01 * room[s] else F.lit(-1).cast("long") for s in range(shards)))
        votes = votes.select("community", counts.alias("held"), _best(spare, shards, F.pmod(F.xxhash64("community"), F.lit(shards)).cast("int")).alias("best"), reduce(lambda a, b: a + b, (F.col(f"s{s}") for s in range(shards))).alias("bytes"))
        # best is one shard a community, so moving on a tie cannot go in circles.
        better = F.get("held", F.col("best")) >= F.get("held", F.col("shard"))
        moves = materialize(state.join(votes, "community").withColumn("asks", (F.col("best") != F.col("shard")) & better), f"shards-{turn}")
        came = {r["best"]: r["n"] for r in moves.where("asks").groupBy("best").agg(F.sum("size").alias("n")).collect()}
        if not came:
            break
        share = [min(1.0, max(0.0, free[s]) / came[s]) if came.get(s) else 0.0 for s in range(shards)]
        draw = lambda *of: F.pmod(F.xxhash64(*of, F.lit(turn)), F.lit(1_000_000)) / 1e6
        ticket = F.when(F.col("bytes") > split_above, draw("node", "community")).otherwise(draw("community"))
        accepted = F.col("asks") & (ticket < F.get(F.array(*(F.lit(x) for x in share)), F.col("best")))
        state = moves.select("node", "size", "community", F.when(accepted, F.col("best")).otherwise(F.col("shard")).alias("shard"))
    return state


def _laid(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df (keys, node, size, community) with first and before: the bytes of all communities that lie earlier, and of all
    documents that do; and bytes, its community's. Communities lie side by side in a fixed shuffled order and are summed
    before they are ordered, so one of any size takes many tasks."""
    each = materialize(df.groupBy(*keys, "community").agg(F.sum("size").alias("bytes")), f"{name}-sums")
    starts = positions(each, keys, ["community"], {"first": F.col("bytes")}).select(*keys, "community", "bytes", "first")
    inside = positions(df, [*keys, "community"], ["node", "size"], {"inner": F.col("size")})
    return inside.join(starts, [*keys, "community"]).withColumn("before", F.col("first") + F.col("inner")).drop("inner")


def balanced_shards(docs: DataFrame, shards: int = 8, rounds: int = 6) -> DataFrame:
    """docs: node (any type), size (long, positive), community (null: linked to nothing). Returns node, size, shard, slot.

    Law: bytes. Linked documents move towards their community's fullest shard while it has room. Then whole communities
    that lie beyond a shard's even share of the bytes leave it (of one that is larger than the share, what lies beyond),
    and with all unlinked documents they fill the shards up in a fixed shuffled order, side by side, so that shards
    differ by about the largest document and at most one community a border is cut. slot is gapless from 0 in each
    shard. Equal rows are shared out one by one, ties in arbitrary order. Empty tables give empty results."""
    slim = materialize(docs.select("node", "size", "community"), "shards-docs")
    rows, total = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    even = total / shards
    groups = slim.where("community is not null").groupBy("community").agg(F.count("*").alias("n")).where("n > 1").select("community")
    tagged = slim.join(groups.withColumn("known", F.lit(True)), "community", "left")
    alone = F.concat(F.lit("alone "), F.hex(F.xxhash64("node", "size")))
    tagged = materialize(tagged.select("node", "size", F.coalesce("known", F.lit(False)).alias("linked"), F.when(F.col("known"), F.col("community").cast("string")).otherwise(alone).alias("community")), "shards-tagged")
    first = tagged.where("linked").withColumn("shard", F.pmod(F.xxhash64("node", "community"), F.lit(shards)).cast("int")).drop("linked")
    linked = materialize(propagate(first, shards, [even * 0.99] * shards, rounds, even), "shards-linked")
    stacked = materialize(_laid(linked, ["shard"], "shards-stacked"), "shards-stacked")
    stays = F.when(F.col("bytes") > even, F.col("before") + F.col("size") <= even).otherwise(F.col("first") + F.col("bytes") <= even)
    columns = ["node", "size", "community"]
    pool = tagged.where("not linked").select(*columns).unionByName(stacked.where(~stays).select(*columns))
    kept = stacked.where(stays).select("node", "size", "shard")
    load = {r["shard"]: r["n"] for r in kept.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    pool = _laid(materialize(pool, "shards-pool"), [], "shards-pool")
    edges, at = [], 0.0
    for s in range(shards):
        at += max(0.0, even - load.get(s, 0))
        edges.append(at)
    middle = F.col("before") + F.col("size") / 2
    falls = reduce(lambda c, s: c.when(middle < edges[s], F.lit(s)), range(1, shards), F.when(middle < edges[0], F.lit(0))).otherwise(F.lit(shards - 1))
    placed = materialize(kept.unionByName(pool.select("node", "size", falls.alias("shard"))), "shards-placed")
    return positions(placed, ["shard"], ["node", "size"], {"slot": F.lit(1)}, rows)


def op9_shard_documents(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, law bytes; documents of equal texts (md5 and length) are linked.
    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null)."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.struct("doc_id", F.crc32(text).alias("crc")).alias("node"), (F.octet_length(text) + 1).cast("long").alias("size"), F.when(F.col("text").isNotNull(), F.md5(text)).alias("community"))
    out = balanced_shards(docs)
    return out.select("node.doc_id", "size", F.col("node.crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
