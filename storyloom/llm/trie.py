"""Prefix trie of conversations by distributed MSD radix partitioning, finished by multikey quicksort."""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.tables import running

from .common import drop, materialize, positions

NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def encoded(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text. Returns conv_id, pos (from 0, by turn, null first, then role and text), id,
    bytes (of the text). A turn's id numbers the distinct (role, text); their digests, not the texts, are joined."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = turns.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    slim = running(plain, ["conv_id"], order, {"pos": F.lit(1)}, "trie-order").select("conv_id", "pos", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    slim = materialize(slim, "trie-turns")
    kinds = materialize(slim.select("digest").distinct(), "trie-kinds")
    kinds = positions(kinds, [], ["digest"], {"id": F.lit(1)})
    return slim.join(kinds, "digest").select("conv_id", "pos", "id", "bytes")


def rebuilt(turns: DataFrame, host: Column, head: Column) -> DataFrame:
    """turns: conv_id, pos, id, bytes; host, head: columns over conv_id. Each conversation becomes the first `head` turns
    of its host (all if fewer, none if absent), then its own turns from its `head`-th on. A host's first turns are
    joined to the conversations that it is host of; other turns stay where they are."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    every = sizes.select("conv_id", "n", host.alias("host"), head.alias("head"))
    hosts = sizes.select(F.col("conv_id").alias("host"), F.col("n").alias("host_n"))
    plan = materialize(every.join(hosts, "host", "left").select("conv_id", "host", "head", F.least("head", F.coalesce("host_n", F.lit(0))).alias("taken"), "n"), "trie-plan")
    top = plan.agg(F.coalesce(F.max("head"), F.lit(0))).first()[0]
    given = turns.where(F.col("pos") < top).withColumnRenamed("conv_id", "host").join(plan.where("taken > 0").select("conv_id", "host", "taken"), "host").where("pos < taken")
    own = turns.join(plan.select("conv_id", "head", "taken"), "conv_id").where("pos >= head").withColumn("pos", F.col("pos") - F.col("head") + F.col("taken"))
    columns = ["conv_id", "pos", "id", "bytes"]
    rows = materialize(given.select(*columns).unionByName(own.select(*columns)), "trie-rebuilt")
    totals = plan.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("head"))).alias("total"))
    drop(turns)
    return rows, totals


def multikey_quicksort(members: list[tuple[int, list[int], list[int]]], at: int) -> list[list]:
    """members: (conv_id, ids, bytes) of sequences that agree before their place 0, which is place `at` of the
    conversation. Nodes as [conv_id, depth, parent (index or None), n_convs, n_children, bytes, ends], parents first.

    A call parts its members by the id at one place into smaller, equal and larger ones; the equal ones are a node,
    and go on at the next place; members that have ended come first of all and are the ends of the node above."""
    nodes: list[list] = []
    calls = [(members, 0, None)]
    while calls:
        group, d, parent = calls.pop()
        ended = [m for m in group if len(m[1]) == d]
        if ended:
            if parent is not None:
                nodes[parent][6].extend(m[0] for m in ended)
            group = [m for m in group if len(m[1]) > d]
        if not group:
            continue
        pivot = group[len(group) // 2][1][d]
        less, same, more = [], [], []
        for m in group:
            x = m[1][d]
            (same if x == pivot else less if x < pivot else more).append(m)
        nodes.append([min(m[0] for m in same), at + d + 1, parent, len(same), 0, same[0][2][d], []])
        if parent is not None:
            nodes[parent][4] += 1
        calls += [(part, d, parent) for part in (more, less) if part]
        calls.append((same, d + 1, len(nodes) - 1))
    return nodes


def finish(rows: DataFrame) -> DataFrame:
    """rows: up, up_from (the bucket above), bucket, parent, from, conv_id, pos, id, bytes of buckets that fit in a task. A
    task reads its buckets one by one as they stream by, sorted, and emits their nodes, with up and up_from on a
    bucket's first node (else null)."""
    names = ["up", "up_from", *(x.split()[0] for x in NODE.split(", "))]

    def nodes_of(key, members):
        up, up_from, parent, at = key
        found = multikey_quicksort(members, at)
        leaves, saved = [0] * len(found), [0] * len(found)
        for i in range(len(found) - 1, -1, -1):
            conv, depth, above, n, children, size, ends = found[i]
            leaves[i] = leaves[i] or 1
            saved[i] += (n - 1) * size
            if above is not None:
                leaves[above] += leaves[i]
                saved[above] += saved[i]
        for i, (conv, depth, above, n, children, size, ends) in enumerate(found):
            sha = hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest() if ends else NOTHING
            top = above is None
            yield (up if top else None, up_from if top else None, conv, depth, parent if top else found[above][0], n, children, leaves[i], saved[i], sha)

    def run(batches):
        types = [pa.int64()] * 9 + [pa.string()]
        table = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        now, key, members, out = None, None, [], []
        for batch in batches:
            for up, up_from, bucket, parent, at, conv, _, turn, size in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (bucket, at):
                    if now:
                        out += nodes_of(key, members)
                    now, key, members = (bucket, at), (up, up_from, parent, at), []
                if not members or members[-1][0] != conv:
                    members.append((conv, [], []))
                members[-1][1].append(turn)
                members[-1][2].append(size)
            if out:
                yield table(out)
                out = []
        if now:
            yield table(list(nodes_of(key, members)))

    dealt = rows.repartition("bucket", "from").sortWithinPartitions("bucket", "from", "conv_id", "pos")
    return dealt.select("up", "up_from", "bucket", "parent", "from", "conv_id", "pos", "id", "bytes").mapInArrow(run, f"up long, up_from long, {NODE}")


def joined_hashes(ends: DataFrame, piece: int = 1 << 16) -> DataFrame:
    """ends: bucket, depth, conv_id. Returns bucket, depth, ends_sha256: SHA-256 of the ids, ascending and comma-joined.

    Ids are sorted by range, so those of one node take many tasks, each of which joins its run into pieces of text; the
    pieces, some thousand ids each, then stream through the hash, which needs them in order."""

    def join(batches):
        now, text, first, size = None, [], 0, 0
        out = []
        for batch in batches:
            for bucket, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (bucket, depth) or size >= piece:
                    if text:
                        out.append((*now, first, ",".join(text)))
                    now, text, first, size = (bucket, depth), [], conv, 0
                text.append(str(conv))
                size += len(text[-1]) + 1
            yield rows(out, 3, names=["bucket", "depth", "first", "text"])
            out = []
        if text:
            yield rows([(*now, first, ",".join(text))], 3, names=["bucket", "depth", "first", "text"])

    def rows(out, longs, names):
        columns = list(zip(*out)) or [()] * (longs + 1)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:longs]] + [pa.array(columns[longs], pa.string())], names=names)

    def digest(batches):
        now, sha, out = None, None, []
        for batch in batches:
            for bucket, depth, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (bucket, depth):
                    if now:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (bucket, depth), hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            yield rows(out, 2, names=["bucket", "depth", "ends_sha256"])
            out = []
        if now:
            yield rows([(*now, sha.hexdigest())], 2, names=["bucket", "depth", "ends_sha256"])

    order = ["bucket", "depth", "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "bucket long, depth long, first long, text string")
    return pieces.repartition("bucket", "depth").sortWithinPartitions("bucket", "depth", "first").select("bucket", "depth", "text").mapInArrow(digest, "bucket long, depth long, ends_sha256 string")


def prefix_trie(rows: DataFrame, totals: DataFrame, local_rows: int = 8_192) -> DataFrame:
    """rows: conv_id, pos (gapless from 0), id, bytes; totals: conv_id, total (rows of each conversation, 0 too), both
    written tables. Returns NODE: a row for each distinct prefix, the empty one (the root, parent null) included.

    A round takes all buckets that are open: conversations that agree before place `from`. How far each bucket goes on
    without parting is found at once, by counting its turns by place, so a shared run of any length is one round. Where
    it parts, the next turn's id is the radix digit: those of one id are a new bucket. A bucket of one conversation is
    a chain of its rows; one of at most local_rows rows is finished in a task; all others are open in the next round.
    Leaves and savings of the nodes that rounds emit are summed from the last round to the first.
    No conversations: no rows."""
    first = totals.agg(F.min("conv_id"), F.count("*")).first()
    if not first[1]:
        return rows.sparkSession.createDataFrame([], NODE)
    spent: list[DataFrame] = []

    def written(df: DataFrame, name: str) -> DataFrame:
        spent.append(materialize(df, f"trie-{name}"))
        return spent[-1]

    none = F.lit(None).cast("long")
    members = totals.select("conv_id", "total", F.lit(first[0]).alias("bucket"), F.lit(0).cast("long").alias("from"), F.lit(first[0]).alias("parent"), none.alias("up"), none.alias("up_from"), F.lit("open").alias("kind"))
    key = ["bucket", "from"]
    runs, rounds, closed, ended = [], [], [], []
    while True:
        live = members.where("kind = 'open'")
        mine = rows.join(live, "conv_id").where(F.col("pos") >= F.col("from"))
        places = written(mine.groupBy(*key, "pos").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"), F.max("bytes").alias("bytes")), "places")
        sizes = live.groupBy(*key).agg(F.count("*").alias("n_convs"), F.min("total").alias("shortest"), F.first("parent").alias("parent"), F.first("up").alias("up"), F.first("up_from").alias("up_from"))
        parts = places.join(sizes.select(*key, "n_convs"), key).where("n < n_convs or a != b").groupBy(*key).agg(F.min("pos").alias("place"))
        at = written(sizes.join(parts, key, "left").withColumn("till", F.coalesce("place", "shortest")).drop("place", "shortest"), "buckets")
        digit = mine.join(at.select(*key, "till"), key).where("pos = till").select(*key, "till", "conv_id", "id", "total")
        children = digit.groupBy(*key, "id").agg(F.min("conv_id").alias("least"), F.count("*").alias("n"), F.sum(F.col("total") - F.col("till")).alias("rows"))
        children = written(children, "children")
        kind = F.when(F.col("n") == 1, "single").when(F.col("rows") <= local_rows, "local").otherwise("open")
        new = digit.join(children.select(*key, "id", "least", kind.alias("kind")), [*key, "id"])
        members = written(new.select("conv_id", "total", F.col("least").alias("bucket"), F.col("till").alias("from"), F.col("bucket").alias("parent"), F.col("bucket").alias("up"), F.col("from").alias("up_from"), "kind"), "members")
        bucket = at.join(children.groupBy(*key).agg(F.count("*").alias("n_children")), key, "left").fillna(0, "n_children")
        runs.append(places.join(at.select(*key, "till"), key).where("pos < till").select(*key, "pos", "bytes"))
        rounds.append(bucket)
        closed.append(members.where("kind != 'open'"))
        ended.append(live.join(at.select(*key, "till"), key).where("total = till").select("bucket", F.col("till").alias("depth"), "conv_id"))
        if not children.where(kind == "open").limit(1).count():
            break
    done = closed[0]
    for more in closed[1:]:
        done = done.unionByName(more)
    tail = rows.join(done, "conv_id").where(F.col("pos") >= F.col("from"))
    local = written(finish(tail.where("kind = 'local'")), "local")
    depth = (F.col("pos") + 1).alias("depth")
    last = F.col("pos") + 1 == F.col("total")
    top = F.col("pos") == F.col("from")
    one = tail.where("kind = 'single'").select("conv_id", depth, F.when(top, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOTHING).alias("ends_sha256"))
    below = local.where("up is not null").select("up", "up_from", "n_leaves", "saved_tokens")
    below = below.unionByName(done.where("kind = 'single'").select("up", "up_from", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")))
    below = written(below.groupBy("up", "up_from").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), "below")
    upper, from_open = [], None
    for bucket, run in zip(reversed(rounds), reversed(runs)):
        own = run.groupBy(*key).agg(F.sum("bytes").alias("text"))
        under = below if from_open is None else below.unionByName(from_open)
        under = under.groupBy(F.col("up").alias("bucket"), F.col("up_from").alias("from")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("under"))
        full = bucket.join(under, key, "left").join(own, key, "left").fillna(0, ["under", "text"]).withColumn("leaves", F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)))
        full = written(full, "sums")
        upper.append((full, run))
        from_open = full.where("up is not null").select("up", "up_from", F.col("leaves").alias("n_leaves"), (F.col("under") + (F.col("n_convs") - 1) * F.col("text")).alias("saved_tokens"))
    over = ended[0]
    for more in ended[1:]:
        over = over.unionByName(more)
    hashes = written(joined_hashes(over), "ends")
    out = local.drop("up", "up_from").unionByName(one)
    for full, run in upper:
        root = full.where("up is null").select(*key, F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("bytes"))
        rest = Window.partitionBy(*key).orderBy(F.desc("pos"))
        chain = run.unionByName(root).withColumn("text_on", F.sum("bytes").over(rest)).join(full, key).withColumn("depth", F.col("pos") + 1)
        chain = chain.join(hashes, ["bucket", "depth"], "left")
        end = F.col("depth") == F.col("till")
        parent = F.when(F.col("pos") < 0, None).when(F.col("pos") == F.col("from"), F.col("parent")).otherwise(F.col("bucket"))
        out = out.unionByName(chain.select(F.col("bucket").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", F.when(end, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").cast("long").alias("n_leaves"), (F.col("under") + (F.col("n_convs") - 1) * F.col("text_on")).alias("saved_tokens"), F.when(end, F.coalesce("ends_sha256", F.lit(NOTHING))).otherwise(NOTHING).alias("ends_sha256")))
    result = materialize(out, "trie-nodes")
    drop(*spent, rows)
    return result


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """All conversations, each headed by the first turns of conversation c - c % 5. Rows of equal conv_id and turn are
    ordered by role, then text; rows without a conv_id belong to no conversation; other columns are ignored."""
    turns = materialize(encoded(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-encoded")
    head = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % 9
    return prefix_trie(*rebuilt(turns, F.col("conv_id") - F.col("conv_id") % 5, head))


_CRC = "list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(length(CAST(conv_id AS VARCHAR))), lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i + 1]) AS UBIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda j: CAST(0 AS UBIGINT))), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS UBIGINT)) ELSE x >> 1 END))"
OP12_SQL = rf"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
    struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS x
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(x ORDER BY pos) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, CAST(xor({_CRC}, CAST(4294967295 AS UBIGINT)) % 9 AS BIGINT) AS h FROM o),
s AS (
  SELECT h.conv_id, list_concat(list_slice(coalesce(b.own, []), 1, h.h), list_slice(h.own, h.h + 1, len(h.own))) AS seq
  FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM s),
m AS (SELECT conv_id, depth, len(seq) AS total, list_slice(seq, 1, depth) AS prefix FROM p),
r AS (SELECT conv_id, depth, total, min(conv_id) OVER (PARTITION BY depth, prefix) AS node, CASE WHEN depth = 0 THEN 0 ELSE strlen(prefix[depth].text) END AS bytes FROM m),
n AS (
  SELECT node, depth, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = total), '')) AS ends_sha256
  FROM r GROUP BY node, depth),
up AS (SELECT n.node, n.depth, r.node AS parent FROM n JOIN r ON r.conv_id = n.node AND r.depth = n.depth - 1),
c AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (node, depth)),
a AS (
  SELECT r.node, r.depth, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved
  FROM f JOIN r ON r.conv_id = f.node AND r.depth <= f.depth GROUP BY r.node, r.depth)
SELECT f.node AS conv_id, f.depth, up.parent AS parent_conv_id, f.n_convs, f.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves,
  CAST(a.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN a USING (node, depth) LEFT JOIN up USING (node, depth)
"""
