"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def rotate(unit: np.ndarray, table: int, seed: int = 5) -> np.ndarray:
    """The pseudo-rotation of a table: three times signs drawn for the table, then Hadamard; rows padded with zeros."""
    width = 1 << max(1, (unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), width), dtype=np.float64)
    x[:, : unit.shape[1]] = unit
    rng = np.random.default_rng([seed, table])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], width))
    return x


def buckets(unit: np.ndarray, table: int, probes: int = 1) -> np.ndarray:
    """For each row the numbers of its nearest signed axes, nearest first: 2 * axis, plus 1 for the negative one."""
    x = rotate(unit, table)
    both = np.stack([x, -x], axis=2).reshape(len(x), -1)
    probes = min(probes, both.shape[1])
    return np.argsort(-both, axis=1, kind="stable")[:, :probes].astype(np.int32)


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id and embedding of the rows that take part: an id, and dim finite components that are not all zero."""
    e = F.col("embedding")
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & (F.size(e) == dim) & ~odd & F.exists(e, lambda x: x != 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows as doubles, each times the power of two that brings its largest component to between 0.5 and 1: no square
    overflows, and cosines stay what they are."""
    x = np.asarray(x, dtype=np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0, keepdims=True))[1])


def _matrix(batch_or_table, column: str, kind: str) -> np.ndarray:
    """A column of vectors, kept as the bytes of their components, as scaled doubles."""
    rows = batch_or_table.column(column).to_pylist()
    return scaled(np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1))


def _kind(vectors: DataFrame) -> str:
    """numpy's name of the type that vectors are kept in: that of the table's own components."""
    return "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"


def indexed(rows: DataFrame, tables: int, probes: int) -> DataFrame:
    """vec_id, vector (the components' bytes) and places: the numbers of the nearest `probes` axes in each table, the
    first table's before the second's."""
    kind, dtype = rows.schema["vec_id"].dataType.simpleString(), _kind(rows)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(batch.num_rows, -1)
            unit = scaled(x)
            unit = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
            places = np.concatenate([buckets(unit, t, probes) for t in range(tables)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(list(places), pa.list_(pa.int32()))], names=["vec_id", "vector", "places"])

    return rows.mapInArrow(run, f"vec_id {kind}, vector binary, places array<int>")


def _of_tables(index: DataFrame, tables: range, probes: int) -> DataFrame:
    """vec_id, vector, place: a row for each place that a row of the index has in those tables."""
    own = F.slice("places", tables.start * probes + 1, len(tables) * probes)
    rows = index.select("vec_id", "vector", F.posexplode(own).alias("at", "axis"))
    return rows.select("vec_id", "vector", (F.floor(F.col("at") / probes) * F.lit(2**32) + F.col("axis")).alias("place"))


def _distinct(ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Those places of order at which an id comes first."""
    return order[np.sort(np.unique(ids[order], return_index=True)[1])]


def _search(points: DataFrame, queries: DataFrame, dtype: str, k: int, block: int) -> DataFrame:
    """points and queries: vec_id, vector, place. query_id, vec_id, score: each block's k best ids for each of its queries.

    A bucket of any size is cut into blocks of about `block` points and blocks of about `block` queries, by a hash;
    each pair of blocks is one matrix product in one task, and only k rows a query leave it."""
    kind = points.schema["vec_id"].dataType.simpleString()
    cuts = lambda df, name: df.groupBy("place").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    grid = cuts(points, "np").join(cuts(queries, "nq"), "place")
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = points.join(grid, "place").select("place", own("np").alias("pb"), each("nq").alias("qb"), "vec_id", "vector")
    right = queries.join(grid, "place").select("place", each("np").alias("pb"), own("nq").alias("qb"), "vec_id", "vector")

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, qids = a.column("vec_id").to_numpy(), b.column("vec_id").to_numpy()
        out = ([], [], [])
        if len(ids) and len(qids):
            x, q = _matrix(a, "vector", dtype), _matrix(b, "vector", dtype)
            order = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.append(True, ids[order][1:] != ids[order][:-1]))
            nx, nq = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
            for at in range(0, len(q), 256):
                near = q[at : at + 256] @ x.T / nx / nq[at : at + 256, None]
                near[qids[at : at + 256, None] == ids] = -np.inf
                # Rows of one vec_id count once: the k-th best is that of ids.
                each = near if len(first) == len(ids) else np.maximum.reduceat(near[:, order], first, axis=1)
                top = np.partition(each, max(0, each.shape[1] - k), axis=1)[:, -k:].min(1) if each.shape[1] > k else np.full(len(each), -2.0)
                for i, low in enumerate(top):
                    # Products of whole blocks round differently from place to place: ties are settled by row.
                    c = np.flatnonzero((near[i] >= low - 1e-9) & (near[i] > -np.inf))
                    exact = (x[c] * q[at + i]).sum(1) / (nx[c] * nq[at + i])
                    keep = _distinct(ids[c], np.lexsort((ids[c], -exact)))[:k]
                    out[0].extend([qids[at + i]] * len(keep))
                    out[1].extend(ids[c][keep])
                    out[2].extend(exact[keep])
        kinds = a.schema.field("vec_id").type
        return pa.table({"query_id": pa.array(out[0], kinds), "vec_id": pa.array(out[1], kinds), "score": pa.array(out[2], pa.float64())})

    keys = ["place", "pb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"query_id {kind}, vec_id {kind}, score double")


def exact_nearest(points: DataFrame, asked: list[tuple], k: int) -> list[tuple]:
    """Brute force for a bounded list of (id, vector): (query position, vec_id, vector) of the k nearest of each. Every
    task keeps k rows a query of what it reads, and the k best of those are kept by a window over the queries."""
    q = scaled([v for _, v in asked])
    unit, own = q / np.sqrt((q * q).sum(1, keepdims=True)), [i for i, _ in asked]
    kind = points.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.array(batch.column(0).to_pylist())
            x = scaled(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            near = unit @ x.T / np.sqrt((x * x).sum(1))
            near[np.array(own)[:, None] == ids] = -np.inf
            for i, row in enumerate(near):
                top = np.lexsort((ids, -row))
                top = _distinct(ids, top[row[top] > -np.inf])[:k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), i), pa.int32()), pa.array(ids[top], batch.schema.field(0).type), pa.array(row[top], pa.float64()), pa.array([x[t].tobytes() for t in top], pa.binary())], names=["at", "vec_id", "score", "vector"])

    found = points.mapInArrow(run, f"at int, vec_id {kind}, score double, vector binary").groupBy("at", "vec_id").agg(F.max(F.struct("score", "vector")).alias("b")).select("at", "vec_id", "b.score", "b.vector")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k)
    return [(r["at"], r["vec_id"], np.frombuffer(r["vector"], "<f8")) for r in best.collect()]


def probes_for(points: DataFrame, asked: DataFrame, k: int, tables: int, recall: float, sample: int) -> int:
    """The fewest probes a table that find at least that share of the true k nearest of a bounded sample of queries,
    drawn by a hash and compared with brute force over all rows."""
    drawn = [(r["vec_id"], r["embedding"]) for r in asked.orderBy(F.xxhash64("vec_id")).limit(sample).collect()]
    if not drawn:
        return 1
    true = exact_nearest(points, drawn, k)
    if not true:
        return 1
    q, x = scaled([drawn[at][1] for at, _, _ in true]), np.array([v for _, _, v in true])
    rank = None
    for t in range(tables):
        both = buckets(q, t, 4 * q.shape[1]) == buckets(x, t)
        at = both.argmax(1)
        rank = at if rank is None else np.minimum(rank, at)
    return int(np.sort(rank)[max(0, int(np.ceil(recall * len(rank))) - 1)]) + 1


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = 8, probes: int | None = None, block: int = 4096, recall: float = 0.96, sample: int = 128, at_once: int = 2) -> DataFrame:
    """vectors, queries: vec_id, embedding (array of float or double); other columns are ignored.
    Returns query_id, rank, vec_id, score: the k rows of largest cosine found, ties to the smaller vec_id.

    Every row is hashed to the nearest signed axis of its pseudo-rotation in each table; a query looks into its
    `probes` nearest axes of each table (None: as many as reach `recall` on `sample` queries, by brute force), and all
    that it meets there is reranked by exact cosine. The index holds each vector once beside its places; `at_once` tables
    are searched at a time, so that a vector is on its way only so often at once. A query that meets
    fewer than k rows looks into every bucket of one table, which holds all rows. Rows without an id, of a null, zero
    or non-finite vector, or of another length than most rows have, take no part; rows of one vec_id count once, and
    never for a query of that vec_id; empty tables give empty results."""
    sizes = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = sizes["d"] if sizes else 0
    points, asked = usable(vectors, dim), usable(queries, dim)
    if probes is None:
        probes = probes_for(points, asked, k, tables, recall, sample)
    axes = 2 * (1 << max(1, (max(dim, 1) - 1).bit_length()))
    probes, dtype = min(probes, axes), _kind(vectors)
    index = materialize(indexed(points, tables, 1), "ann-index")
    looked = materialize(indexed(asked, tables, probes), "ann-queries")
    runs = [range(t, min(t + at_once, tables)) for t in range(0, tables, at_once)]
    founds = [materialize(_search(_of_tables(index, r, 1), _of_tables(looked, r, probes), dtype, k, block), "ann-found") for r in runs]
    found = reduce(DataFrame.unionByName, founds)
    met = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n"))
    short = materialize(asked.join(met.where(F.col("n") >= k), asked["vec_id"] == F.col("query_id"), "left_anti"), "ann-short")
    again = _search(_of_tables(index, range(1), 1), _of_tables(indexed(short, 1, axes), range(1), axes), dtype, k, block)
    all_found = found.unionByName(again).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return all_found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_vectors(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest of every embedding whose vec_id is divisible by 50, among all embeddings."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
