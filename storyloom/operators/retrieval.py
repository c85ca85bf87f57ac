"""Ranked retrieval of memory records, and text over records."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring as s
from ..functions.text import memory_tokens
from ..tables import once
from .matching import top_k

# Words that each task looks for.
TASKS = {
    "narration": ("character", "place", "object", "event", "name", "location"),
    "understanding": ("character", "description", "role", "object", "place"),
    "script": ("thread", "event", "character", "location", "relation"),
    "crop": ("character", "object", "place", "focus"),
    "summary": ("thread", "event", "character", "location"),
}


def relevance(vocabulary: Column, text: Column) -> Column:
    """Share of a vocabulary (array) that a text's tokens hold."""
    return F.size(F.array_intersect(vocabulary, memory_tokens(text))) / F.greatest(F.size(vocabulary), F.lit(1))


def retrieve(records: DataFrame, task: str = "narration", page: int | None = None, extra: str = "", k: int = 8, least: float = 0.0, per: list[str] = ()) -> DataFrame:
    """The k best of records (key, value, page, confidence, state), of each of `per`: half by relevance to the task's
    words and extra, 0.35 by confidence in its state, 0.15 by closeness to the page."""
    words = F.array_union(F.array(*(F.lit(w) for w in TASKS.get(task, ("character", "event")))), memory_tokens(F.lit(extra)))
    sure = s.effective_confidence(F.col("confidence"), F.col("state"))
    near = s.page_boost(F.col("page"), F.lit(page).cast("int"))
    scored = records.withColumn("score", 0.5 * relevance(words, F.concat_ws(" ", "key", "value")) + 0.35 * sure + 0.15 * near).where(sure >= least)
    if not per:  # a top-k over all records needs no single sorted task: Spark keeps k rows a task
        return scored.orderBy(F.desc("score"), "key").limit(k)
    return top_k(scored, list(per), [F.desc("score"), F.asc("key")], k)


#: Up to so many tokens of queries go to every task, which counts a record's hits where it lies; beyond, records and queries meet in a join.
FEW_TOKENS = 100_000
#: Records times queries that a task counts at once.
CELLS = 2_000_000


def _hits_where_they_lie(records: DataFrame, asked: pa.Table, record: str, query: str, k: int, schema: T.StructType) -> DataFrame:
    """query, record and hits, as schema says: of each task's records (record, token: an array; each id once) the k that share most tokens with each query. asked
    holds the queries' tokens, a row each. A block of records at a time, and never more than k kept of a query, so a task
    holds no more of many records than of few."""
    queries, words = (asked[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in (query, "token"))
    ids, vocabulary = queries.dictionary, words.dictionary
    n, by_word = len(ids), np.argsort(words.indices.to_numpy(), kind="stable")
    # The queries of word i are those in asks from starts[i] to starts[i + 1].
    asks, starts = queries.indices.to_numpy().astype(np.int64)[by_word], np.searchsorted(words.indices.to_numpy()[by_word], np.arange(len(vocabulary) + 1))

    def best(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("query", "ascending"), ("hits", "descending"), ("record", "ascending")], null_placement="at_start"))
        at = rows["query"].to_numpy()
        return rows.filter(pa.array(np.arange(len(at)) - np.searchsorted(at, at) < k))

    def counted(block: pa.RecordBatch) -> pa.Table:
        word = pc.index_in(block.column(1).flatten(), value_set=vocabulary)
        row = pc.list_parent_indices(block.column(1)).to_numpy().astype(np.int64)[word.is_valid().to_numpy(zero_copy_only=False)]
        word = word.drop_null().to_numpy()
        many = starts[word + 1] - starts[word]
        ask = asks[np.arange(many.sum()) + np.repeat(starts[word] - (np.cumsum(many) - many), many)]
        hits = np.bincount(np.repeat(row, many) * n + ask, minlength=block.num_rows * n).reshape(-1, n)
        least = np.partition(hits, len(hits) - k, axis=0)[len(hits) - k] if len(hits) > k else 0
        row, ask = np.nonzero(hits >= np.maximum(least, 1))
        return pa.table({"query": ask, "hits": hits[row, ask], "record": block.column(0).take(pa.array(row))})

    def run(batches):
        kept = None
        for batch in batches:
            size = max(1, CELLS // n)
            for at in range(0, batch.num_rows, size):
                new = counted(batch.slice(at, size))
                kept = best(new if kept is None else pa.concat_tables([kept, new]))
        if kept is not None:
            yield from pa.table({query: ids.take(kept["query"].combine_chunks()), record: kept["record"], "hits": kept["hits"]}).combine_chunks().to_batches()

    return records.mapInArrow(run, schema)


def keyword_hits(records: DataFrame, queries: DataFrame, record: str, query: str, text: str, k: int) -> DataFrame:
    """For each query the k records that share most tokens with it. queries is the small, stated side.

    The tokens of few queries go to every task, and of its records only a query's k best leave it. Rows whose record id
    repeats, and all rows where the queries are many, meet the queries on their tokens and are counted by both ids."""
    tokens = lambda df, key: df.select(key, memory_tokens(F.col(text)).alias("token"))
    words = lambda df, key: tokens(df, key).withColumn("token", F.explode("token"))
    join = lambda df: words(df, record).join(words(queries, query), "token").groupBy(query, record).agg(F.count("*").alias("hits"))
    asked = words(queries, query).limit(FEW_TOKENS + 1).toArrow()
    if not 0 < asked.num_rows <= FEW_TOKENS:
        met = join(records)
    else:
        single, again = once(records, record)
        met = _hits_where_they_lie(tokens(single, record), asked, record, query, k, join(records).schema)
        met = met if again is None else met.unionByName(join(again))
    return top_k(met, [query], [F.desc("hits"), F.asc(record)], k)


def render(kind: Column, page: Column, key: Column, value: Column, confidence: Column) -> Column:
    """One line for a prompt: [KIND p7] key: value cf:0.85."""
    place = F.when(page.isNull(), F.lit("")).otherwise(F.concat(F.lit(" p"), page.cast("string")))
    return F.concat(F.lit("["), F.upper(kind), place, F.lit("] "), key, F.lit(": "), value, F.lit(" cf:"), F.format_string("%.2f", confidence))


def prompt_block(rows: DataFrame, keys: list[str], order: list[str], line: str, heading: str) -> DataFrame:
    """A heading and the lines of each key in order, as one text: the rows are a bounded top-k."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("__line"))))
    return rows.groupBy(*keys).agg(F.concat_ws("\n", F.lit(heading), F.transform(ordered, lambda r: r["__line"])).alias("block"))


def prompt(task: str, parts: dict[str, Column]) -> Column:
    """A task and what is known, one part a line; parts that are null are left out."""
    return F.concat_ws("\n", F.lit(task), *(F.concat(F.lit(f"{name}: "), c) for name, c in parts.items()))


@dataclass(frozen=True)
class Layer:
    """One layer of a context: which rows, in which order, how many of them, and how much of each text."""

    where: Column
    order: list[Column]
    k: int
    length: int


def layered(rows: DataFrame, keys: list[str], text: str, layers: list[Layer], length: int) -> DataFrame:
    """The bounded context of each key: the layers' best rows, cut to their lengths, one a line and in the order of the
    layers, in all at most length characters; and n_lines. A key gathers at most the sum of k rows."""
    picked = [top_k(rows.where(x.where), keys, x.order, x.k).select(*keys, F.lit(i).alias("__layer"), F.col("rank").alias("__rank"), F.substring(text, 1, x.length).alias("__line")) for i, x in enumerate(layers)]
    ordered = F.array_sort(F.collect_list(F.struct("__layer", "__rank", "__line")))
    lines = reduce(DataFrame.unionByName, picked).groupBy(*keys).agg(F.transform(ordered, lambda x: x["__line"]).alias("lines"))
    return lines.select(*keys, F.substring(F.array_join("lines", "\n"), 1, length).alias("context"), F.size("lines").cast("long").alias("n_lines"))
