"""Joins: two-sided mapping, resolution of names, ranges, overlaps, as-of, best candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fuzzy_similar


def mapping(items: DataFrame, links: DataFrame, item: str, group: str) -> DataFrame:
    """items (with column item) and links (item, group): a row an item: item, n_groups and cardinality (one_to_one;
    one_to_many if it lies in several groups; many_to_one if one of its groups holds several items; unmatched)."""
    pairs = links.select(item, group).distinct()
    known = pairs.join(items.select(item).distinct(), item, "left_semi")
    sizes = known.groupBy(group).agg(F.count("*").alias("__size"))
    per = known.join(sizes, group).groupBy(item).agg(F.count("*").alias("n_groups"), F.max("__size").alias("__most"))
    kind = F.when(F.col("n_groups").isNull(), "unmatched").when(F.col("n_groups") > 1, "one_to_many").when(F.col("__most") > 1, "many_to_one").otherwise("one_to_one")
    return items.select(item).distinct().join(per, item, "left").select(item, F.coalesce("n_groups", F.lit(0)).alias("n_groups"), kind.alias("cardinality"))


def unknown_links(items: DataFrame, links: DataFrame, item: str) -> DataFrame:
    """Links to items that do not exist."""
    return links.join(items.select(item).distinct(), item, "left_anti")


def lookup_in_ranges(points: DataFrame, at: str, ranges: DataFrame, lo: str, hi: str, cell: int, carry: list[str]) -> DataFrame:
    """points left joined with the range of least start that holds them. Both sides meet on cells of fixed width, so
    the join is a hash join whatever the number of ranges; a range has a row for each cell that it touches."""
    spread = ranges.select(lo, hi, *carry, F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))).alias("__cell"))
    keyed = points.withColumn("__row", F.monotonically_increasing_id()).withColumn("__cell", F.floor(F.col(at) / cell))
    met = keyed.alias("p").join(spread.alias("r"), (F.col("p.__cell") == F.col("r.__cell")) & F.col(f"p.{at}").between(F.col(f"r.{lo}"), F.col(f"r.{hi}")), "left")
    best = Window.partitionBy("__row").orderBy(F.col(lo).asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in carry))
    flat = met.select(*(F.col(f"p.{c}") for c in points.columns), "p.__row", *(F.col(f"r.{c}") for c in (lo, hi, *carry)))
    return flat.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n", "__row")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], start: str, end: str, cell: int) -> DataFrame:
    """Pairs of rows of a and b of one key whose [start, end) intervals meet, as structs l and r. Both are spread over
    cells; a pair is kept in the first cell that both touch, so it comes once."""
    spread = lambda df, n: df.select(F.struct("*").alias(n), *(F.col(k).alias(f"__{k}") for k in keys), F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / cell))).alias("__cell"))
    x = spread(a, "l")
    y = spread(b, "r")
    met = x.join(y, [*(f"__{k}" for k in keys), "__cell"])
    first = F.greatest(F.floor(F.col(f"l.{start}") / cell), F.floor(F.col(f"r.{start}") / cell)) == F.col("__cell")
    return met.where((F.col(f"l.{start}") < F.col(f"r.{end}")) & (F.col(f"r.{start}") < F.col(f"l.{end}")) & first).select("l", "r")


def as_of(facts: DataFrame, states: DataFrame, keys: list[str], at: str, tie: str, carry: str, name: str) -> DataFrame:
    """facts with the last state of their key at or before them: one sort of the union of both, no join."""
    left = facts.select("*", F.lit(None).cast(states.schema[carry].dataType).alias(name), F.lit(1).alias("__side"))
    marked = states.select(*keys, at, F.col(tie).alias(tie), F.col(carry).alias(name), F.lit(0).alias("__side"))
    both = left.unionByName(marked, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col(at), F.col("__side"), F.col(tie)).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last(name, ignorenulls=True).over(w)).where("__side = 1").drop("__side")


def resolve_names(names: DataFrame, name: str, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """names with entity_id: the entity of the alias of that spelling, else the entity of that name, else null.
    aliases: alias, entity_id; entities: entity_id, entity_name."""
    by_alias = aliases.groupBy(F.col("alias").alias(name)).agg(F.min("entity_id").alias("__a"))
    by_name = entities.groupBy(F.col("entity_name").alias(name)).agg(F.min("entity_id").alias("__n"))
    return names.join(by_alias, name, "left").join(by_name, name, "left").withColumn("entity_id", F.coalesce("__a", "__n")).drop("__a", "__n")


def resolve_fuzzy(names: DataFrame, name: str, entities: DataFrame, blocks, entity_blocks=None) -> DataFrame:
    """names (distinct) with the first similar entity by rank. entities: entity_id, entity_name, rank. Exact matches
    are hash-joined; the rest meet entities of one of their blocks (blocks: name column -> array of block keys, which
    similar names must share; entity_blocks: the same for entity names, where it differs), and the similarity test decides."""
    exact = names.join(entities.select(F.col("entity_name").alias(name), "entity_id", "rank"), name)
    rest = names.join(entities.select(F.col("entity_name").alias(name)), name, "left_anti")
    left = rest.select(name, F.explode(blocks(F.col(name))).alias("__block"))
    right = entities.select("entity_id", "entity_name", "rank", F.explode((entity_blocks or blocks)(F.col("entity_name"))).alias("__block"))
    near = left.join(right, "__block").where(fuzzy_similar(F.col(name), F.col("entity_name"))).select(name, "entity_id", "rank")
    best = exact.select(name, "entity_id", "rank").unionByName(near).groupBy(name).agg(F.min(F.struct("rank", "entity_id")).alias("__b"))
    return names.join(best, name, "left").select(name, F.col("__b.entity_id").alias("entity_id"))


def best_two(scored: DataFrame, keys: list[str], score: str, item: str, close: float, least: float, digits: int | None = None) -> DataFrame:
    """The best item of each key, the runner-up where it is as close as `close`, and needs_review: a tie or a best score
    under least. Scores that are rounded have differences of as many digits, if these are given: 100.1 and 60.1 are 40 apart."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(item))
    ranked = scored.select(*keys, item, score, F.lead(item).over(w).alias("second"), F.lead(score).over(w).alias("second_score"), F.row_number().over(w).alias("__r")).where("__r = 1")
    apart = F.col(score) - F.col("second_score")
    tie = F.coalesce((apart if digits is None else F.round(apart, digits)) < close, F.lit(False))
    return ranked.select(*keys, F.col(item).alias("best"), F.col(score).alias("best_score"), F.when(tie, F.col("second")).alias("second"), (tie | (F.col(score) < least)).alias("needs_review"))


def top_k(scored: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key by order."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)
