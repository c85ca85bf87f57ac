"""The entity store: versioned tables in a folder, read with filters and written by upserts and deletes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import elide, whole_id
from ..sources.versions import Versions
from ..tables import running
from . import entities as e


@dataclass(frozen=True)
class Store:
    """The tables of schema.STORE under a folder. Every write is a new version of its table (sources/versions): readers
    see the table before or after it. Logs are added to; of the other tables, a write replaces the works that it touches."""

    spark: SparkSession
    path: str

    def versions(self, name: str) -> Versions:
        ddl, _ = schema.STORE[name]
        return Versions(self.spark, f"{self.path}/{name}", ddl, ("work_id",))

    def table(self, name: str) -> DataFrame:
        """A table as of now; empty before its first write."""
        return self.versions(name).read()

    def rows(self, name: str, work: str, where: Column | None = None, order: list[Column] = ()) -> DataFrame:
        """Rows of a work, filtered and sorted."""
        out = self.table(name).where(F.col("work_id") == work)
        out = out.where(where) if where is not None else out
        return out.orderBy(*order) if order else out

    def log(self, name: str, rows: DataFrame, mark: tuple[str, int] | None = None) -> bool:
        return self.versions(name).add(rows, mark)

    def upsert(self, name: str, rows: DataFrame, seq: list[str] = (), mark: tuple[str, int] | None = None) -> bool:
        """Rows put in by key, given values over known ones; rows that repeat a key become one first (e.one_row). Only
        the works among the rows are rewritten, from the version before, which stays until vacuum. A mark that is there
        already leaves the table as it is (False)."""
        ddl, keys = schema.STORE[name]
        at = self.versions(name)
        new = e.one_row(rows, list(keys), list(seq))
        works = new.select("work_id").distinct()
        old = at.read().alias("o").join(works.alias("w"), F.col("o.work_id").eqNullSafe(F.col("w.work_id")), "left_semi")
        return at.replace(e.merge_snapshot(old, new, list(keys)), mark=mark)

    def delete(self, name: str, works: str | DataFrame, gone: Column) -> None:
        """Removes the rows of a work, or of works (work_id), for which gone holds; where it holds for all of them, the
        work is left without rows."""
        if isinstance(works, str):
            works = self.spark.range(1).select(F.lit(works).alias("work_id"))
        at, works = self.versions(name), works.select("work_id").distinct()
        mine = at.read().alias("o").join(works.alias("w"), F.col("o.work_id").eqNullSafe(F.col("w.work_id")), "left_semi")
        at.replace(mine.where(~F.coalesce(gone, F.lit(False))), touched=works)

    def vacuum(self) -> int:
        """Deletes old versions of all tables."""
        return sum(self.versions(name).vacuum() for name in schema.STORE)

    def stats(self) -> DataFrame:
        return e.counts({name: self.table(name) for name in schema.STORE})


def fold_characters(log: DataFrame) -> DataFrame:
    """Sightings (work_id, seq, name, role, description, aliases, page, confidence) folded to characters."""
    known = log.withColumns({c: elide(F.col(c)) for c in ("name", "role", "description")}).where("name is not null")
    keyed = known.withColumn("character_id", whole_id("char", F.col("work_id"), F.lower("name")))
    folded = keyed.withColumns({"first_page": F.col("page"), "last_page": F.col("page")})
    base = e.fold(folded, ["work_id", "character_id"], ["seq"], overwrite=["name", "role", "description"], least=["first_page"], most=["last_page", "confidence"], count="appearance_count")
    spelt = keyed.select("work_id", "character_id", F.explode("aliases").alias("alias")).distinct().groupBy("work_id", "character_id").agg(F.slice(F.array_sort(F.collect_list("alias")), 1, 20).alias("aliases"))
    return base.join(spelt, ["work_id", "character_id"], "left")


def aliases_of(characters: DataFrame, log: DataFrame) -> DataFrame:
    """alias -> character of a work: names and given aliases; the last writer of an alias wins."""
    given = log.select("work_id", "seq", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name"))).alias("alias"), whole_id("char", F.col("work_id"), F.lower("name")).alias("character_id"))
    live = given.join(characters.select("work_id", "character_id"), ["work_id", "character_id"], "left_semi")
    return e.last_write(live, ["work_id", "alias"], ["seq"]).select("work_id", "alias", "character_id")


def merge_characters(characters: DataFrame, mapping: DataFrame) -> DataFrame:
    """Folds characters into others: mapping (character_id, into). Pages widen, the target's texts stay, and it
    counts one sighting more for each that is folded in, whatever that one's own count."""
    moved = characters.join(mapping, "character_id", "left").withColumn("own", F.col("into").isNull()).withColumn("character_id", F.coalesce("into", "character_id"))
    texts = [F.max_by(c, "own").alias(c) for c in ("name", "role", "description")]
    return moved.groupBy("work_id", "character_id").agg(*texts, F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"), (F.coalesce(F.sum(F.when(F.col("own"), F.col("appearance_count"))), F.lit(0)) + F.count_if(~F.col("own"))).alias("appearance_count"), F.max("confidence").alias("confidence"))


def fresh(cache: DataFrame, asked: DataFrame, now: Column, seconds: int) -> DataFrame:
    """asked (work_id, query) with the newest cached result that is not older than seconds, else null."""
    live = cache.where(F.unix_timestamp(now) - F.unix_timestamp("fetched_at") <= seconds)
    newest = live.groupBy("work_id", "query").agg(F.max_by("result", "fetched_at").alias("result"))
    return asked.join(newest, ["work_id", "query"], "left")


def correct(records: DataFrame, corrections: DataFrame) -> DataFrame:
    """records (key, value, state, confidence) under the user's corrections (key, value, seq): the latest of a key
    counts, is certain, and is never overwritten."""
    last = e.last_write(corrections, ["key"], ["seq"]).select("key", F.col("value").alias("given"))
    out = records.join(last, "key", "left")
    return out.select("key", F.coalesce("given", "value").alias("value"), F.when(F.col("given").isNotNull(), "user_corrected").otherwise(F.col("state")).alias("state"), F.when(F.col("given").isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"))


def listed(rows: DataFrame, keys: list[str], order: list, where: Column | None = None, name: str = "position") -> DataFrame:
    """Rows for which where holds, with their place (from 1) in the order of their key: a listing of every work at once,
    by counts over ranges of a work, so that one of any size takes many tasks."""
    kept = rows if where is None else rows.where(where)
    return running(kept, keys, [F.col(c) if isinstance(c, str) else c for c in order], {name: F.lit(1)}, "listed").withColumn(name, F.col(name) + 1)


def both_sides(relationships: DataFrame) -> DataFrame:
    """relationships (character_a, character_b, ...) seen from either side: character_id, other and the rest."""
    rest = [c for c in relationships.columns if c not in ("character_a", "character_b")]
    side = lambda a, b: F.struct(F.col(a).alias("character_id"), F.col(b).alias("other"))
    return relationships.select(F.inline(F.array(side("character_a", "character_b"), side("character_b", "character_a"))), *rest)


def looked_up_rows(asked: DataFrame, known: DataFrame, keys: list[str], defaults: dict[str, str]) -> DataFrame:
    """asked keys with what is known of them; columns named in defaults are filled where nothing is."""
    return asked.join(known, keys, "left").fillna(defaults)


def checkpoints(log: DataFrame, keys: list[str], seq: str, at: str) -> DataFrame:
    """A log of statuses as one row a key: the last status, when it last began to run, when it last ended, and how many
    entries there are."""
    ended = F.col("status").isin("completed", "failed")
    return log.groupBy(*keys).agg(F.max_by("status", seq).alias("status"), F.max(F.when(F.col("status") == "running", F.col(at))).alias("started_at"), F.max(F.when(ended, F.col(at))).alias("completed_at"), F.count("*").alias("n"))


def appended(logs: list[DataFrame]) -> DataFrame:
    """Logs one behind the other; entries that were logged twice stay twice."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def without(rows: DataFrame, wiped: Column, gone: DataFrame, keys: list[str]) -> DataFrame:
    """rows without those of wiped works and those whose key is among the tombstones."""
    return rows.where(~F.coalesce(wiped, F.lit(False))).join(gone.select(*keys).distinct(), keys, "left_anti")


def evidence_rows(pages: DataFrame, page: str, blocks: str) -> DataFrame:
    """A row for each block of a page's text that is not blank: its place and value."""
    return pages.select(page, F.posexplode(blocks).alias("block", "value")).where(F.trim(F.col("value"), F.lit(" \t\r")) != "")


def scope_by(cast: DataFrame, volume: Column, first: int = 9, each: int = 4) -> DataFrame:
    """As scope_cast, for a volume a row."""
    return cast.where((volume < 1) | (F.col("position") <= first + each * (volume - 1)))


def scope_cast(cast: DataFrame, volume: int, first: int = 9, each: int = 4) -> DataFrame:
    """The cast (position from 1) known by a volume: nine at first, four more each; all for no volume."""
    return scope_by(cast, F.lit(volume), first, each)
