"""Operators over ordered records: boundaries, groups by gap, numbering, extents, links and running timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import jaccard
from ..tables import placed, row_before, running, sums_before

#: Weights of the boundary score; the keys name the signals.
WEIGHTS = {"location": 0.45, "character": 0.55, "event": 0.50, "transition": 0.50}
CONTINUITY = {"character": 0.35, "location": 0.35, "action": 0.25, "dialogue": 0.30, "event": 0.30}


def previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Adds prev_<c> for each column: its value in the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select("*", *(F.lag(c).over(w).alias(f"prev_{c}") for c in columns))


def boundary_score(keywords: tuple[str, ...] = (), weights: dict = WEIGHTS, keep: dict = CONTINUITY) -> Column:
    """How much a record breaks with the one before, 0 to 1, from location, characters, event, actions, dialogue (text)
    and their prev_ twins; nulls say nothing. Change adds, continuity subtracts; a transition keyword in either text
    counts only where an event ends without another one starting."""
    c, p = F.col, lambda k: F.col("prev_" + k)
    both = lambda k: c(k).isNotNull() & p(k).isNotNull()
    place = F.when(both("location"), F.when(c("location") != p("location"), weights["location"]).otherwise(-keep["location"])).otherwise(0.0)
    same = jaccard(c("characters"), p("characters"))
    people = F.coalesce(-keep["character"] * same + F.when(same == 0, weights["character"]).otherwise(0.0), F.lit(0.0))
    words = F.lower(F.concat_ws(" ", p("event"), p("dialogue"), c("dialogue")))
    turn = F.lit(False)
    for k in keywords:
        turn = turn | words.contains(k.lower())
    event = F.when(both("event"), F.when(c("event") != p("event"), weights["event"]).otherwise(-keep["event"])).when(p("event").isNotNull() & turn, weights["transition"]).otherwise(0.0)
    acts = F.coalesce(-keep["action"] * jaccard(c("actions"), p("actions")), F.lit(0.0))
    talk = F.when(both("dialogue"), -keep["dialogue"]).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), place + people + event + acts + talk))


def numbered(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """Adds a running number, from 0, of the group that each row belongs to; starts, a column over the row alone, says
    where one begins (the first row begins the first in any case). Sums over ranges of a key: none is held whole."""
    at = placed(df, keys, [F.col(c) for c in order], "numbered")
    return _numbered(at, keys, starts, name).select(*df.columns, name)


def _numbered(table: DataFrame, keys: list[str], starts: Column, name: str) -> DataFrame:
    flag = F.coalesce(starts, F.lit(False)).cast("long")
    counted = sums_before(table.withColumn("__flag", flag), keys, {"__before": F.col("__flag")})
    first = counted.groupBy(*keys).agg(F.min_by("__flag", "__i").alias("__first")).alias("f")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    number = F.col("c.__before") + F.col("c.__flag") - F.col("f.__first")
    return counted.alias("c").join(first, same).select(*(F.col(f"c.{c}") for c in table.columns), number.alias(name))


def gap_groups(df: DataFrame, keys: list[str], order: list[str], at: str, gap: float, name: str = "group_no") -> DataFrame:
    """Groups rows whose distance from the row before is at most gap, so groups chain, over ranges of a key."""
    table = row_before(placed(df, keys, [F.col(c) for c in order], "gaps"), keys, at, "__was")
    return _numbered(table, keys, F.col(at) - F.col("__was") > gap, name).select(*df.columns, name)


def fill_numbers(df: DataFrame, keys: list[str], order: list[str], number: str, name: str) -> DataFrame:
    """Rows without a number continue from the last row with one (from 0 before the first)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    block = F.count(number).over(w)
    inside = Window.partitionBy(*keys, "__block").orderBy(*order)
    since = F.row_number().over(inside)
    known = F.first(number, ignorenulls=True).over(Window.partitionBy(*keys, "__block"))
    out = df.withColumn("__block", block)
    return out.withColumn(name, F.when(F.col("__block") == 0, since).otherwise(known + since - 1)).drop("__block")


def extents(df: DataFrame, keys: list[str], start: str, last: Column, name: str = "extent_end") -> DataFrame:
    """The end of each start: one less than the next start, or last; never before the start."""
    w = Window.partitionBy(*keys).orderBy(start)
    return df.withColumn(name, F.greatest(F.col(start), F.coalesce(F.lead(start).over(w) - 1, last)))


def timeline(df: DataFrame, keys: list[str], order: list[str], duration: str, overlap: str | None = None, digits: int = 4) -> DataFrame:
    """Adds start_time and end_time: running sums of durations, less the overlap that each row shares with the next;
    rounded only once summed. Sums over ranges of a key: none is held whole."""
    sums = {"__begin": F.col(duration)} | ({"__shared": F.coalesce(F.col(overlap), F.lit(0.0))} if overlap else {})
    out = running(df, keys, [F.col(c) for c in order], sums, "timeline")
    begin = F.col("__begin") - F.col("__shared") if overlap else F.col("__begin")
    return out.select(*df.columns, F.round(begin, digits).alias("start_time"), F.round(begin + F.col(duration), digits).alias("end_time"))


def transitions(df: DataFrame, keys: list[str], order: list[str], duration: str, most: float = 0.3, share: float = 0.5) -> DataFrame:
    """Adds next_duration and transition: the overlap with the next row, the least of most, a share of the shorter of
    both and half of it; 0 for the last row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    shorter = F.least(F.col(duration), F.col("next_duration"))
    out = df.withColumn("next_duration", F.lead(duration).over(w))
    return out.withColumn("transition", F.when(F.col("next_duration").isNull(), 0.0).otherwise(F.least(F.lit(most), share * shorter, shorter / 2)))


def recent(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The n newest rows of each key; order is newest first."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def sections(df: DataFrame, start: Column, end: Column, length: int) -> DataFrame:
    """A row for each fixed-length section that [start, end) touches: section, and the seconds inside it."""
    first, last = F.floor(start / length), F.floor((F.greatest(end, start + 1) - 1) / length)
    out = df.withColumn("section", F.explode(F.sequence(first, last)))
    return out.withColumn("inside", F.least(end, (F.col("section") + 1) * length) - F.greatest(start, F.col("section") * length))
