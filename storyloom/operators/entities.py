"""The entity store as snapshots: upserts fold a log of writes into one row a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_write(log: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The last row of each key by seq: one partial aggregate a task, no sort of a key's rows."""
    rest = [c for c in log.columns if c not in keys and c not in seq]
    return log.groupBy(*keys).agg(F.max(F.struct(*seq, *rest)).alias("__l")).select(*keys, *(F.col(f"__l.{c}").alias(c) for c in log.columns if c not in keys))


def last_known(value: str, seq: list[str]) -> Column:
    """Aggregate: the value of the last row in which it is not null."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*seq)))


def first_known(value: str, seq: list[str]) -> Column:
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*seq)))


def fold(log: DataFrame, keys: list[str], seq: list[str], overwrite: list[str] = (), fill: list[str] = (), least: list[str] = (), most: list[str] = (), count: str | None = None) -> DataFrame:
    """Upsert-merge of a log of writes: overwrite takes the last known value, fill the first, least and most the
    extremes; count counts observations."""
    aggs = [last_known(c, seq).alias(c) for c in overwrite] + [first_known(c, seq).alias(c) for c in fill]
    aggs += [F.min(c).alias(c) for c in least] + [F.max(c).alias(c) for c in most] + ([F.count("*").alias(count)] if count else [])
    return log.groupBy(*keys).agg(*aggs)


def distinct_first(values: Column, n: int) -> Column:
    """Of an array of structs (seq, v): the first n distinct values in order of seq."""
    return F.slice(F.array_distinct(F.transform(F.sort_array(values), lambda s: s["v"])), 1, n)


def one_row(rows: DataFrame, keys: list[str], seq: list[str] = ()) -> DataFrame:
    """Rows that repeat a key as one: of each column, the last value by seq that is not null. Rows alike in seq, or all
    where there is none, count in the order of their JSON texts."""
    if not seq:
        rows, seq = rows.withColumn("__text", F.to_json(F.struct("*"))), ["__text"]
    rest = [c for c in rows.columns if c not in keys and c != "__text"]
    ties = [*seq] if "__text" in seq else [*seq, "__text"]
    rows = rows if "__text" in rows.columns else rows.withColumn("__text", F.to_json(F.struct("*")))
    return rows.groupBy(*keys).agg(*(last_known(c, ties).alias(c) for c in rest))


def merge_snapshot(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of new put in by key: given values overwrite, nulls leave what is there, missing keys are
    inserted. Columns that new lacks stay."""
    a, b = table.alias("a"), new.alias("b")
    on = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    value = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if c in new.columns else F.col(f"a.{c}")
    return a.join(b, on, "full").select(*(value(c).alias(c) for c in table.columns))


def merge_maps(table: DataFrame, log: DataFrame, key: str, into: str, name: str, value: str, seq: str) -> DataFrame:
    """table (key, into: a map) with the entries of log (key, name, value, seq) put in by name, the last by seq first
    of all, then what the map held. Keys that only log has are inserted, keys that only table has stay away: the result
    holds the touched keys. Entries are folded by key and name before a map is made, so a map has its distinct names only;
    null names are no entries."""
    kind = dict(table.dtypes)[into]
    last = last_write(log.where(F.col(name).isNotNull()).select(key, name, value, seq), [key, name], [seq])
    new = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(name, value))).cast(kind).alias("__new"))
    empty = F.create_map().cast(kind)
    return new.join(table.select(key, into), key, "left").select(key, F.map_concat(F.map_filter(F.coalesce(into, empty), lambda k, _: ~F.map_contains_key("__new", k)), "__new").alias(into))


def insert_missing(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table and those rows of new whose key it does not have."""
    return table.unionByName(new.join(table.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change (added, removed, changed) of the rows that differ between two snapshots."""
    rest = [c for c in before.columns if c not in keys]
    a = before.select(*keys, F.struct(*rest).alias("__old"), F.lit(True).alias("__was"))
    b = after.select(*keys, F.struct(*rest).alias("__new"), F.lit(True).alias("__is"))
    kind = F.when(F.col("__was").isNull(), "added").when(F.col("__is").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return a.join(b, keys, "full").select(*keys, kind.alias("change")).where(F.col("change").isNotNull())


def differing(a: Column, b: Column) -> Column:
    """Whether two values differ materially: both there, and unlike but for case and blanks."""
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.coalesce((key(a) != "") & (key(b) != "") & (key(a) != key(b)), F.lit(False))


def open_conflicts(evidence: DataFrame, keys: list[str], seq: list[str], value: str, source: str) -> DataFrame:
    """The first value of each key against the first later one that differs materially: a row a key that has one."""
    firsts = evidence.groupBy(*keys).agg(F.min_by(F.struct(value, source), F.struct(*seq)).alias("__f"))
    later = evidence.join(firsts, keys).where(differing(F.col(value), F.col(f"__f.{value}")))
    return later.groupBy(*keys).agg(F.first("__f").alias("__f"), F.min_by(F.struct(value, source), F.struct(*seq)).alias("__l")).select(*keys, F.col(f"__f.{value}").alias("value_a"), F.col(f"__f.{source}").alias("source_a"), F.col(f"__l.{value}").alias("value_b"), F.col(f"__l.{source}").alias("source_b"))


def resolve_conflicts(conflicts: DataFrame, preferred: str) -> DataFrame:
    """Adds resolved_value and resolved_by: the user's side first, then the preferred source, then the pdf, else b."""
    def side(source: str) -> Column:
        return F.when(F.col("source_a") == source, F.col("value_a")).when(F.col("source_b") == source, F.col("value_b"))

    value = F.coalesce(side("user"), side(preferred), side("pdf"), F.col("value_b"))
    by = F.when((F.col("source_a") == "user") | (F.col("source_b") == "user"), "user").otherwise("auto")
    return conflicts.select("*", value.alias("resolved_value"), by.alias("resolved_by"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name and n_rows of each table."""
    return reduce(DataFrame.unionByName, (t.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, t in tables.items()))


def running_count(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
