"""The ledger of conflicts between sources: evidence opens them, resolutions and corrections close them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import running


def materially_differ(a: Column, b: Column) -> Column:
    """Both say something, and not the same but for case and blanks around it."""
    key = lambda c: F.lower(F.trim(c))
    return F.coalesce((key(a) != "") & (key(b) != "") & (key(a) != key(b)), F.lit(False))


def preferred_value(preferred: Column) -> Column:
    """Which of value_a, value_b a resolution keeps: the user's, the preferred source's, that of the pdf if it is a, else b."""
    side = lambda source: F.when(F.col("source_a") == source, F.col("value_a")).when(F.col("source_b") == source, F.col("value_b"))
    return F.coalesce(side(F.lit("user")), side(preferred), F.when(F.col("source_a") == "pdf", F.col("value_a")), F.col("value_b"))


def conflict_ledger(entities: DataFrame, events: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """entities: keys, kind, value (what is stored; null or blank says nothing). events: keys, seq, event, value, source,
    confidence, where event is evidence, resolve (source: the preferred one) or correct (value: the user's).

    Evidence that differs materially from the stored value opens a conflict of its key, or meets the one that is open. A
    resolution closes the open one; a correction closes it, sets the stored value and is evidence itself, of
    confidence 1. source_a is that of the key's surest evidence so far (the first of equals), for kind metadata of the
    least sure (the last). Other events, and those of keys without an entity, open nothing.

    Returns the conflicts (keys, number, value_a, source_a, value_b, source_b, opened, n_met, resolved_value,
    resolved_by, closed; the last three null while it is open) and the values (keys, value).

    A closing event ends a stretch of its key, and a stretch has one stored value and at most one conflict, so the
    ledger is aggregates by stretch. The stretches are numbered by running sums over ranges of a key; a key of any size
    is spread, and only its stretches, not its events, are put in order in one place."""
    closing = F.col("event").isin("resolve", "correct")
    kept = events.select(*keys, "seq", "event", "value", "source", "confidence").where(F.col("event").isin("evidence", "resolve", "correct"))
    log = running(kept, keys, [F.col("seq"), F.col("event")], {"stretch": closing.cast("long")}, "ledger")
    user = F.col("event") == "correct"
    log = log.withColumns({"source": F.when(user, "user").otherwise(F.col("source")), "confidence": F.when(user, 1.0).otherwise(F.col("confidence").cast("double"))})
    rank = F.when(F.col("event") != "resolve", F.struct(F.col("confidence"), (-F.col("seq")).alias("seq"), "source"))
    by = [*keys, "stretch"]
    end = lambda c: F.max(F.when(closing, F.col(c)))
    stretches = log.groupBy(*by).agg(F.max(rank).alias("surest"), F.min(rank).alias("least_sure"), end("event").alias("end"), end("value").alias("given"), end("source").alias("preferred"), end("seq").alias("closed"))
    given = F.when(F.col("end") == "correct", F.struct("given"))
    past = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select("*", F.last(given, ignorenulls=True).over(past).alias("__set"), F.max("surest").over(past).alias("__surest"), F.min("least_sure").over(past).alias("__least"))
    known = stretches.join(entities.select(*keys, "kind", F.col("value").alias("__stored")), keys).withColumn("value_a", F.when(F.col("__set").isNotNull(), F.col("__set.given")).otherwise(F.col("__stored")))
    seen = log.where("event = 'evidence'").join(known.select(*by, "value_a"), by)
    met = seen.where(materially_differ(F.col("value_a"), F.col("value")))
    opened = met.groupBy(*by).agg(F.min(F.struct("seq", "value", "source")).alias("__b"), F.count("*").alias("n_met"))
    before = seen.join(opened.select(*by, F.col("__b.seq").alias("__open")), by).where("seq <= __open")
    so_far = before.groupBy(*by).agg(F.max(rank).alias("__surest_here"), F.min(rank).alias("__least_here"))
    out = known.join(opened, by).join(so_far, by)
    source = F.when(F.col("kind") == "metadata", F.least("__least", "__least_here")["source"]).otherwise(F.greatest("__surest", "__surest_here")["source"])
    out = out.withColumns({"source_a": source, "value_b": F.col("__b.value"), "source_b": F.col("__b.source"), "opened": F.col("__b.seq")})
    by_user = (F.col("end") == "correct") | (F.col("source_a") == "user") | (F.col("source_b") == "user")
    out = out.withColumns({"resolved_value": F.when(F.col("end") == "correct", F.col("given")).when(F.col("end") == "resolve", preferred_value(F.col("preferred"))), "resolved_by": F.when(F.col("end").isNotNull(), F.when(by_user, "user").otherwise("auto")), "number": F.row_number().over(Window.partitionBy(*keys).orderBy("stretch")).cast("long")})
    conflicts = out.select(*keys, "number", "value_a", "source_a", "value_b", "source_b", "opened", "n_met", "resolved_value", "resolved_by", "closed")
    last = log.where(user).groupBy(*keys).agg(F.max_by(F.struct("value"), "seq").alias("__set"))
    a, b = entities.alias("a"), last.alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys))
    values = a.join(b, same, "full").select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), F.when(F.col("b.__set").isNotNull(), F.col("b.__set.value")).otherwise(F.col("a.value")).alias("value"))
    return conflicts, values
