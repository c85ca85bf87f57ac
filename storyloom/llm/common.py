"""What the training-data operators share: words and two-level prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.tables import drop, materialize, shared_dir, tidy  # noqa: F401

#: A word is a maximal run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def unused(df: DataFrame, *names: str) -> list[str]:
    """Those names, each with underscores put before it until df has no column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def positions(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], rows: int | None = None, per_bucket: int = 5_000) -> DataFrame:
    """Adds, for each name in sums, the sum of that column over the rows of the same keys that come earlier.

    "Earlier" is a fixed pseudo-random order: rows are dealt to buckets by a hash of the order columns, buckets
    follow each other, and within a bucket the hash and then the order columns decide. No task ever holds a whole
    key: a bucket holds about per_bucket rows however many rows a key has, and only the buckets' totals are
    summed over a key. Rows that agree in every order column keep distinct, arbitrary places.
    df should be a written table, as it is read twice. rows: its row count, if known."""
    rows = df.count() if rows is None else rows
    buckets = max(1, -(-rows // per_bucket))
    keyed = df.withColumn("__h", F.xxhash64(*order)).withColumn("__b", F.pmod("__h", F.lit(buckets)))
    named = {f"__s{i}": c for i, c in enumerate(sums.values())}
    for k, c in named.items():
        keyed = keyed.withColumn(k, c)
    by = [*keys, "__b"]
    totals = keyed.groupBy(*by).agg(*(F.sum(k).alias(f"{k}t") for k in named))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, *(F.coalesce(F.sum(f"{k}t").over(before), F.lit(0)).alias(f"{k}o") for k in named))
    here = Window.partitionBy(*by).orderBy("__h", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = keyed.select("*", *((F.sum(k).over(here) - F.col(k)).alias(f"{k}l") for k in named))
    left, right = local.alias("l"), starts.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
    joined = left.join(right, on=same, how="inner")
    return joined.select(*(F.col(f"l.{c}") for c in df.columns), *((F.col(f"l.{k}l") + F.col(f"r.{k}o")).alias(name) for k, name in zip(named, sums)))
