"""Tables in the folder that driver and executors share: the only way in which an operator cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_own_dir: dict[str, str] = {}
_scratch: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where Spark runs in this one process (a local master, as in tests) and the setting is
    unset, a folder of our own takes its place."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own_dir:
        _own_dir["dir"] = tempfile.mkdtemp(prefix="storyloom-")
    return _own_dir["dir"]


@contextmanager
def tidy(spark: SparkSession):
    """Actions inside leave no shuffle files behind: they are deleted as soon as each one has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/storyloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: the lineage ends there, and a lost
    executor costs a re-read only. The tables go with the shared folder, which the cluster empties after a job."""
    path = new_path(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_to = path
    for made in _scratch:
        made.append(table)
    return table


@contextmanager
def scratch(*kept: list[DataFrame]):
    """Tables that materialize writes inside are deleted at the end, but for those in kept (a list that may be filled inside): what is
    still to be run must read those alone. Nothing is deleted where an error leaves it."""
    made: list[DataFrame] = []
    _scratch.append(made)
    try:
        yield
    finally:
        _scratch.remove(made)
    stays = {id(t) for tables in kept for t in tables}
    drop(*(t for t in made if id(t) not in stays))


def drop(*tables: DataFrame) -> None:
    """Delete tables that materialize has written and that nothing still to be run reads."""
    for table in tables:
        if path := getattr(table, "_written_to", None):
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def once(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows of df whose key no other row has, and the others; None where there are none. Only keys are counted, so where
    none repeats, no row is moved."""
    again = materialize(df.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(F.col(key).alias("__again")), "again")
    if again.isEmpty():
        drop(again)
        return df, None
    same = F.col(key).eqNullSafe(F.col("__again"))
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


#: Rows that one task works on, where each asks for much work: a short table is one file, and so one task, however many rows it has.
ROWS = 10_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys in as many tasks as its rows ask for; as it is where one would do."""
    n = -(-df.count() // ROWS)
    return df.repartition(n, *keys) if n > 1 else df


def placed(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """df as a written table, dealt by ranges of keys and order: __i numbers all rows in that order (with gaps), __p is
    the range. A key of any size lies in many ranges, each of which a task holds; rows alike in keys and order lie in one.
    Keys may be null."""
    ranged = df.repartitionByRange(*(F.col(k) for k in keys), *order).sortWithinPartitions(*(F.col(k) for k in keys), *order)
    return materialize(ranged.withColumn("__i", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__i", 33)), name)


def _joined(left: DataFrame, right: DataFrame, by: list[str], added: list[Column], columns: list[str]) -> DataFrame:
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
    return left.alias("l").join(right.alias("r"), on=same, how="inner").select(*(F.col(f"l.{c}") for c in columns), *added)


def sums_before(table: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name in sums, the sum of that column over the rows of the same keys that come before, to a table
    of placed: sums within a range, and the sums of a key's earlier ranges, a row a range, on top."""
    named = {f"__s{i}": c for i, c in enumerate(sums.values())}
    valued = table.select("*", *(c.alias(k) for k, c in named.items()))
    by = [*keys, "__p"]
    totals = valued.groupBy(*by).agg(*(F.sum(k).alias(f"{k}t") for k in named))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, *(F.coalesce(F.sum(f"{k}t").over(before), F.lit(0)).alias(f"{k}o") for k in named))
    here = Window.partitionBy(*by).orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    local = valued.select("*", *(F.coalesce(F.sum(k).over(here), F.lit(0)).alias(f"{k}l") for k in named))
    return _joined(local, starts, by, [(F.col(f"l.{k}l") + F.col(f"r.{k}o")).alias(name) for k, name in zip(named, sums)], table.columns)


def row_before(table: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Adds the value of column in the row of the same keys before (null for the first), to a table of placed: from the
    same range, or the last row of the key's range before, of which there is one a range."""
    by = [*keys, "__p"]
    lasts = table.groupBy(*by).agg(F.max_by(F.struct(column), "__i").alias("__last"))
    lasts = lasts.withColumn("__over", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__p"))).drop("__last")
    local = table.withColumn("__in", F.lag(F.struct(column)).over(Window.partitionBy(*by).orderBy("__i")))
    return _joined(local, lasts, by, [F.coalesce("l.__in", "r.__over")[column].alias(name)], table.columns)


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], name: str = "running") -> DataFrame:
    """Adds, for each name in sums, the sum of that column over the rows of the same keys that come before in order. No
    task holds a whole key. Rows alike in keys and order come in any order."""
    return sums_before(placed(df, keys, order, name), keys, sums).drop("__i", "__p")
