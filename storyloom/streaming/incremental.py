"""Incremental runs: each item of a stream is worked on once, whatever is replayed, and what fails is kept apart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Versions


#: Rows of a batch that a task sorts. Adaptive execution goes by compressed bytes, and puts millions of short rows in a task.
ROWS = 250_000


def tasks(rows: int) -> int:
    return max(1, -(-rows // ROWS))


def dealt(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """df by its keys in n tasks; as it is where one would do."""
    return df.repartition(n, *keys) if n > 1 else df


@dataclass(frozen=True)
class Incremental:
    """Outcomes of items in a versioned table: keys, the columns of `result` (DDL), outcome (done, failed, skipped), error
    and batch. work maps a DataFrame of items to one of keys, result columns and error (null: it went well).

    A batch's outcomes and its number are put in place by one pointer, so a crash leaves both or neither, and a replayed
    batch is seen and writes nothing. An item that is done is skipped when it comes again, unless forced; one that
    failed is tried again. Items without an answer of work have failed."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    key_ddl: str
    result: str
    work: Callable[[DataFrame], DataFrame]
    name: str = "run"

    @property
    def outcomes(self) -> Versions:
        return Versions(self.spark, self.path, f"{self.key_ddl}, {self.result}, outcome STRING, error STRING, batch BIGINT")

    def done(self) -> DataFrame:
        """Results of the items that went well."""
        return self.outcomes.read().where("outcome = 'done'").drop("outcome", "error")

    def dead_letters(self) -> DataFrame:
        """Items that failed and have not gone well since, with their last error."""
        keys, outcomes = list(self.keys), self.outcomes.read()
        n = tasks(outcomes.count())
        failed = dealt(outcomes.where("outcome = 'failed'"), n, keys).groupBy(*keys).agg(F.max_by("error", "batch").alias("error"), F.count("*").alias("attempts"))
        return failed.join(dealt(self.done().select(*keys), n, keys), keys, "left_anti")

    def tallies(self) -> DataFrame:
        """batch, and how many of its items were done, skipped and failed."""
        count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
        return self.outcomes.read().groupBy("batch").agg(count("done"), count("skipped"), count("failed"))

    def process(self, items: DataFrame, batch: int, force: bool = False) -> bool:
        """Works on a batch of items (those that repeat a key once). False where the batch has been recorded before."""
        if self.outcomes.marks().get(self.name, -1) >= batch:
            return False
        keys = list(self.keys)
        done = self.done().select(*keys)
        # Both sides lie by key in as many tasks as their rows ask for, through all steps below.
        n = tasks(max(items.count(), done.count()))
        items, known = dealt(items, n, keys).dropDuplicates(keys), dealt(done, n, keys)
        todo = items if force else items.join(known, keys, "left_anti")
        answers = self.work(todo)
        missing = F.when(F.col("__answered").isNull(), "no answer").otherwise(F.col("error"))
        judged = todo.select(*keys).join(answers.withColumn("__answered", F.lit(True)), keys, "left").withColumn("error", missing)
        out = judged.withColumn("outcome", F.when(F.col("error").isNull(), "done").otherwise("failed")).drop("__answered")
        if not force:
            out = out.unionByName(items.join(known, keys, "left_semi").select(*keys, F.lit("skipped").alias("outcome")), allowMissingColumns=True)
        return self.outcomes.add(out.withColumn("batch", F.lit(batch).cast("bigint")), (self.name, batch))

    def run(self, stream: DataFrame, checkpoint: str, force: bool = False) -> None:
        """Works on all that the stream has, and stops. A restart from the checkpoint goes on where this left off."""
        each = lambda items, batch: self.process(items, batch, force)
        stream.writeStream.foreachBatch(lambda items, batch: (each(items, batch), None)[1]).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def still_to_do(items: DataFrame, marks: DataFrame, outputs: DataFrame, on: list[str]) -> DataFrame:
    """items without those that are marked (on, status) as skipped, or as completed with an output (on) that is there: a mark
    whose output is lost is work again."""
    kept = marks.join(outputs.select(*on).distinct().withColumn("__there", F.lit(True)), on, "left")
    settled = kept.where((F.col("status") == "skipped") | ((F.col("status") == "completed") & F.col("__there")))
    return items.join(settled.select(*on).distinct(), on, "left_anti")


def picked(segments: DataFrame, keys: list[str], place: str, number: int | None = None) -> DataFrame:
    """All segments, or of each key the one at a place counted from 1. Keys that have no such place are given with a null
    place and the error out of range, so that a wrong number is seen."""
    if number is None:
        return segments.withColumn("error", F.lit(None).cast("string"))
    each = segments.select(*keys).distinct()
    found = segments.where(F.col(place) == number)
    wrong = F.when(F.col(place).isNull(), F.lit(f"segment {number} is out of range"))
    return each.join(found, keys, "left").withColumn("error", wrong)
