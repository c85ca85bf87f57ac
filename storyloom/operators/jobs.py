"""Stages with checkpoints: a small control table says what is done; each stage is a DataFrame job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import read_snapshot, write_snapshot

FIELDS = "stage STRING, position INT, status STRING, attempts INT, fingerprint STRING, updated_at TIMESTAMP"


def fingerprint(inputs: DataFrame) -> str:
    """A hash of a table's rows that no order of them changes, from one aggregate."""
    row = inputs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*inputs.columns)).alias("x"), F.sum(F.xxhash64(*inputs.columns).cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}-{row['x']}-{row['s']}"


def mark_of(*columns: str):
    """Aggregate: a mark of a group's rows that no order of them changes."""
    each = F.xxhash64(*columns)
    return F.struct(F.count("*"), F.bit_xor(each), F.sum(each.cast("decimal(38,0)")))


def recovered(stages: DataFrame) -> DataFrame:
    """Stages of a control table after a restart: what was running is pending again."""
    return stages.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def progress(stages: DataFrame, keys: list[str]) -> DataFrame:
    """stages (keys, position, status): how many are completed and of how many, whether all are, the first that is not,
    and the percentage."""
    done = F.col("status") == "completed"
    return stages.groupBy(*keys).agg(F.count_if(done).alias("n_completed"), F.count("*").alias("n_stages"), F.bool_and(done).alias("complete"), F.min(F.when(~done, F.col("position"))).alias("next_pending"), F.round(100.0 * F.count_if(done) / F.count("*"), 2).alias("percent"))


def pending(keys: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Keys that are not done yet."""
    return keys.join(done.select(*on).distinct(), on, "left_anti")


@dataclass
class Pipeline:
    """Named stages in order. run() goes on from the first stage that is not completed; a stage that was running when a
    driver died is pending again; another fingerprint of the input makes all stages pending."""

    spark: SparkSession
    path: str
    stages: list[tuple[str, Callable[[SparkSession], None]]]
    state: dict[str, dict] = field(default_factory=dict)

    def load(self) -> dict[str, dict]:
        names = [n for n, _ in self.stages]
        rows = {r["stage"]: r.asDict() for r in read_snapshot(self.spark, self.path, FIELDS).collect()}
        blank = lambda i, n: {"stage": n, "position": i, "status": "pending", "attempts": 0, "fingerprint": None, "updated_at": None}
        self.state = {n: rows.get(n) or blank(i, n) for i, n in enumerate(names)}
        for s in self.state.values():
            if s["status"] == "running":
                s["status"] = "pending"
        return self.state

    def save(self) -> None:
        rows = [tuple(s[k] for k in ("stage", "position", "status", "attempts", "fingerprint", "updated_at")) for s in self.state.values()]
        write_snapshot(self.spark.createDataFrame(rows, FIELDS).coalesce(1), self.path)

    def mark(self, name: str, status: str) -> None:
        s = self.state[name]
        s["status"], s["updated_at"] = status, dt.datetime.now(dt.timezone.utc).replace(microsecond=0, tzinfo=None)
        s["attempts"] += status == "running"
        self.save()

    def next_pending(self) -> str | None:
        return next((n for n, s in self.state.items() if s["status"] != "completed"), None)

    def run(self, of: str, force: bool = False) -> list[str]:
        """Runs what is pending for the input with fingerprint `of`; returns the stages run. An error ends the run, and
        the next one starts at that stage."""
        self.load()
        known = {s["fingerprint"] for s in self.state.values()}
        if force or (known != {of}):
            for s in self.state.values():
                s.update(status="pending", fingerprint=of)
        ran = []
        for name, stage in self.stages:
            if self.state[name]["status"] == "completed":
                continue
            self.mark(name, "running")
            try:
                stage(self.spark)
            except Exception:
                self.mark(name, "failed")
                raise
            self.mark(name, "completed")
            ran.append(name)
        return ran
