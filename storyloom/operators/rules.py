"""Row and table quality rules: one row a rule, from one pass over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(table: DataFrame, rules: dict[str, tuple[Column, bool]]) -> DataFrame:
    """rules: name -> (what holds for a good row, critical). Returns rule, critical, n_rows, n_failed, status (ok,
    warning or error); rows for which a rule is null fail it."""
    sums = table.agg(F.count("*").alias("n"), *(F.count_if(~F.coalesce(c, F.lit(False))).alias(f"f{i}") for i, (c, _) in enumerate(rules.values())))
    rows = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(critical).alias("critical"), F.col("n").alias("n_rows"), F.col(f"f{i}").alias("n_failed")) for i, (name, (_, critical)) in enumerate(rules.items())))
    status = F.when(F.col("n_failed") == 0, "ok").when(F.col("critical"), "error").otherwise("warning")
    return sums.select(F.inline(rows)).withColumn("status", status)


def overall(checked: DataFrame) -> DataFrame:
    """error if a critical rule fails, warning if another one does, else ok."""
    worst = F.when(F.bool_or(F.col("status") == "error"), "error").when(F.bool_or(F.col("status") == "warning"), "warning").otherwise("ok")
    return checked.agg(worst.alias("status"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.count("*").alias("n_rules"))


def errors(checks: dict[str, Column]) -> Column:
    """Array of the names of the checks that a row fails."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items())))


def split_valid(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all checks, and the others with their errors."""
    judged = rows.withColumn("errors", errors(checks))
    return judged.where(F.size("errors") == 0).drop("errors"), judged.where(F.size("errors") > 0)
