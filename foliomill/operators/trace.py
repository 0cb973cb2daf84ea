"""Trace of the stages: views, durations and totals."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from foliomill.functions.exact import sums
from foliomill.functions.values import elapsed_ms, epoch_micros


class StageTrace:
    """Counts rows and failures behind each stage of a run while its result is written: no pass of its own.

    ``mark`` is called behind every stage, ``write`` once.  The stages of a run work on a row one after the
    other, so they share start and end.
    """

    SCHEMA = "node_name string, rows_in bigint, rows_out bigint, failures bigint, started_at timestamp, completed_at timestamp, duration_ms double"

    def __init__(self) -> None:
        self.marks: list[tuple[str, Observation]] = []

    def mark(self, df: DataFrame, name: str) -> DataFrame:
        seen = Observation(f"{len(self.marks)} {name}")
        self.marks.append((name, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors"))

    def write(self, result: DataFrame, save: Callable[[DataFrame], None]) -> DataFrame:
        """Save the result of the run; one row per stage with what came in, what went on and what failed there."""
        started = datetime.now(UTC)
        save(result)
        done = datetime.now(UTC)
        counts = [seen.get for _, seen in self.marks]
        spent = (done - started).total_seconds() * 1000
        rows = [
            (name, before["rows"], after["rows"], after["errors"] - before["errors"], started, done, spent)
            for (name, _), before, after in zip(self.marks[1:], counts, counts[1:], strict=False)
        ]
        return SparkSession.active().createDataFrame(rows, self.SCHEMA)


def view(trace: DataFrame) -> DataFrame:
    """Steps with defaults for what a stage did not record."""
    return trace.select(
        "job_id",
        F.coalesce("node_name", F.lit("unknown")).alias("node_name"),
        "started_at",
        "completed_at",
        F.coalesce("input_keys", F.array().cast("array<string>")).alias("input_keys"),
        F.coalesce("output_keys", F.array().cast("array<string>")).alias("output_keys"),
        F.coalesce("duration_ms", F.lit(0.0)).alias("duration_ms"),
        F.coalesce("cost", F.lit(0.0)).alias("cost"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


def ordered(trace: DataFrame) -> DataFrame:
    """Steps per job in time order, by range sort."""
    return view(trace).orderBy("job_id", "started_at", "node_name")


def with_duration(trace: DataFrame) -> DataFrame:
    """duration_ms from the start and end of each step."""
    spent = elapsed_ms(epoch_micros(trace, "started_at"), epoch_micros(trace, "completed_at"))
    return trace.withColumn("duration_ms", spent)


def totals(trace: DataFrame, *by: str) -> DataFrame:
    """Steps, failures, cost and duration per group (partial sums, so a hot job is no problem)."""
    failed = F.coalesce("error", F.lit("")) != ""
    totals = {"total_cost": F.col("cost"), "total_duration_ms": F.col("duration_ms")}
    return sums(trace, list(by), totals, {"steps": F.lit(True), "failed_steps": failed})
