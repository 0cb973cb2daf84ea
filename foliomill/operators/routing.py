"""Review gates and what follows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions.values import computed

# Thresholds of the two gates.
OVERALL_MIN = 0.7
CLASSIFICATION_MIN = 0.8


def gate_overall(confidence: Column, anomaly_count: Column) -> Column:
    """Profile G: overall confidence high enough and nothing anomalous."""
    confidence, anomalies = F.coalesce(confidence, F.lit(0.0)), F.coalesce(anomaly_count, F.lit(0))
    return F.when((confidence >= OVERALL_MIN) & (anomalies == 0), "output").otherwise("mark_review")


def gate_rules(confidence: Column, checks: Column, errors: Column) -> Column:
    """Profile N: classified with confidence and no failed check.

    A row with a stage error always goes to review, also when the error left it without checks.
    """
    failed = F.exists(checks, lambda c: ~c["passed"])
    doubtful = (F.coalesce(confidence, F.lit(0.0)) < CLASSIFICATION_MIN) | F.coalesce(failed, F.lit(False))
    return F.when(doubtful | (F.coalesce(F.size(errors), F.lit(0)) > 0), "review_needed").otherwise("output")


def settle(df: DataFrame, gate: str = "gate") -> DataFrame:
    """Past the gate: complete and approved, or flagged for review."""
    done = F.col(gate) == "output"
    df = df.withColumns(
        {
            "status": F.when(done, "complete").otherwise("review"),
            "requires_review": ~done,
            "approved": done,
        }
    )
    return computed(df, gate, "status", "requires_review", "approved")


def review_queue(df: DataFrame) -> DataFrame:
    return df.filter((F.col("status") == "review") & F.col("requires_review"))


def final_output(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "complete")


# States of a job that is still being worked on.
IN_FLIGHT = ("pending", "classifying", "extracting", "validating", "analyzing")


def inflight_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status").isin(*IN_FLIGHT)).alias("pending_jobs"))


def job_status(jobs: DataFrame) -> DataFrame:
    """Status view with defaults for columns a job has not reached yet."""
    return jobs.select(
        "job_id",
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("document_type", F.lit("unknown")).alias("document_type"),
        F.coalesce("requires_review", F.lit(False)).alias("requires_review"),
        F.coalesce(F.size("errors"), F.lit(0)).alias("error_count"),
        "created_at",
        F.coalesce("updated_at", "created_at").alias("updated_at"),
    )
