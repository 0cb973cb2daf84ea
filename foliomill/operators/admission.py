"""Admission of submitted documents and the initial state of a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.doctypes import DEFAULT, UNKNOWN, Registry


def refusal_reason(text: Column, requested: Column, registry: Registry = DEFAULT) -> Column:
    """Why a submission is refused, null when it is accepted."""
    known = requested.isin(*registry.names, UNKNOWN)
    return F.when(F.coalesce(F.length(text), F.lit(0)) < 1, "empty document_text").when(
        requested.isNotNull() & ~known, "unsupported document_type"
    )


def with_admission(subs: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """Mark every submission; the caller writes refused rows to the quarantine table."""
    reason = refusal_reason(F.col("document_text"), F.col("requested_type"), registry)
    return subs.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def admit(subs: DataFrame, registry: Registry = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused with reason): two filters over the same narrow plan."""
    marked = with_admission(subs, registry)
    return marked.filter("accepted").drop("accepted", "reason"), marked.filter("NOT accepted").drop("accepted")


def init_jobs(docs: DataFrame, created_at: Column, key: str | None = None) -> DataFrame:
    """Initial state of each job.

    Every submission is a job of its own.  ``key`` names its unique source key, which is the job id and the
    same in every run; without one the id is drawn, so write the jobs once and read them from there.
    """
    job_id = F.col(key).cast("string") if key else F.uuid()
    return docs.withColumns(
        {
            "job_id": job_id,
            "document_type": F.lit(UNKNOWN),
            "classification_confidence": F.lit(0.0),
            "summary": F.lit(""),
            "status": F.lit("pending"),
            "requires_review": F.lit(False),
            "review_feedback": F.lit(""),
            "approved": F.lit(False),
            "total_cost": F.lit(0.0),
            "errors": F.array().cast("array<string>"),
            "created_at": created_at,
            "updated_at": created_at,
        }
    )
