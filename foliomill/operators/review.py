"""Review decisions: who may decide what, and what becomes of a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.operators.history import look_back

APPROVE, REJECT, SUBMIT = "approve", "reject", "submit"


def with_validity(decisions: DataFrame) -> DataFrame:
    """A rejection needs feedback, an approval does not."""
    given = F.coalesce(F.length("feedback"), F.lit(0)) >= 1
    return decisions.withColumn("valid", (F.col("action") != REJECT) | given)


def guard(decisions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Verdict on each decision against the jobs table: ok, not_found, conflict or invalid.

    ``decisions`` may be skewed on job_id; ``jobs`` has one row per job.  No side is broadcast by
    hint: Catalyst broadcasts the jobs only below its size threshold, else AQE splits hot jobs.
    """
    known = jobs.select("job_id", F.col("status").alias("job_status"), "requires_review")
    out = with_validity(decisions).join(known, "job_id", "left")
    waiting = (F.col("job_status") == "review") | F.coalesce("requires_review", F.lit(False))
    return out.withColumn(
        "verdict",
        F.when(~F.col("valid"), "invalid")
        .when(F.col("job_status").isNull(), "not_found")
        .when(~waiting, "conflict")
        .otherwise("ok"),
    )


def apply_decisions(guarded: DataFrame) -> DataFrame:
    """State update of each accepted decision."""
    approved = F.col("action") == APPROVE
    return guarded.filter("verdict = 'ok'").select(
        "job_id",
        F.when(approved, "complete").otherwise("failed").alias("status"),
        approved.alias("approved"),
        F.coalesce("feedback", F.lit("")).alias("review_feedback"),
        F.lit(False).alias("requires_review"),
    )


def outcomes(actions: DataFrame) -> DataFrame:
    """Outcome of every action of the review lifecycle, in order of (at, seq) within a job.

    ``actions`` holds (job_id, at, seq, action, feedback) with action submit, approve or reject.
    A submit opens a review.  The first valid decision after it is effective, further ones
    conflict, and decisions before any submit find no job.  So the action right before a
    decision settles it, and no job's rows have to be walked one by one.
    """
    checked = with_validity(actions)
    columns = ["job_id", "at", "seq", "action", "feedback"]
    # Refused decisions never reach the job, so they are no predecessor either.
    valid = checked.filter("valid").select(*columns)
    valid = look_back(valid, ["job_id"], "at", ["seq"], previous={"last_action": "action"}, seen={"submitted_before": F.col("action") == SUBMIT})
    outcome = (
        F.when(F.col("action") == SUBMIT, "submitted")
        .when(~F.col("submitted_before"), "not_found")
        .when(F.col("last_action") != SUBMIT, "conflict")
        .when(F.col("action") == APPROVE, "approved")
        .otherwise("rejected")
    )
    refused = checked.filter("NOT valid").select(*columns, F.lit("invalid").alias("outcome"))
    return valid.select(*columns, outcome.alias("outcome")).unionByName(refused)


# Job status after an effective action.
STATUS_AFTER = {"submitted": "review", "approved": "complete", "rejected": "failed"}


def job_states(outcome: DataFrame) -> DataFrame:
    """Status of each job after its last effective action (partial maximum per task, then per job)."""
    after = F.create_map(*[F.lit(x) for pair in STATUS_AFTER.items() for x in pair])
    effective = outcome.filter(F.col("outcome").isin(*STATUS_AFTER))
    last = effective.groupBy("job_id").agg(
        F.max(F.struct("at", "seq", "action", "outcome", "feedback")).alias("last"),
        F.count_if(F.col("action") == SUBMIT).alias("submits"),
        F.count_if(F.col("action") != SUBMIT).alias("effective_decisions"),
    )
    return last.select(
        "job_id",
        F.try_element_at(after, F.col("last.outcome")).alias("status"),
        (F.col("last.outcome") == "submitted").alias("requires_review"),
        (F.col("last.outcome") == "approved").alias("approved"),
        F.when(F.col("last.action") != SUBMIT, F.coalesce("last.feedback", F.lit(""))).otherwise("").alias("review_feedback"),
        "submits",
        "effective_decisions",
    )
