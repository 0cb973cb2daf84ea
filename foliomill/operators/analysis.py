"""Analysis replies: findings, counts and the overall confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions.replies import has_null, parse, readable, unfence
from foliomill.functions.values import computed
from foliomill.operators.classify import UNREADABLE
from foliomill.operators.errors import STAGE, append_error, call_error, failed_status
from foliomill.operators.validate import pass_rate

# Shape of the findings in each profile.
FINDINGS = {
    "N": {
        "risks": "ARRAY<STRUCT<risk: STRING, severity: STRING, clause: STRING>>",
        "anomalies": "ARRAY<STRUCT<type: STRING, detail: STRING, severity: STRING>>",
        "insights": "ARRAY<STRUCT<insight: STRING, metric: STRING, recommendation: STRING>>",
    },
    "G": {"risks": "ARRAY<STRING>", "anomalies": "ARRAY<STRING>", "insights": "ARRAY<STRING>"},
}


def analyze(df: DataFrame, reply: str = "analysis_reply", profile: str = "N") -> DataFrame:
    """Findings of the reply (missing lists are empty), their counts and the overall confidence."""
    kinds = FINDINGS[profile]
    schema = ", ".join(f"{name} {kind}" for name, kind in kinds.items()) + ", summary STRING, analysis STRING"
    df = df.withColumn("_text", unfence(F.col(reply))).withColumn("_parsed", parse(F.col("_text"), schema))
    nulls = has_null(F.col("_text"), tuple(kinds)) if profile == "G" else F.lit(False)
    message = F.coalesce(
        call_error(df, reply),
        F.when(~F.coalesce(readable(F.col("_text"), F.col("_parsed")), F.lit(False)), UNREADABLE),
        F.when(nulls, "a list of findings is null"),
    )
    df = df.withColumn("_message", message)
    ok = F.col("_message").isNull()
    df = df.withColumns(
        {name: F.coalesce(F.when(ok, F.col(f"_parsed.{name}")), F.array().cast(kind)) for name, kind in kinds.items()}
    )
    df = df.withColumns(
        {
            "summary": F.coalesce(F.when(ok, F.col("_parsed.summary")), F.lit("")),
            "analysis_detail": F.when(ok, F.col("_parsed.analysis")),
            "risk_count": F.size("risks"),
            "anomaly_count": F.size("anomalies"),
            "insight_count": F.size("insights"),
            "status": failed_status(profile, "analyzing", F.col("_message")),
        }
    )
    df = append_error(df, STAGE[profile]["analyze"], F.col("_message")).drop("_text", "_parsed", "_message")
    return computed(df, "risk_count", "anomaly_count", "insight_count", "status", "errors")


def severity_count(findings: Column, level: str) -> Column:
    return F.size(F.filter(findings, lambda f: F.lower(f["severity"]) == level))


def overall_confidence(classification: Column, rate: Column) -> Column:
    return (classification + rate) / 2


def with_confidence(df: DataFrame) -> DataFrame:
    """pass_rate of the checks and the mean of it and the classification confidence."""
    df = df.withColumn("pass_rate", pass_rate(F.col("checks")))
    df = df.withColumn("confidence", overall_confidence(F.col("classification_confidence"), F.col("pass_rate")))
    return computed(df, "pass_rate", "confidence")
