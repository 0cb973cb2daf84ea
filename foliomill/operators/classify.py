"""Normalise classification replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.doctypes import DEFAULT, UNKNOWN, Registry
from foliomill.functions.replies import has_null, parse, readable, unfence
from foliomill.functions.values import clamp01, computed
from foliomill.operators.errors import STAGE, append_error, call_error, failed_status

UNREADABLE = "reply is not valid JSON"


def classify(
    df: DataFrame, reply: str = "classify_reply", profile: str = "N", registry: Registry = DEFAULT
) -> DataFrame:
    """Set document_type and classification_confidence from the reply.

    A type requested by the submitter wins with confidence 1.0.  Profile N sets the confidence of
    an unknown label to 0 and clamps to [0, 1]; profile G keeps the reply's number.
    """
    text = unfence(F.col(reply))
    df = df.withColumn("_text", text).withColumn("_parsed", parse(F.col("_text"), "type STRING, confidence STRING"))
    raw = F.col("_parsed.confidence")
    number = F.when(raw.isNull(), F.lit(0.0)).otherwise(raw.try_cast("double"))
    good_number = ~has_null(F.col("_text"), ("confidence",)) & number.isNotNull()
    requested = F.col("requested_type") if "requested_type" in df.columns else F.lit(None).cast("string")
    message = F.when(requested.isNotNull(), F.lit(None).cast("string")).otherwise(
        F.coalesce(
            call_error(df, reply),
            F.when(~F.coalesce(readable(F.col("_text"), F.col("_parsed")), F.lit(False)), UNREADABLE),
            F.when(~good_number, "confidence is not a number"),
        )
    )
    df = df.withColumn("_message", message)
    known = F.col("_parsed.type").isin(*registry.names)
    label = F.when(F.col("_message").isNull() & known, F.col("_parsed.type")).otherwise(UNKNOWN)
    if profile == "N":
        number = F.when(known, clamp01(number)).otherwise(0.0)
    confidence = F.when(F.col("_message").isNull(), number).otherwise(0.0)
    df = df.withColumns(
        {
            "document_type": F.coalesce(requested, label),
            "classification_confidence": F.when(requested.isNotNull(), 1.0).otherwise(confidence),
            "status": failed_status(profile, "classifying", F.col("_message")),
        }
    )
    df = append_error(df, STAGE[profile]["classify"], F.col("_message")).drop("_text", "_parsed", "_message")
    return computed(df, "document_type", "classification_confidence", "status", "errors")
