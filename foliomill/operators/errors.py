"""A failing row keeps going: the stage's message is appended to its error list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stage names that head an error message, per profile.
STAGE = {
    "N": {"classify": "classifier", "validate": "validator", "analyze": "analyzer"},
    "G": {"classify": "classify", "extract": "extract", "validate": "validate", "analyze": "analyze"},
}


def append_error(df: DataFrame, stage: Column | str, message: Column) -> DataFrame:
    """Append "stage: message" where the message is not null."""
    head = F.lit(stage) if isinstance(stage, str) else stage
    line = F.concat(head, F.lit(": "), message)
    return df.withColumn("errors", F.when(message.isNotNull(), F.array_append("errors", line)).otherwise(F.col("errors")))


def failed_status(profile: str, running: str, message: Column) -> Column:
    """Profile N marks a failing stage ``failed``; profile G keeps the stage name."""
    return F.when(message.isNotNull() & F.lit(profile == "N"), "failed").otherwise(running)


def call_error(df: DataFrame, reply: str) -> Column:
    """Error text of the model call itself, where the replies came from ``infer``."""
    name = f"{reply}_error"
    return F.col(name) if name in df.columns else F.lit(None).cast("string")
