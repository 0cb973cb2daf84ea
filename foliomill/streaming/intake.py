"""Continuous intake: submitted documents run through the same stages as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foliomill.operators import validate
from foliomill.operators.trace import StageTrace

Stages = Callable[..., DataFrame]  # (batch, stages=StageTrace) -> results


def start(submissions: DataFrame, stages: Stages, folder: str, available_now: bool = False) -> StreamingQuery:
    """Run ``stages`` on every micro-batch and keep results, checks and stage trace under ``folder``.

    ``folder`` must be reachable by all executors.  Each table is written into the batch's own
    folder with overwrite, so a batch that is repeated after a failure leaves no duplicates.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        where = f"{folder}/{{}}/batch_id={batch_id}"
        marks = StageTrace()
        rows = marks.write(stages(batch, stages=marks), lambda df: df.write.mode("overwrite").parquet(where.format("results")))
        rows.write.mode("overwrite").parquet(where.format("trace"))
        done = spark.read.parquet(where.format("results"))  # written once, then only read
        validate.long_checks(done).write.mode("overwrite").parquet(where.format("checks"))

    writer = submissions.writeStream.foreachBatch(process).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read(spark: SparkSession, folder: str, table: str = "results") -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}")
