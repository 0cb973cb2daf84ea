"""The review lifecycle over a stream of submits and decisions, on Spark's keyed state.

The state of a job is its last action, one short value in the state store.  A micro-batch reads and
writes the state of the jobs it touches and no other, so its cost does not grow with what came before.  A job that is not
heard of for ``ttl_ms`` is forgotten: a late decision on it finds no job.

Within a micro-batch a job's actions are taken in order of (at, seq); micro-batches come one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from foliomill.operators.review import APPROVE, REJECT, SUBMIT, job_states

OUTCOME = "job_id STRING, step BIGINT, at BIGINT, seq BIGINT, action STRING, feedback STRING, outcome STRING"
DAY_MS = 24 * 3600 * 1000
TTL_MS = 90 * DAY_MS
# A query keeps the settings of its start.  Forgetting needs no rounds of its own: what is too old is not read.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def outcome_of(action: str, feedback: str | None, last: str | None) -> str:
    """What becomes of an action, given the job's last one that reached it."""
    if action == REJECT and not feedback:
        return "invalid"
    if action == SUBMIT:
        return "submitted"
    if last is None:
        return "not_found"
    if last != SUBMIT:
        return "conflict"
    return "approved" if action == APPROVE else "rejected"


class Lifecycle(StatefulProcessor):
    """Settles the actions of one job; keeps its last action and how many it had (``step`` orders them)."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "action STRING, steps BIGINT", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        kept = self.state.get() if self.state.exists() else None
        last, step = kept if kept else (None, 0)
        mine = pd.concat(list(rows), ignore_index=True).sort_values(["at", "seq"], kind="stable")
        steps, found = [], []
        for action, feedback in zip(mine["action"], mine["feedback"], strict=True):
            outcome = outcome_of(action, feedback, last)
            if outcome not in ("invalid", "not_found"):
                last = action
            step += 1
            steps.append(step)
            found.append(outcome)
        if last is not None:
            self.state.update((last, step))
        yield mine.assign(step=steps, outcome=found)[["job_id", "step", "at", "seq", "action", "feedback", "outcome"]]

    def close(self) -> None:
        pass


def settled(actions: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """The outcome of every action of a stream (job_id STRING, at, seq, action, feedback)."""
    rows = actions.select("job_id", "at", "seq", "action", "feedback")
    return rows.groupBy("job_id").transformWithStateInPandas(Lifecycle(ttl_ms), OUTCOME, "append", "processingTime")


def start(actions: DataFrame, folder: str, available_now: bool = False, ttl_ms: int = TTL_MS) -> StreamingQuery:
    """Outcomes are appended to ``folder``/outcomes, each once; a restart with the same folder goes on from its state."""
    conf = actions.sparkSession.conf
    before = {k: conf.get(k, None) for k in SETTINGS}
    writer = settled(actions, ttl_ms).writeStream.format("parquet").option("path", f"{folder}/outcomes").option("checkpointLocation", f"{folder}/checkpoint")
    for k, v in SETTINGS.items():
        conf.set(k, v)
    try:
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def read_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(OUTCOME).parquet(f"{folder}/outcomes")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """Status of every job over all micro-batches."""
    # A job's steps are numbered in the order in which they were settled.
    return job_states(read_outcomes(spark, folder).withColumn("at", F.col("step")))
