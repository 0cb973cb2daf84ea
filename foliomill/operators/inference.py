"""Batch model calls: a user function over a prompt column."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

Model = Callable[[list[str]], list[str]]


def _answers(model: Model, prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """Replies of one batch; when the batch fails, each prompt is tried alone."""
    try:
        replies = model(prompts)
        if len(replies) != len(prompts):
            raise ValueError("one reply per prompt expected")
        return [(r, None) for r in replies]
    except Exception as exc:  # noqa: BLE001 - any model failure becomes an error on its row
        if len(prompts) <= 1:
            return [(None, str(exc))] * len(prompts)
        return [answer for p in prompts for answer in _answers(model, [p])]


def infer(
    df: DataFrame,
    prompt: str,
    load_model: Callable[[], Model],
    reply: str = "reply",
    batch: int = 64,
    max_concurrency: int | None = None,
) -> DataFrame:
    """Add the model's reply and ``<reply>_error`` to every row.

    ``load_model`` runs once per task and returns the batch function.  Only the prompt column
    crosses to Python, in Arrow batches.  ``max_concurrency`` caps the tasks that call the model.
    A row whose call fails keeps going with a null reply and the error text.
    """

    @F.pandas_udf("struct<reply: string, error: string>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for prompts in batches:
            texts = prompts.fillna("").tolist()
            answers = [a for i in range(0, len(texts), batch) for a in _answers(model, texts[i : i + batch])]
            yield pd.DataFrame(answers, columns=["reply", "error"])

    if max_concurrency:
        df = df.repartition(max_concurrency)
    # Marked non-deterministic so that Catalyst never evaluates a paid call twice for one row.
    out = df.withColumn("_answer", call.asNondeterministic()(F.col(prompt)))
    return (
        out.withColumn(reply, F.col("_answer.reply"))
        .withColumn(f"{reply}_error", F.col("_answer.error"))
        .drop("_answer")
    )


KEPT = "digest STRING, reply STRING"


def kept_replies(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, reply) of all prompts answered so far; none where nothing was kept yet."""
    try:
        return spark.read.schema(KEPT).parquet(folder).select("digest", "reply")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # anything else is a fault of the folder
            raise
        return spark.createDataFrame([], KEPT)


def infer_once(
    df: DataFrame,
    prompt: str,
    load_model: Callable[[], Model],
    folder: str,
    run: str,
    reply: str = "reply",
    batch: int = 64,
    max_concurrency: int | None = None,
) -> DataFrame:
    """Like ``infer``, but each prompt is paid once, over all runs that share ``folder``.

    Replies are kept by the digest of their prompt.  Only prompts without one are called, equal ones once, and theirs are
    added as ``run``; a run that is repeated calls only what is still missing.  Failed calls are not kept, so the next run
    tries them again.  Only digests and prompts are moved for that; the other columns meet the replies in one join.
    """
    spark = df.sparkSession
    asked = F.coalesce(F.col(prompt), F.lit(""))
    digest = F.sha2(asked, 256)
    known = kept_replies(spark, folder)
    new = df.select(digest.alias("digest"), asked.alias("_prompt")).groupBy("digest").agg(F.any_value("_prompt").alias("_prompt"))
    new = infer(new.join(known, "digest", "left_anti"), "_prompt", load_model, "reply", batch, max_concurrency)
    answered = f"{folder.rstrip('/')}/run={run}"
    tried = f"{folder.rstrip('/')}-tried/run={run}"
    new.select("digest", "reply", "reply_error").write.mode("overwrite").parquet(tried)
    done = spark.read.schema(KEPT + ", reply_error STRING").parquet(tried)
    done.filter("reply IS NOT NULL AND reply_error IS NULL").select("digest", "reply").write.mode("append").parquet(answered)
    failed = done.filter("reply IS NULL OR reply_error IS NOT NULL").select("digest", F.lit(None).cast("string").alias("reply"), F.coalesce("reply_error", F.lit("no reply")).alias("error"))
    answers = kept_replies(spark, folder).dropDuplicates(["digest"]).withColumn("error", F.lit(None).cast("string")).unionByName(failed)
    answers = answers.withColumnsRenamed({"digest": "_digest", "reply": reply, "error": f"{reply}_error"})
    return df.withColumn("_asked", digest).join(answers, F.col("_asked") == F.col("_digest"), "left").drop("_asked", "_digest")


def keyword_model() -> Model:
    """Deterministic stand-in for a hosted model: classifies by counting words."""
    words = {
        "invoice": re.compile(r"\b(?:invoice|total|due|vendor|tax)\b", re.I),
        "contract": re.compile(r"\b(?:agreement|party|parties|clause|termination|hereby)\b", re.I),
        "report": re.compile(r"\b(?:report|revenue|quarter|kpi|summary)\b", re.I),
    }

    def reply(prompt: str) -> str:
        hits = {kind: len(pattern.findall(prompt)) for kind, pattern in words.items()}
        total = sum(hits.values())
        best = max(sorted(hits), key=lambda kind: hits[kind])
        if total == 0:
            return json.dumps({"type": "unknown", "confidence": 0.0})
        return json.dumps({"type": best, "confidence": round(hits[best] / total, 4)})

    return lambda prompts: [reply(p) for p in prompts]
