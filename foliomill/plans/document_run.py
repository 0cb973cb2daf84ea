"""From submitted documents to routed results, as one narrow plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.doctypes import DEFAULT, Registry
from foliomill.operators import analysis, prompts, routing, validate
from foliomill.operators.classify import classify
from foliomill.operators.extract import extract, extract_requested
from foliomill.operators.inference import Model, infer
from foliomill.operators.trace import StageTrace

LoadModel = Callable[[], Model]


def _ask(df: DataFrame, load_model: LoadModel | None, prompt, reply: str, cap: int | None) -> DataFrame:
    """Call the model unless the reply column is there already."""
    if reply in df.columns:
        return df
    if load_model is None:
        raise ValueError(f"need a model or a column {reply}")
    return infer(df.withColumn("_prompt", prompt), "_prompt", load_model, reply, max_concurrency=cap).drop("_prompt")


def run(
    jobs: DataFrame,
    load_model: LoadModel | None = None,
    profile: str = "N",
    registry: Registry = DEFAULT,
    max_concurrency: int | None = None,
    stages: StageTrace | None = None,
) -> DataFrame:
    """Run every stage over a table of jobs from ``admission.init_jobs``.

    The replies come from ``load_model`` or, for calls already made, from the columns
    classify_reply, extract_reply and analysis_reply.  There is no shuffle in this plan (only
    ``max_concurrency`` adds one per call); write the result once and derive the other tables from it.
    ``stages`` counts rows and failures behind each stage while the result is written.
    """
    text = F.col("document_text")
    mark = stages.mark if stages else lambda df, _: df
    df = _ask(mark(jobs, "submitted"), load_model, prompts.classify_prompt(text, registry), "classify_reply", max_concurrency)
    df = mark(classify(df, profile=profile, registry=registry), "classify")
    ask = prompts.extract_prompt(text, F.col("document_type"), profile, registry)
    df = _ask(df, load_model, ask, "extract_reply", max_concurrency)
    if profile == "N":
        df = validate.validate(mark(extract(df, registry=registry), "extract"), registry)
        data = F.coalesce(*[F.to_json(F.col(t.name)) for t in registry.types])
    else:
        df = validate.validate_requested(mark(extract_requested(df, registry=registry), "extract"), registry)
        data = F.to_json("fields")
    ask = prompts.analyze_prompt(text, F.col("document_type"), data, F.to_json("checks"), profile, registry)
    df = _ask(mark(df, "validate"), load_model, ask, "analysis_reply", max_concurrency)
    before = F.size("errors")
    df = df.withColumn("_errors", before)
    df = mark(analysis.with_confidence(analysis.analyze(df, profile=profile)), "analyze")
    if profile == "N":
        gate = routing.gate_rules(F.col("classification_confidence"), F.col("checks"), F.col("errors"))
    else:
        # A failed analysis has no confidence at all.
        known = F.when(F.size("errors") == F.col("_errors"), F.col("confidence"))
        gate = routing.gate_overall(known, F.col("anomaly_count"))
        gate = F.when(gate == "output", "output").otherwise("review_needed")
        gate = F.when(F.size("errors") > 0, "review_needed").otherwise(gate)
    return mark(routing.settle(df.withColumn("gate", gate)).drop("_errors"), "settle")


def tables(result: DataFrame) -> dict[str, DataFrame]:
    """The result tables of a run that was written once and read back."""
    return {
        "jobs": result.drop("checks"),
        "checks": validate.long_checks(result, "document_type"),
        "review_queue": routing.review_queue(result),
        "output": routing.final_output(result),
    }
