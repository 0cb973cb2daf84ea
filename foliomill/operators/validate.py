"""Run the checks of each document's type and roll them up, row-locally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.doctypes import DEFAULT, DocType, Registry
from foliomill.functions.values import EXACT, computed, within
from foliomill.operators.checks import as_rows, unsupported_checks
from foliomill.operators.errors import STAGE, append_error, failed_status

NO_CHECKS = "array<struct<rule: string, passed: boolean, detail: string>>"


def check_type(df: DataFrame, kind: DocType, data: str = "data") -> DataFrame:
    """Checks of one type over a column of parsed replies."""
    return computed(df.withColumn("checks", as_rows(kind.checks(F.col(data)))), "checks")


def validate(df: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """Profile N: column ``checks`` by document type.

    Replies the checks cannot work on get no checks and a stage error.
    """
    checks = as_rows(unsupported_checks()).cast(NO_CHECKS)
    for kind in registry.types:
        mine = as_rows(kind.checks(F.col(kind.name))).cast(NO_CHECKS)
        checks = F.when(F.col("document_type") == kind.name, mine).otherwise(checks)
    message = F.when(F.col("unusable"), "a required value is null or not a number")
    df = df.withColumn("checks", F.when(F.col("unusable"), F.array().cast(NO_CHECKS)).otherwise(checks))
    df = append_error(df, STAGE["N"]["validate"], message)
    return computed(df.withColumn("status", failed_status("N", "validating", message)), "checks", "status", "errors")


def _truthy(json_text: Column) -> Column:
    """Numbers and booleans always count as given; empty text, list and object do not."""
    return F.coalesce(~json_text.isin("null", '""', "[]", "{}"), F.lit(False))


def required_checks(fields: Column, doc_type: Column, registry: Registry = DEFAULT) -> Column:
    """Profile G: ARRAY<STRUCT<field, check, passed, message>> of the required fields."""
    out = F.array().cast("array<struct<field: string, check: string, passed: boolean, message: string>>")
    for kind in registry.types:
        rows = [
            F.struct(
                F.lit(name).alias("field"),
                F.lit("required_present").alias("check"),
                _truthy(F.try_element_at(fields, F.lit(name))).alias("passed"),
                F.when(_truthy(F.try_element_at(fields, F.lit(name))), f"Present: {name}")
                .otherwise(f"Missing: {name}")
                .alias("message"),
            )
            for name in kind.required
        ]
        if rows:
            out = F.when(doc_type == kind.name, F.array(*rows)).otherwise(out)
    return out


def amounts_match(amounts: Column, total: Column) -> Column:
    """Do all distinct amounts of a text add up to the stated total? Null when not applicable."""
    exact = F.aggregate(
        amounts,
        F.lit(0).cast(EXACT),
        lambda acc, v: F.try_add(acc, v.try_cast(EXACT)).try_cast(EXACT),
    )
    stated = F.regexp_replace(total, '^"|"$', "").try_cast("double")
    return F.when((F.size(amounts) > 0) & stated.isNotNull(), within(exact, stated))


def validate_requested(df: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """Profile G: required fields, and the total of invoices against the amounts in the text."""
    matches = F.when(
        F.col("document_type") == "invoice",
        amounts_match(F.col("extracted_amounts"), F.try_element_at("fields", F.lit("total"))),
    )
    df = df.withColumn("_total_ok", matches)
    total_row = F.array(
        F.struct(
            F.lit("total").alias("field"),
            F.lit("total_validation").alias("check"),
            F.col("_total_ok").alias("passed"),
            F.when(F.col("_total_ok"), "Total validation passed").otherwise("Total validation failed").alias("message"),
        )
    )
    required = required_checks(F.col("fields"), F.col("document_type"), registry)
    checks = F.when(F.col("_total_ok").isNotNull(), F.concat(required, total_row)).otherwise(required)
    return computed(df.withColumns({"checks": checks, "status": F.lit("validating")}).drop("_total_ok"), "checks")


def long_checks(df: DataFrame, *keep: str) -> DataFrame:
    """One row per check, for the sink and for tallies."""
    return df.select("job_id", *keep, F.inline("checks"))


def pass_rate(checks: Column) -> Column:
    """Share of passed checks; 0.5 when there are none."""
    n = F.coalesce(F.size(checks), F.lit(0))
    passed = F.size(F.filter(checks, lambda c: c["passed"]))
    return F.when(n > 0, passed / n).otherwise(0.5)


def failed_rules(checks: Column) -> Column:
    """Names of the failed checks in rule order, comma separated."""
    return F.array_join(F.transform(F.filter(checks, lambda c: ~c["passed"]), lambda c: c["rule"]), ",")


def pass_rate_table(jobs: DataFrame, checks: DataFrame) -> DataFrame:
    """The same rate from the long table: partial sums per job, then one join."""
    rates = checks.groupBy("job_id").agg(F.avg(F.col("passed").cast("int")).alias("rate"))
    return jobs.join(rates, "job_id", "left").withColumn("pass_rate", F.coalesce("rate", F.lit(0.5))).drop("rate")


def rule_tally(checks: DataFrame, *by: str) -> DataFrame:
    """Total, passed and failed checks per group."""
    return checks.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
    )
