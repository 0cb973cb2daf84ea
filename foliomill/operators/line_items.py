"""Invoice rules where line items are a table: (job_id, line, description, qty, unit_price, total).

All roll-ups are partial sums per task, so an invoice with a large share of all lines is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions.exact import product, sums
from foliomill.functions.values import EXACT, MONEY, percentage_change, show_number, strip, within
from foliomill.operators.history import look_back

CENT = "0.01"


def _given(name: str) -> Column:
    """A missing number is 0, one that cannot be read is null."""
    return F.when(F.col(name).isNull(), F.lit(0).cast(MONEY)).otherwise(F.col(name).try_cast(MONEY))


def with_expected(lines: DataFrame) -> DataFrame:
    """Exact line product and whether the listed total is off by more than a cent, or cannot be reckoned."""
    lines = lines.withColumns({c: _given(c) for c in ("qty", "unit_price", "total")})
    lines = lines.withColumn("expected", product(F.col("qty"), F.col("unit_price")))
    gap = F.abs(F.try_subtract("expected", "total"))
    return lines.withColumn("off", F.coalesce(gap > F.lit(CENT).cast(MONEY), F.lit(True)))


def math_errors(lines: DataFrame) -> DataFrame:
    """One row per wrong line."""
    bad = with_expected(lines).filter("off")
    message = F.concat(
        F.lit("Line "), F.col("line").cast("string"), F.lit(": "),
        show_number(F.col("qty")), F.lit(" x "), show_number(F.col("unit_price")),
        F.lit(" = "), show_number(F.col("expected")), F.lit(", but listed as "), show_number(F.col("total")),
    )
    return bad.select("job_id", "line", message.alias("message"))


def description_key() -> Column:
    return F.lower(strip(F.coalesce("description", F.lit(""))))


def repeats(lines: DataFrame) -> DataFrame:
    """Repeated descriptions per invoice and how many of their lines are second or later."""
    named = lines.select("job_id", description_key().alias("description")).filter("description <> ''")
    counted = named.groupBy("job_id", "description").agg((F.count("*") - 1).alias("repeats"))
    return counted.filter("repeats > 0")


def mark_repeats(lines: DataFrame, position: str = "position") -> DataFrame:
    """Mark second and later occurrences of a description within an invoice.

    ``position`` orders the lines of an invoice and is unique there.
    """
    named = lines.withColumn("_key", description_key())
    out = look_back(named, ["job_id", "_key"], position, [], seen={"_before": F.lit(True)})
    return out.withColumn("repeated", (F.col("_key") != "") & F.col("_before")).drop("_key", "_before")


def invoice_checks(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per invoice: outcome of the three line rules.

    ``headers`` holds (job_id, tax, grand_total).  Lines are reduced to (invoice, description)
    first, so the join with the headers sees few rows per invoice.
    """
    by_name = (
        with_expected(lines)
        .withColumn("_key", description_key())
        .groupBy("job_id", "_key")
        .agg(F.count("*").alias("n"), F.count_if("off").alias("off"), F.try_sum("expected").alias("expected"))
    )
    per_job = by_name.groupBy("job_id").agg(
        F.sum("n").alias("lines"),
        F.sum("off").alias("wrong_lines"),
        F.sum(F.when(F.col("_key") != "", F.col("n") - 1).otherwise(0)).alias("repeated_lines"),
        F.try_sum("expected").alias("subtotal"),
    )
    joined = headers.join(per_job, "job_id", "left").fillna(0, ["lines", "wrong_lines", "repeated_lines"])
    zero = F.lit(0).cast("decimal(38,2)")
    expected = F.round(F.try_add(F.coalesce("subtotal", zero), _given("tax")), 2)
    gap = F.abs(F.try_subtract(expected, _given("grand_total")))
    return joined.select(
        "job_id",
        "lines",
        "wrong_lines",
        "repeated_lines",
        (F.col("wrong_lines") == 0).alias("line_item_math"),
        (F.col("repeated_lines") == 0).alias("no_duplicate_items"),
        F.coalesce(gap < F.lit(CENT).cast(MONEY), F.lit(False)).alias("grand_total_correct"),
    )


def sum_values(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Exact sum per group, 0.0 for a group without values."""
    return sums(df, list(by), {"total": F.col(value)}, {"n_values": F.col(value).isNotNull()})


def reconcile(headers: DataFrame, items: DataFrame, value: str, expected: str, tolerance: str = CENT) -> DataFrame:
    """Does the sum of the items match the header's total, up to and including the tolerance?"""
    sums = items.groupBy("job_id").agg(F.try_sum(F.col(value).try_cast(EXACT)).alias("_sum"))
    out = headers.join(sums, "job_id", "left")
    actual = F.coalesce("_sum", F.lit(0).cast(EXACT))
    return out.select(
        "job_id",
        actual.cast("double").alias("actual"),
        F.col(expected).try_cast("double").alias("expected"),
        within(actual, F.col(expected), tolerance).alias("matches"),
    )


def change_over_time(df: DataFrame, keys: list[str], at: str, ties: list[str], value: str) -> DataFrame:
    """Percentage change of a value against the group's row before it; a change from 0 is an error."""
    out = look_back(df, keys, at, ties, previous={"old_value": value})
    return out.withColumns(
        {
            "pct_change": percentage_change(F.col("old_value"), F.col(value)),
            "change_error": F.coalesce(F.col("old_value") == 0, F.lit(False)),
        }
    )
