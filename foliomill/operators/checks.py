"""Business rules over one parsed reply, as row-local column expressions.

A reply is bounded by the model's output limit, so its arrays are read in place with
higher-order functions: no explode, no shuffle.  Line items that live in a table of their own
are checked in ``line_items``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill.functions.exact import product
from foliomill.functions.values import MONEY, items, let, money, present, show_number, strip


class Check(NamedTuple):
    rule: str
    passed: Column
    good: Column | str
    bad: Column | str


# Terms that make a termination clause unusual, and the KPI ceiling.
UNUSUAL_TERMS = ("perpetual", "irrevocable", "unlimited liability", "no termination")
KPI_CEILING = 1e12

TOTAL = "decimal(38,2)"


def _text(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def as_rows(checks: list[Check]) -> Column:
    """ARRAY<STRUCT<rule, passed, detail>> of a list of checks; each is decided once."""

    def row(c: Check) -> Column:
        return let(
            c.passed,
            lambda passed: F.struct(
                F.lit(c.rule).alias("rule"),
                passed.alias("passed"),
                F.when(passed, _text(c.good)).otherwise(_text(c.bad)).alias("detail"),
            ),
        )

    return F.array(*[row(c) for c in checks])


def _filled(rule: str, value: Column, good: str, bad: str) -> Check:
    return Check(rule, present(value), good, bad)


def _some(rule: str, array: Column, what: str, bad: str, least: int = 1) -> Check:
    found = F.concat(F.lit("Found "), items(array).cast("string"), F.lit(f" {what}"))
    return Check(rule, items(array) >= least, found, bad)


def contract_checks(data: Column) -> list[Check]:
    clauses = data.getField("clauses")
    signed = F.exists(
        F.coalesce(clauses, F.array()), lambda c: F.contains(F.lower(F.coalesce(c["title"], F.lit(""))), F.lit("sign"))
    )
    ending = F.lower(F.coalesce(data.getField("terms")["termination"], F.lit("")))
    unusual = let(ending, lambda e: reduce(or_, [F.contains(e, F.lit(term)) for term in UNUSUAL_TERMS]))
    return [
        _filled(
            "effective_date_present", data.getField("effective_date"),
            "Effective date is present", "Missing effective date",
        ),
        _filled(
            "expiration_date_present", data.getField("expiration_date"),
            "Expiration date is present", "Missing expiration date",
        ),
        _some("parties_identified", data.getField("parties"), "parties", "Fewer than 2 parties identified", least=2),
        _some("clauses_present", clauses, "clauses", "No clauses extracted"),
        Check("signature_clause_present", signed, "Signature clause found", "No signature/signing clause detected"),
        Check(
            "no_unusual_terms", ~unusual,
            "Termination terms appear standard", "Unusual termination terms detected",
        ),
    ]


def never_broken(data: Column) -> Column:
    return F.lit(False)


def _number(text: Column) -> Column:
    """Missing numbers count as 0."""
    return F.when(text.isNull(), F.lit(0).cast(MONEY)).otherwise(money(text))


def _sum(a: Column, b: Column) -> Column:
    """Cents with 36 digits before the point; null beyond them."""
    return F.try_add(a, b).try_cast(TOTAL)


def _subtotal(data: Column) -> Column:
    return F.aggregate(
        F.coalesce(data.getField("line_items"), F.array()),
        F.lit(0).cast(TOTAL),
        lambda acc, item: _sum(acc, expected_total(item)),
    )


def invoice_numbers_broken(data: Column) -> Column:
    """A number that is given but cannot be read, or is too large to reckon with."""
    bad_item = F.exists(
        F.coalesce(data.getField("line_items"), F.array()),
        lambda i: _number(i["qty"]).isNull() | _number(i["unit_price"]).isNull() | _number(i["total"]).isNull(),
    )
    bad_item = bad_item | _sum(_subtotal(data), F.lit(0).cast(MONEY)).isNull()
    return bad_item | _number(data.getField("tax")).isNull() | _number(data.getField("grand_total")).isNull()


def expected_total(item: Column) -> Column:
    given = F.struct(_number(item["qty"]).alias("qty"), _number(item["unit_price"]).alias("price"))
    return let(given, lambda x: product(x["qty"], x["price"]))


def line_errors(data: Column) -> Column:
    """ARRAY<STRUCT<line, message>>: items whose total is off by more than a cent, counted from 1."""
    lines = F.transform(
        F.coalesce(data.getField("line_items"), F.array()),
        lambda item, i: F.struct(
            (i + 1).alias("line"),
            _number(item["qty"]).alias("qty"),
            _number(item["unit_price"]).alias("price"),
            _number(item["total"]).alias("total"),
        ),
    )
    names = ("line", "qty", "price", "total")
    lines = F.transform(lines, lambda x: F.struct(*[x[n].alias(n) for n in names], product(x["qty"], x["price"]).alias("expected")))
    off = F.filter(lines, lambda x: F.abs(F.try_subtract(x["expected"], x["total"])) > F.lit("0.01").cast(MONEY))
    return F.transform(
        off,
        lambda x: F.struct(
            x["line"].alias("line"),
            F.concat(
                F.lit("Line "), x["line"].cast("string"), F.lit(": "),
                show_number(x["qty"]), F.lit(" x "), show_number(x["price"]),
                F.lit(" = "), show_number(x["expected"]), F.lit(", but listed as "), show_number(x["total"]),
            ).alias("message"),
        ),
    )


def repeated_descriptions(data: Column) -> Column:
    """Descriptions that occurred earlier in the invoice, one entry per repeat."""
    names = F.transform(
        F.coalesce(data.getField("line_items"), F.array()),
        lambda i: F.lower(strip(F.coalesce(i["description"], F.lit("")))),
    )
    return let(names, lambda all_: F.filter(all_, lambda d, i: (d != "") & (F.array_position(all_, d) <= i)))


def invoice_checks(data: Column) -> list[Check]:
    errors = F.transform(line_errors(data), lambda e: e["message"])
    repeats = repeated_descriptions(data)
    subtotal = _subtotal(data)
    tax, grand = _number(data.getField("tax")), _number(data.getField("grand_total"))
    expected = F.round(F.try_add(subtotal, tax), 2)
    mismatch = F.concat(
        F.lit("Expected "), show_number(expected), F.lit(" (subtotal "), show_number(subtotal),
        F.lit(" + tax "), show_number(tax), F.lit("), got "), show_number(grand),
    )
    return [
        Check(
            "line_item_math", F.size(errors) == 0,
            "All line item calculations correct", F.array_join(errors, "; "),
        ),
        Check(
            "no_duplicate_items", F.size(repeats) == 0,
            "No duplicate items", F.concat(F.lit("Duplicate items: "), F.array_join(repeats, ", ")),
        ),
        # Strictly below one cent here, while a single line may be off by exactly one cent.
        Check(
            "grand_total_correct", F.abs(F.try_subtract(expected, grand)) < F.lit("0.01").cast(MONEY),
            "Grand total matches computed total", mismatch,
        ),
        _filled("vendor_present", data.getField("vendor"), "Vendor identified", "Missing vendor name"),
        _filled(
            "invoice_number_present", data.getField("invoice_number"),
            "Invoice number present", "Missing invoice number",
        ),
    ]


def kpi_issues(data: Column) -> Column:
    """Messages on numeric KPIs below 0 or above the ceiling; values given as text are skipped."""
    read = F.transform(
        F.coalesce(data.getField("kpis"), F.array()),
        lambda k: F.struct(
            F.coalesce(k["name"], F.lit("unknown")).alias("name"),
            F.when(
                F.regexp_like(F.schema_of_variant(k["value"]), F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")),
                F.try_variant_get(k["value"], "$", "double"),
            ).alias("number"),
            k["value"].cast("string").alias("shown"),
        ),
    )
    odd = F.filter(read, lambda k: (k["number"] < 0) | (F.abs(k["number"]) > KPI_CEILING))
    return F.transform(
        odd,
        lambda k: F.concat(
            k["name"],
            F.when(k["number"] < 0, F.lit(": negative value (")).otherwise(F.lit(": extremely large value (")),
            k["shown"],
            F.lit(")"),
        ),
    )


def report_checks(data: Column) -> list[Check]:
    issues = kpi_issues(data)
    return [
        _some("kpis_present", data.getField("kpis"), "KPIs", "No KPIs extracted"),
        Check(
            "kpi_values_in_range", F.size(issues) == 0,
            "All KPI values in expected range", F.array_join(issues, "; "),
        ),
        _filled("title_present", data.getField("title"), "Report title present", "Missing report title"),
        _filled("period_present", data.getField("period"), "Reporting period present", "Missing reporting period"),
        _some("sections_present", data.getField("sections"), "sections", "No sections extracted"),
    ]


def unsupported_checks() -> list[Check]:
    return [
        Check(
            "document_type_supported", F.lit(False), "",
            "Unknown document type — no specific validations available",
        )
    ]
