"""Document types: the reply schema, the checks and the requested fields of each type.

A new type is one more ``DocType`` in a ``Registry``; no stage changes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

from foliomill.operators import checks as C

UNKNOWN = "unknown"


@dataclass(frozen=True)
class DocType:
    name: str
    schema: str  # DDL of the extraction reply
    checks: Callable[[Column], list[C.Check]]  # business rules over the parsed reply
    broken: Callable[[Column], Column]  # true where a number of the reply cannot be read
    not_null: tuple[str, ...] = ()  # paths whose explicit JSON null makes the checks fail
    shape: str = ""  # JSON shape shown to the model
    expert: str = ""  # role named in the analysis prompt
    requested: tuple[str, ...] = ()  # field list of profile G
    required: tuple[str, ...] = ()  # fields profile G insists on
    findings: str = "risks"  # list the analysis of this type fills

    @property
    def route(self) -> str:
        return f"extract_{self.name}"


@dataclass(frozen=True)
class Registry:
    types: tuple[DocType, ...]
    fallback: str = "contract"  # type whose schema serves unknown documents in profile N
    generic_fields: tuple[str, ...] = ("summary", "key_points", "dates", "amounts")
    extra: dict = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [t.name for t in self.types]

    def get(self, name: str) -> DocType:
        return next(t for t in self.types if t.name == name)

    def with_type(self, new: DocType) -> Registry:
        return Registry((*self.types, new), self.fallback, self.generic_fields, self.extra)


# Names of the JSON fields and of the requested and required fields per type.
CONTRACT = DocType(
    name="contract",
    schema=(
        "parties ARRAY<STRING>, effective_date VARIANT, expiration_date VARIANT, "
        "clauses ARRAY<STRUCT<title: STRING, text: STRING>>, "
        "obligations ARRAY<STRUCT<party: STRING, obligation: STRING>>, "
        "terms STRUCT<duration: STRING, renewal: STRING, termination: STRING>"
    ),
    checks=C.contract_checks,
    broken=C.never_broken,
    not_null=("parties", "clauses", "clauses[].title", "terms", "terms.termination"),
    shape=(
        '{"parties": [..], "effective_date": "YYYY-MM-DD or null", "expiration_date": "YYYY-MM-DD or null", '
        '"clauses": [{"title", "text"}], "obligations": [{"party", "obligation"}], '
        '"terms": {"duration", "renewal", "termination"}}'
    ),
    expert="legal contract",
    requested=("parties", "effective_date", "termination_date", "governing_law", "payment_terms", "obligations"),
    required=("parties", "effective_date"),
    findings="risks",
)
INVOICE = DocType(
    name="invoice",
    schema=(
        "vendor VARIANT, invoice_number VARIANT, invoice_date STRING, due_date STRING, "
        "line_items ARRAY<STRUCT<description: STRING, qty: STRING, unit_price: STRING, total: STRING>>, "
        "tax STRING, grand_total STRING"
    ),
    checks=C.invoice_checks,
    broken=C.invoice_numbers_broken,
    not_null=(
        "line_items", "line_items[].description", "line_items[].qty", "line_items[].unit_price", "line_items[].total",
        "tax", "grand_total",
    ),
    shape=(
        '{"vendor", "invoice_number", "invoice_date": "YYYY-MM-DD or null", "due_date": "YYYY-MM-DD or null", '
        '"line_items": [{"description", "qty", "unit_price", "total"}], "tax": number, "grand_total": number}'
    ),
    expert="invoice audit",
    requested=(
        "invoice_number", "date", "due_date", "vendor", "customer", "line_items", "subtotal", "tax", "total",
    ),
    required=("invoice_number", "total"),
    findings="anomalies",
)
REPORT = DocType(
    name="report",
    schema=(
        "title VARIANT, period VARIANT, kpis ARRAY<STRUCT<name: STRING, value: VARIANT, unit: STRING>>, "
        "sections ARRAY<STRUCT<heading: STRING, summary: STRING>>"
    ),
    checks=C.report_checks,
    broken=C.never_broken,
    not_null=("kpis", "sections"),
    shape='{"title", "period", "kpis": [{"name", "value", "unit"}], "sections": [{"heading", "summary"}]}',
    expert="business report",
    requested=("title", "author", "date", "executive_summary", "key_findings", "recommendations"),
    required=("title", "key_findings"),
    findings="insights",
)

DEFAULT = Registry((CONTRACT, INVOICE, REPORT))
