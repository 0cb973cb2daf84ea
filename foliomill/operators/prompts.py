"""Prompt columns for the three model calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill.doctypes import DEFAULT, DocType, Registry
from foliomill.functions.text import window

# Windows per profile for a caller who wants a cut (``chars``); without one the whole text is sent.
CLASSIFY_CHARS = {"G": 4000, "N": 8000}
EXTRACT_CHARS = {"G": 6000, "N": 8000}
ANALYZE_CHARS = {"G": 4000, "N": 6000}


def _shown(text: Column, chars: int | None) -> Column:
    return text if chars is None else window(text, chars)

_ANALYSIS_SHAPE = {
    "risks": '"risks": [{"risk", "severity": "high|medium|low", "clause"}]',
    "anomalies": '"anomalies": [{"type", "detail", "severity": "high|medium|low"}]',
    "insights": '"insights": [{"insight", "metric", "recommendation"}]',
}


def classify_prompt(text: Column, registry: Registry = DEFAULT, chars: int | None = None) -> Column:
    names = ", ".join(registry.names)
    ask = f'Which type is this document: {names}? Answer with JSON {{"type", "confidence"}} only.\n\n'
    return F.concat(F.lit(ask), _shown(text, chars))


def _extract_ask(kind: DocType | None, profile: str, registry: Registry) -> str:
    if profile == "G":
        fields = kind.requested if kind else registry.generic_fields
        return f"Answer with one JSON object with the keys {', '.join(fields)}; null where not found.\n\n"
    kind = kind or registry.get(registry.fallback)
    return f"Extract from this {kind.name} as JSON only: {kind.shape}\n\n"


def extract_prompt(
    text: Column, doc_type: Column, profile: str = "N", registry: Registry = DEFAULT, chars: int | None = None
) -> Column:
    ask = F.lit(_extract_ask(None, profile, registry))
    for kind in registry.types:
        ask = F.when(doc_type == kind.name, _extract_ask(kind, profile, registry)).otherwise(ask)
    return F.concat(ask, _shown(text, chars))


def _analyze_ask(kind: DocType, profile: str, label: str) -> str:
    if profile == "G":
        return (
            f"As an expert on {label} documents list risks, anomalies and insights. JSON only: "
            '{"risks": [..], "anomalies": [..], "insights": [..], "summary"}\n\n'
        )
    return (
        f"As a {kind.expert} expert answer with JSON only: "
        f'{{{_ANALYSIS_SHAPE[kind.findings]}, "analysis": {{..}}, "summary"}}\n\n'
    )


def analyze_prompt(
    text: Column,
    doc_type: Column,
    data_json: Column,
    issues_json: Column,
    profile: str = "N",
    registry: Registry = DEFAULT,
    chars: int | None = None,
) -> Column:
    """Profile N also shows the validation issues."""
    ask = F.lit(_analyze_ask(registry.get(registry.fallback), profile, "unknown"))
    for kind in registry.types:
        ask = F.when(doc_type == kind.name, _analyze_ask(kind, profile, kind.name)).otherwise(ask)
    parts = [ask, _shown(text, chars), F.lit("\n\nExtracted data:\n"), F.coalesce(data_json, F.lit("{}"))]
    if profile == "N":
        parts += [F.lit("\n\nValidation issues:\n"), F.coalesce(issues_json, F.lit("[]"))]
    return F.concat(*parts)
