"""Text extraction on whole texts, all in built-in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill.functions.values import SPACE, strip

# The date and money notations, in the order in which hits are listed.
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
DATE_NOTATIONS = (
    r"(?U)\b\d{4}-\d{2}-\d{2}\b",
    r"(?U)\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"(?U)\b\d{1,2}-\d{1,2}-\d{2,4}\b",
    rf"(?iuU)\b\d{{1,2}}\s+{_MONTH}\s+\d{{4}}\b",
    rf"(?iuU)\b{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b",
)
_CURRENCY = "(?:USD|EUR|GBP|CAD|AUD)"
# The suffix form starts only at the head of a run of digits and never gives digits back:
# it finds the same hits, and a long run of digits without a currency costs linear time.
AMOUNT_NOTATIONS = (
    r"(?U)[$£€]\s*[\d,]+\.?\d*",
    rf"(?iuU)\b{_CURRENCY}\s*[\d,]+\.?\d*",
    rf"(?iuU)(?<![\d,])[\d,]++\.?+\d*+\s*+{_CURRENCY}\b",
)

TOKEN = "[a-z0-9]+"
PARAGRAPH_BREAK = rf"(?U)\n{SPACE}*\n"


def _find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def window(text: Column, chars: int) -> Column:
    """First ``chars`` characters: the part of a text one model call reads."""
    return F.substring(text, 1, chars)


def extract_dates(text: Column) -> Column:
    """Distinct date strings, by notation first and by position second."""
    text = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.concat(*[_find_all(text, p) for p in DATE_NOTATIONS]))


def extract_amounts(text: Column) -> Column:
    """Distinct positive amounts as doubles, by notation first and by position second."""
    text = F.coalesce(text, F.lit(""))
    raw = F.concat(*[_find_all(text, p) for p in AMOUNT_NOTATIONS])
    values = F.transform(raw, lambda r: F.regexp_replace(r, r"(?U)[^\d.]", "").try_cast("double"))
    return F.array_distinct(F.filter(values, lambda v: v > 0))


def paragraphs(text: Column, separator: str = PARAGRAPH_BREAK) -> Column:
    """Stripped, non-empty paragraphs in text order."""
    parts = F.transform(F.split(strip(F.coalesce(text, F.lit(""))), separator), strip)
    return F.filter(parts, lambda p: p != "")


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return _find_all(F.lower(F.coalesce(text, F.lit(""))), TOKEN)
