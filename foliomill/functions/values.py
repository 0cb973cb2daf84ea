"""Small value helpers: truthiness, stripping, exact money, time differences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as the text rules understand it: Unicode spaces and the four separator controls.
SPACE = r"[\s\x1c-\x1f]"
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# Ten decimals and eighteen digits before them; products of two such numbers keep six decimals.
MONEY = "decimal(28,10)"
EXACT = "decimal(38,10)"


def computed(df: DataFrame, *names: str) -> DataFrame:
    """Fix columns as computed here.

    A filter on the result of a long chain of expressions would be pushed through all of it and
    so repeat the whole chain.  Filters are not pushed through a generator's output.
    """
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind a value that ``use`` needs several times, so that it is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends (``trim`` only removes blanks)."""
    return F.btrim(text, F.lit(SPACES))


def present(value: Column) -> Column:
    """True for a JSON value (VARIANT) that is given and not empty: no null, "", [], {}, false or 0."""
    return F.coalesce(~F.rlike(F.to_json(value), F.lit(r'^(null|""|\[\]|\{\}|false|-?0(\.0*)?([eE][-+]?\d+)?)$')), F.lit(False))


def items(array: Column) -> Column:
    """Number of elements, 0 for null."""
    return F.coalesce(F.size(array), F.lit(0))


def money(text: Column) -> Column:
    """Exact decimal of a number given as text; null when it is no number.

    Goes through double first because replies may write 1.5E3.
    """
    direct = text.try_cast(MONEY)
    return F.coalesce(direct, text.try_cast("double").try_cast(MONEY))


def show_number(value: Column) -> Column:
    """Decimal as shortest text with at least one digit after the point: 2.0, 3.25."""
    return F.regexp_replace(value.cast("string"), r"(\.\d+?)0+$", "$1")


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def within(actual: Column, expected: Column, tolerance: str = "0.01") -> Column:
    """|actual - expected| <= tolerance, inclusive, on exact decimals; null for a number that is none."""
    gap = F.abs(F.try_subtract(actual.try_cast(EXACT), expected.try_cast(EXACT)))
    return gap <= F.lit(tolerance).cast(EXACT)


def percentage_change(old: Column, new: Column) -> Column:
    """(new - old) / |old| * 100; null when old is 0 (callers flag that as an error)."""
    return F.try_divide(new - old, F.abs(old)) * F.lit(100.0)


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without time zone."""
    col = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        seconds = F.hour(col) * 3600 + F.minute(col) * 60
        fraction = (F.extract(F.lit("SECOND"), col) * 1000000).cast("bigint")
        return F.unix_date(F.to_date(col)).cast("bigint") * 86400000000 + seconds.cast("bigint") * 1000000 + fraction
    return F.unix_micros(col)


def elapsed_ms(start_micros: Column, end_micros: Column) -> Column:
    return (end_micros - start_micros) / F.lit(1000.0)
