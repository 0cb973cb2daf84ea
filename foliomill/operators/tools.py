"""User tools: functions over the text column, added to a table without a change of the stages.

A tool is a function from a text column to a result column; where columns cannot say it, it wraps a
pandas UDF.  A tool gets the empty text for a null one, so it never has to look for nulls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tool = Callable[[Column], Column]


def apply(df: DataFrame, tools: dict[str, Tool], text: str = "document_text") -> DataFrame:
    """One more column per tool, named after it."""
    taken = {c.lower() for c in df.columns}
    if clash := sorted(name for name in tools if name.lower() in taken):
        raise ValueError(f"columns exist already: {clash}")
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({name: tool(whole) for name, tool in tools.items()})
