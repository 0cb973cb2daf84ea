"""Reading model replies: fences, JSON, typed fields."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill.functions.values import let, strip

JSON_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"}


def unfence(reply: Column, strict: bool = True) -> Column:
    """JSON text of a reply that may sit in a Markdown code fence.

    ``strict`` keeps text around the fence (which then is no JSON); otherwise only the inside of
    the first fence counts.
    """
    if strict:
        inside = F.regexp_replace(reply, r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```", "$1")
        return strip(F.when(F.contains(reply, F.lit("```")), inside).otherwise(reply))
    fence = r"(?s)```(?:json)?\s*(.*?)```"
    return strip(F.when(F.regexp_like(reply, F.lit(fence)), F.regexp_extract(reply, fence, 1)).otherwise(reply))


def single_json(text: Column, opener: str = "{") -> Column:
    """True when the text holds exactly one JSON value that starts with ``opener``.

    The JSON readers stop after the first value, so the text is counted inside an array:
    anything behind the value breaks the array or makes it longer.
    """
    one = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.coalesce(F.startswith(text, F.lit(opener)) & one, F.lit(False))


def parse(text: Column, schema: str) -> Column:
    """Struct of the wanted fields, null where the text is no JSON object of that shape."""
    return F.from_json(text, f"{schema}, _corrupt STRING", JSON_OPTIONS)


def readable(text: Column, parsed: Column) -> Column:
    return single_json(text) & parsed.isNotNull() & parsed.getField("_corrupt").isNull()


def _null_at(tree: Column, path: str) -> Column:
    outer, _, inner = path.partition("[].")
    if not inner:
        return F.is_variant_null(F.try_variant_get(tree, f"$.{path}", "variant"))
    elements = F.coalesce(F.try_variant_get(tree, f"$.{outer}", "array<variant>"), F.array().cast("array<variant>"))
    return F.exists(elements, lambda e: F.coalesce(_null_at(e, inner), F.lit(False)))


def has_null(text: Column, paths: tuple[str, ...]) -> Column:
    """True when one of the paths is given as JSON null (which differs from a missing key).

    ``a``, ``a.b`` and ``a[].b`` (in any element of the list ``a``); the same names elsewhere do not count.
    """
    given = lambda tree: reduce(or_, (F.coalesce(_null_at(tree, path), F.lit(False)) for path in paths), F.lit(False))
    # A JSON null is written in one way only; most replies hold none and need no second parsing.
    return F.when(F.contains(text, F.lit("null")), let(F.try_parse_json(text), given)).otherwise(False)
