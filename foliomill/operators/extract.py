"""Typed extraction from model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.doctypes import DEFAULT, DocType, Registry
from foliomill.functions.replies import has_null, parse, readable, single_json, unfence
from foliomill.functions.values import computed, let
from foliomill.functions.text import extract_amounts, extract_dates
from foliomill.operators.classify import UNREADABLE
from foliomill.operators.errors import STAGE, append_error, call_error, failed_status


def route(doc_type: Column, registry: Registry = DEFAULT) -> Column:
    """Extraction route of a type; types without one take the fallback's."""
    routes = F.create_map(*[F.lit(x) for t in registry.types for x in (t.name, t.route)])
    return F.coalesce(F.try_element_at(routes, doc_type), F.lit(registry.get(registry.fallback).route))


def extract_type(df: DataFrame, kind: DocType, reply: str = "extract_reply") -> DataFrame:
    """Parse replies known to be of one type into column ``data`` (null when not ``readable``).

    ``unusable`` marks data whose checks cannot run.
    """
    df = df.withColumn("_text", unfence(F.col(reply)))
    df = df.withColumn("_parsed", parse(F.col("_text"), kind.schema))
    ok = F.coalesce(readable(F.col("_text"), F.col("_parsed")), F.lit(False))
    df = df.withColumns({"readable": ok, "data": F.when(ok, F.col("_parsed").dropFields("_corrupt"))}).drop("_parsed")
    df = df.withColumn("unusable", unusable(kind, F.col("_text"), F.col("data"))).drop("_text")
    return computed(df, "readable", "unusable", "data")


def unusable(kind: DocType, text: Column, data: Column) -> Column:
    """True where the checks of the type cannot run: explicit nulls or unreadable numbers."""
    return F.when(data.isNotNull(), has_null(text, kind.not_null) | kind.broken(data)).otherwise(False)


def extract(df: DataFrame, reply: str = "extract_reply", registry: Registry = DEFAULT) -> DataFrame:
    """Profile N: one parsed struct column per type, filled for the rows routed to that type.

    One pass over the replies: they may be model output, which three filtered branches would
    compute three times.
    """
    df = df.withColumns({"_text": unfence(F.col(reply)), "_route": route(F.col("document_type"), registry)})
    error = call_error(df, reply)
    for kind in registry.types:
        df = df.withColumn(f"_raw_{kind.name}", F.when(F.col("_route") == kind.route, parse(F.col("_text"), kind.schema)))
    ok, broken = F.lit(False), F.lit(False)
    for kind in registry.types:
        raw = F.col(f"_raw_{kind.name}")
        mine = F.col("_route") == kind.route
        ok = F.when(mine, readable(F.col("_text"), raw)).otherwise(ok)
        # An unknown document keeps the fallback's data, but the fallback's checks never run on it.
        broken = F.when(F.col("document_type") == kind.name, unusable(kind, F.col("_text"), raw)).otherwise(broken)
    df = df.withColumn("_ok", F.coalesce(ok, F.lit(False)) & error.isNull())
    df = df.withColumn("unusable", F.col("_ok") & broken)
    for kind in registry.types:
        data = F.col(f"_raw_{kind.name}").dropFields("_corrupt")
        df = df.withColumn(kind.name, F.when(F.col("_ok"), data))
    message = F.coalesce(error, F.when(~F.col("_ok"), UNREADABLE))
    df = df.withColumn("_message", message)
    df = append_error(df, F.col("_route"), F.col("_message"))
    df = df.withColumn("status", failed_status("N", "extracting", F.col("_message")))
    return df.drop("_text", "_route", "_ok", "_message", *[f"_raw_{t.name}" for t in registry.types])


def _requested_of(names: tuple[str, ...], found: Column) -> Column:
    """MAP of exactly the named keys to JSON texts, null when missing or JSON null."""
    fields = F.array(*[F.lit(n) for n in names])
    # Bound first: inside the loop the reply would be parsed once for each name.
    values = let(found, lambda given: F.transform(fields, lambda f: F.nullif(F.to_json(F.try_element_at(given, f)), F.lit("null"))))
    return F.map_from_arrays(fields, values)


def requested_fields(text: Column, doc_type: Column, registry: Registry = DEFAULT) -> Column:
    """Profile G: the type's field list, projected from any JSON object."""
    found = F.from_json(text, "MAP<STRING, VARIANT>", {"allowSingleQuotes": "false"})
    out = _requested_of(registry.generic_fields, found)
    for kind in registry.types:
        out = F.when(doc_type == kind.name, _requested_of(kind.requested, found)).otherwise(out)
    return F.when(single_json(text), out)


def extract_requested(
    df: DataFrame, reply: str = "extract_reply", text: str = "document_text", registry: Registry = DEFAULT
) -> DataFrame:
    """Profile G: column ``fields`` plus the dates and amounts of the whole text."""
    df = df.withColumn("_text", unfence(F.col(reply)))
    df = df.withColumn("_fields", requested_fields(F.col("_text"), F.col("document_type"), registry))
    # A later explode of the fields brings a filter on them; it must not repeat the parsing below.
    df = computed(df, "_fields")
    message = F.coalesce(call_error(df, reply), F.when(F.col("_fields").isNull(), UNREADABLE))
    df = df.withColumn("_message", message)
    bad = F.col("_message").isNotNull()
    df = df.withColumns(
        {
            "fields": F.col("_fields"),
            "extracted_dates": F.when(~bad, extract_dates(F.col(text))),
            "extracted_amounts": F.when(~bad, extract_amounts(F.col(text))),
            "status": failed_status("G", "extracting", F.col("_message")),
        }
    )
    return append_error(df, STAGE["G"]["extract"], F.col("_message")).drop("_text", "_fields", "_message")


def extract_fields(df: DataFrame, names: tuple[str, ...], reply: str = "reply") -> DataFrame:
    """Named fields of a reply as column ``fields``; every field null when it cannot be parsed.

    Only the inside of a code fence counts here.
    """
    text = unfence(F.col(reply), strict=False)
    found = F.from_json(text, "MAP<STRING, VARIANT>", {"allowSingleQuotes": "false"})
    found = F.when(single_json(text), found)
    return computed(df.withColumn("fields", _requested_of(names, found)), "fields")


def extract_table(df: DataFrame, columns: tuple[str, ...], reply: str = "reply", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a JSON array of objects: one output row per object, only the wanted columns.

    A reply that is no array gives no rows; elements that are no objects are dropped.
    """
    text = unfence(F.col(reply), strict=False)
    df = df.withColumn("_v", F.when(single_json(text, "["), F.try_parse_json(text)))
    rows = df.select(*keep, "_v").filter(F.startswith(F.schema_of_variant("_v"), F.lit("ARRAY")))
    rows = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    rows = rows.filter(F.startswith(F.schema_of_variant("value"), F.lit("OBJECT")))
    picked = [F.try_variant_get("value", f"$.{c}", "string").alias(c) for c in columns]
    return rows.select(*keep, F.col("pos").cast("int").alias("row_no"), *picked)
