"""Documents longer than what a model reads at once: overlapping chunks, one call each, replies merged by type.

The chunks of all documents are one table, so a very long document is spread over tasks like many short ones;
only its parsed replies, never its text, come together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chunks(docs: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """``docs`` with chunk_no (from 0), n_chunks and chunk_text instead of the text.

    A chunk has ``size`` characters and shares ``overlap`` of them with the one before.  A null or empty text is
    one empty chunk, so its document is not lost.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than a chunk")
    step = size - overlap
    length = F.length(F.coalesce(F.col(text), F.lit("")))
    n = F.greatest(F.lit(1), F.ceil((length - overlap) / step)).cast("int")
    rows = docs.withColumn("n_chunks", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    piece = F.substring(F.coalesce(F.col(text), F.lit("")), F.col("chunk_no") * step + 1, F.lit(size))
    return rows.withColumn("chunk_text", piece).drop(text)


def _empty(value: Column, kind: T.DataType) -> Column:
    """Not given: null, an empty text or a JSON null."""
    if isinstance(kind, T.StringType):
        return value.isNull() | (value == "")
    if isinstance(kind, T.VariantType):
        return value.isNull() | F.coalesce(F.to_json(value).isin("null", '""'), F.lit(True))
    return value.isNull()


def _merged(parts: Column, kind: T.DataType) -> Column:
    """One value of this type from the chunks' values in order."""
    if isinstance(kind, T.ArrayType):
        lists = F.flatten(F.transform(parts, lambda p: F.coalesce(p, F.array().cast(kind))))
        return lists if _has_variant(kind) else F.array_distinct(lists)
    if isinstance(kind, T.StructType):
        given = F.filter(parts, lambda p: p.isNotNull())
        inner = [_merged(_field(given, f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(F.size(given) > 0, F.struct(*inner))
    return F.get(F.filter(parts, lambda p: ~_empty(p, kind)), F.lit(0))


def _field(parts: Column, name: str) -> Column:
    return F.transform(parts, lambda p: p[name])


def _has_variant(kind: T.DataType) -> bool:
    """Variants cannot be compared, so lists that hold them keep repeated elements."""
    if isinstance(kind, T.ArrayType):
        return _has_variant(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_variant(f.dataType) for f in kind.fields)
    return isinstance(kind, T.VariantType)


def merge(parsed: DataFrame, by: list[str], data: str = "data", chunk: str = "chunk_no") -> DataFrame:
    """One reply per document from the parsed replies of its chunks: (by, data, n_chunks, n_unreadable).

    Lists are joined in chunk order without repeats, of single values the first one given counts, and structs are merged
    field by field.  A chunk whose reply could not be read (null) adds nothing.
    """
    kind = parsed.schema[data].dataType
    parts = F.collect_list(F.struct(F.col(chunk).alias("no"), F.col(data).alias("data")))
    rows = parsed.groupBy(*by).agg(parts.alias("_parts"))
    # Chunk numbers are unique within a document; the data need not be comparable.
    in_order = F.array_sort("_parts", lambda a, b: F.when(a["no"] < b["no"], -1).when(a["no"] > b["no"], 1).otherwise(0))
    rows = rows.withColumn("_data", F.transform(in_order, lambda p: p["data"]))
    unread = F.size(F.filter("_data", lambda d: d.isNull()))
    return rows.select(*by, _merged(F.col("_data"), kind).alias(data), F.size("_data").alias("n_chunks"), unread.alias("n_unreadable"))
