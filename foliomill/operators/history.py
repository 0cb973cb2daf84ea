"""Ordered look-back inside groups of any size, by range partitioning.

Rows are dealt into sorted ranges of (keys, time, ties), so neither a group with a third of all rows nor a burst
of equal times gathers in one task.  Each range looks back inside itself, batch by batch; its first
and its last row mark the border.  The sorted rows are written once; the borders, two rows per
range, are folded into what each range takes over from the ranges before it.

The table is read twice (once to find the bounds of the ranges), shuffled once and written once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.session import shared_folder


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where the values are equal; a null equals a null, and NaN equals NaN."""
    both_null = pc.and_(pc.is_null(a, nan_is_null=True), pc.is_null(b, nan_is_null=True))
    return pc.or_(both_null, pc.fill_null(pc.equal(a, b), False)).to_numpy(zero_copy_only=False)


class _Range:
    """Looks back through the batches of one sorted range."""

    def __init__(self, keys: list[str], previous: dict[str, str], hits: list[str]):
        self.keys, self.previous, self.hits = keys, previous, hits
        self.last: pa.RecordBatch | None = None  # the row before this batch
        self.met = dict.fromkeys(hits, False)  # in the group of that row
        self.open = True  # still in the first group

    def add(self, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        n = batch.num_rows
        joined = pa.Table.from_batches([self.last or batch.slice(0, 1), batch]).combine_chunks()
        before, rows = joined.slice(0, n), joined.slice(1, n)
        same = np.ones(n, bool)
        for key in self.keys:
            same &= _same(rows.column(key).combine_chunks(), before.column(key).combine_chunks())
        same[0] &= self.last is not None
        starts = ~same
        out = {}
        for new, name in self.previous.items():
            out[new] = pc.if_else(pa.array(same), before.column(name).combine_chunks(), pa.scalar(None, before.schema.field(name).type))
        begin = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        carried = np.cumsum(starts) == 0
        for name in self.hits:
            hit = batch.column(name).to_numpy(zero_copy_only=False)
            earlier = np.cumsum(hit) - hit
            seen = (earlier > earlier[begin]) | (carried & self.met[name])
            self.met[name] = bool(seen[-1] or hit[-1])
            out[name] = pa.array(seen)
        first = np.cumsum(starts) <= (self.last is None)
        out["_open"] = pa.array(first & self.open)
        self.open = bool(first[-1]) and self.open
        self.last = batch.slice(n - 1, 1)
        return out


def _look(columns: list[str], keys: list[str], previous: dict[str, str], hits: list[str], names: list[str]):
    """Each row with what its range knows of the rows before it, and the marks of the borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        here = _Range(keys, previous, hits)
        held: dict[str, pa.Array] | None = None

        def out(found: dict[str, pa.Array], last: bool) -> pa.RecordBatch:
            n = len(found["_open"])
            tail = np.zeros(n, bool)
            tail[-1] = last
            return pa.record_batch([*(found[c] for c in names if c != "_tail"), pa.array(tail)], names=[*(c for c in names if c != "_tail"), "_tail"])

        for batch in batches:
            if not batch.num_rows:
                continue
            head = np.zeros(batch.num_rows, bool)
            head[0] = held is None
            met = {f"_met_{h}": batch.column(h) for h in hits}
            found = {c: batch.column(c) for c in columns} | here.add(batch)
            # Whether the condition was met in the group up to and with this row.
            found |= {m: pc.or_(v, found[m.removeprefix("_met_")]) for m, v in met.items()}
            found |= {"_part": pa.array(np.full(batch.num_rows, part, np.int32)), "_head": pa.array(head)}
            if held is not None:
                yield out(held, False)
            held = found
        if held is not None:
            yield out(held, True)

    return run


def look_back(
    df: DataFrame,
    keys: list[str],
    at: str,
    ties: list[str],
    previous: dict[str, str] | None = None,
    seen: dict[str, Column] | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Add columns that look at earlier rows of the group, ordered by ``at`` and ``ties``.

    ``previous`` maps a new column to the column whose value on the row before it takes (null on
    the first row).  ``seen`` maps a new column to a condition: true when an earlier row of the
    group met it.  Rows whose keys are null form a group.  The sorted rows are written to ``folder``,
    a new folder every executor can reach (by default below ``spark.checkpoint.dir``).
    """
    previous, seen = previous or {}, seen or {}
    columns, hits = df.columns, list(seen)
    taken = {c.lower() for c in columns}
    if clash := sorted(c for c in [*previous, *hits] if c.lower() in taken):
        raise ValueError(f"columns exist already: {clash}")
    order = [*keys, at, *ties]
    rows = df.withColumns({new: F.coalesce(cond, F.lit(False)) for new, cond in seen.items()})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    fields = [*df.schema.fields, *(T.StructField(new, df.schema[c].dataType) for new, c in previous.items())]
    fields += [T.StructField(c, T.BooleanType()) for c in [*hits, *(f"_met_{h}" for h in hits), "_open", "_head"]]
    fields = [T.StructField(f.name, f.dataType) for f in fields] + [T.StructField("_part", T.IntegerType()), T.StructField("_tail", T.BooleanType())]
    schema = T.StructType(fields)
    path = folder or shared_folder(df.sparkSession, "look-back")
    rows.mapInArrow(_look(columns, keys, previous, hits, schema.names), schema).write.parquet(path)
    done = df.sparkSession.read.schema(schema).parquet(path)

    # Two rows per range: where it begins, and what it leaves to the ranges after it.
    left = F.struct(*[F.col(c).alias(new) for new, c in previous.items()], F.lit(True).alias("_given"))
    ends = done.filter("_tail").select(*keys, "_part", F.lit(1).alias("_side"), left.alias("_row"), *[F.col(f"_met_{h}").alias(f"_any_{h}") for h in hits])
    begins = done.filter("_head").select(*keys, "_part", F.lit(0).alias("_side"))
    by_group = Window.partitionBy(*keys).orderBy("_part", "_side").rowsBetween(Window.unboundedPreceding, -1)
    folded = begins.unionByName(ends, allowMissingColumns=True).select(
        "_part", "_side", F.last("_row", ignorenulls=True).over(by_group).alias("_carry"), *[F.bool_or(f"_any_{h}").over(by_group).alias(f"_any_{h}") for h in hits]
    )
    carry = folded.filter("_side = 0").select("_part", "_carry", *[f"_any_{h}" for h in hits])
    out = done.join(F.broadcast(carry), "_part", "left")  # one row per range
    return out.select(
        *columns,
        *[F.when(F.col("_head"), F.col("_carry").getField(new)).otherwise(F.col(new)).alias(new) for new in previous],
        *[(F.col(h) | (F.col("_open") & F.coalesce(f"_any_{h}", F.lit(False)))).alias(h) for h in hits],
    )
