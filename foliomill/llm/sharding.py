"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded digest within their source; the k-th of a source's n rows gets the
fractional rank (k - 1/2) / n, all rows are put in the order of that rank, and the order is cut into
shards whose row counts differ by one at most.  Every stretch of the order holds the sources in the
proportion of the whole, and so does every shard.

Ranks come from range-partitioned sorts and partition offsets, not from a window: a source with a third
of all rows is spread over many tasks.  Only ids, sizes and checksums are shuffled, never texts.  Each
sorted table is written before its offsets are taken, so a recomputed task cannot move a row.

Defined cases: a null text has size 1 and the checksum of the empty string; a null source is a source of
its own; null or repeated doc_ids and fully equal rows each keep their own place; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm import common

SHARDS = 16
SEED = "shards-1"


def indexed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the place of each row, from 0, in the order of ``keys``.

    One range-partitioned sort, written; each partition's first place is the sum of the sizes before it,
    taken from one row per partition.
    """
    place = (1 << 33) - 1
    rows = common.staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # One row per partition of the sort: bounded by the number of partitions, not by the data.
    placed = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit(place))).drop("_at", "_part", "_start")


def assign(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce("text", F.lit(""))
    small = docs.select("doc_id", F.col("source").alias("_source"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    small = small.withColumn("_mix", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    ranked = common.staged(indexed(small, ["_source", "_mix", "doc_id", "text_crc32", "size"], "_place"), "ranked")
    strata = ranked.groupBy("_source").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows")).withColumnRenamed("_source", "_stratum")
    strata = common.small_side(strata, 100_000)
    joined = ranked.join(strata, F.col("_source").eqNullSafe(F.col("_stratum")))
    rank = (F.col("_place") - F.col("_first") + 0.5) / F.col("_rows")
    ordered = indexed(joined.withColumn("_rank", rank).drop("_place", "_first", "_rows", "_stratum"), ["_rank", "_source", "_mix", "doc_id", "text_crc32", "size"], "_at_all")
    total = docs.count()
    # The first `extra` shards hold one row more than the others.
    least, extra = divmod(total, shards)
    edge = extra * (least + 1)
    at = F.col("_at_all")
    shard = F.when(at < edge, F.expr(f"_at_all div {least + 1}")).otherwise(F.lit(extra) + F.expr(f"(_at_all - {edge}) div {max(least, 1)}"))
    slot = F.when(at < edge, at % (least + 1)).otherwise((at - edge) % max(least, 1))
    return ordered.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_source").alias("source"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return assign(common.documents(spark, sf_dir))
