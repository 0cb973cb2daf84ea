"""Documents as text files or as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """One row per file: (source, document_text)."""
    df = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return df.select(F.input_file_name().alias("source"), F.col("value").alias("document_text"))


def read_table(spark: SparkSession, path: str, text: str = "text", key: str | None = None) -> DataFrame:
    """Documents of a parquet table with the text column renamed; ``key`` keeps the source's key."""
    df = spark.read.parquet(path)
    return df.select(*([F.col(key).alias("source_key")] if key else []), F.col(text).alias("document_text"))


# Rows a task should hold where each row costs a lot of work but few bytes.
ROWS_A_TASK = 50_000


def spread_rows(df: DataFrame, rows: int = ROWS_A_TASK) -> DataFrame:
    """Deal a table of small rows evenly, so that a task's work stays bounded however large the table is.

    Splits by bytes do not do that: a few megabytes of keys become many documents, and splits of one row group leave
    all of it to one task.  The count reads no column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)))


def spread(df: DataFrame) -> DataFrame:
    """Give heavy per-row work at least one partition per core.

    A small or unsplittable file would otherwise be worked off by a few tasks.  A table that is
    already cut into enough partitions, as any large one is, is left alone: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
