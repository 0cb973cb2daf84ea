"""Helpers the operators share: the shared folder, text expressions, size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Separators of "letter and digit" words: every ASCII character but 0-9 and a-z (after lower-casing).
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Rows of a reader's batch, rows and bytes of an Arrow batch, for tasks that hold few whole texts at once.
SMALL_BATCHES = {
    "spark.sql.parquet.columnarReaderBatchSize": 512,
    "spark.sql.execution.arrow.maxRecordsPerBatch": 1_000,
    "spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20,
}


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder path below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing, only a local session falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def at_most(spark: SparkSession, name: str, most: int) -> str:
    """Lowers a setting of the session to ``most`` if it is higher or unbounded (0 or less); returns the value before."""
    before = spark.conf.get(name)
    bytes_in = {"b": 0, "k": 10, "m": 20, "g": 30, "t": 40}
    number, unit = re.fullmatch(r"(-?\d+)([a-z]?)b?", before.strip().lower()).groups()
    value = int(number) << bytes_in[unit or "b"]
    if not 0 < value <= most:
        spark.conf.set(name, str(most))
    return before


def small_batches(spark: SparkSession) -> None:
    """``SMALL_BATCHES`` from now on in the session; smaller values of the session hold."""
    for name, most in SMALL_BATCHES.items():
        at_most(spark, name, most)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; the fast path serves texts of ASCII only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows (narrow rows), else as it is.

    Beyond the bound Spark joins by shuffle; the rows of the result are the same.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(low: Column) -> tuple[Column, Column]:
    """For a column of lower-case text: what to put into a first projection, and the words from it (``_parts``)."""
    parts = F.col("_parts")
    lead = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
    trail = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.split(low, NON_WORD).alias("_parts"), F.slice(parts, lead + 1, F.size(parts) - lead - trail)
