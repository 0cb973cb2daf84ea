"""Versioned job state: append-only tables instead of overwritten keys.

``versions`` holds (job_id, version, state): the highest version is the current state.
``snapshots`` holds (job_id, snapshot_id, created_at, version, state).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, run: str) -> None:
    """Append rows as one run.  A repeated run replaces its own folder, so a retry adds nothing."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run}")


def latest(versions: DataFrame) -> DataFrame:
    """Current state of each job.  Each task reduces its rows to one per job before the shuffle."""
    newest = F.max_by(F.struct("version", "state"), "version").alias("_v")
    return versions.groupBy("job_id").agg(newest).select("job_id", "_v.version", "_v.state")


def create_table(versions: DataFrame, table: str, folder: str, buckets: int) -> DataFrame:
    """``versions`` as a table kept in ``folder``, dealt and sorted by job once and for all.

    Loads, snapshots and rollbacks on it move the requests to the versions and leave those where they are.  The number
    of buckets is the number of tasks that later work on the table; ``extend`` adds rows in the same buckets.
    """
    writer = versions.repartition(buckets, "job_id").write.bucketBy(buckets, "job_id").sortBy("job_id")
    writer.option("path", folder).mode("errorifexists").saveAsTable(table)
    return versions.sparkSession.table(table)


def extend(versions: DataFrame, table: str, buckets: int) -> DataFrame:
    """New versions added to a table made by ``create_table``."""
    spark = versions.sparkSession
    rows = versions.select(spark.table(table).columns).repartition(buckets, "job_id")
    rows.write.bucketBy(buckets, "job_id").sortBy("job_id").mode("append").saveAsTable(table)
    return spark.table(table)


def load(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """State of the requested jobs, null where there is none.  Versions of other jobs go before they are compared."""
    asked = requests.select("job_id").distinct()
    return asked.join(latest(versions.join(asked, "job_id", "left_semi")), "job_id", "left")


def snapshot_id(*parts: Column) -> Column:
    """Twelve hex digits of what identifies a snapshot, the same again when a task is retried."""
    return F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 12)


def snapshot(requests: DataFrame, versions: DataFrame, created_at: Column) -> tuple[DataFrame, DataFrame]:
    """(snapshots, jobs without state) for the requested jobs.

    Snapshots of one state taken at different times have different ids.
    """
    current = load(requests, versions)
    taken = current.filter("version IS NOT NULL").select(
        "job_id",
        snapshot_id(F.col("job_id"), F.col("version"), created_at).alias("snapshot_id"),
        created_at.alias("created_at"),
        "version",
        "state",
    )
    missing = current.filter("version IS NULL").select(
        "job_id", F.concat(F.lit("No state found for job "), F.col("job_id").cast("string")).alias("error")
    )
    return taken, missing


def rollback(requests: DataFrame, snapshots: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(restored states as new versions above the current ones, requests whose snapshot does not exist).

    ``requests`` holds (job_id, snapshot_id, turn): turns count from 1 and are unique within a job, so of several
    requests for one job the last one holds.  A snapshot that is listed twice restores once.
    """
    on = ["job_id", "snapshot_id"]
    wanted = requests.select(*on, F.col("turn").cast("bigint").alias("turn")).distinct()
    jobs = wanted.select("job_id").distinct()
    current = versions.join(jobs, "job_id", "left_semi").groupBy("job_id").agg(F.max("version").alias("_current"))
    listed = snapshots.join(jobs, "job_id", "left_semi").groupBy(*on).agg(F.any_value("state").alias("state"))
    found = listed.join(wanted, on).join(current, "job_id", "left")
    restored = found.select(*on, "state", (F.coalesce("_current", F.lit(0)) + F.col("turn")).alias("version"))
    return restored, wanted.select(*on).distinct().join(snapshots, on, "left_anti")


def list_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots in time order within each job: a range sort, so a job with very many is split too."""
    return snapshots.select("job_id", "snapshot_id", "created_at").orderBy("job_id", "created_at", "snapshot_id")


def to_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def from_json(state: Column, schema: str) -> Column:
    return F.from_json(state, schema)


def compact(versions: DataFrame, path: str) -> None:
    """Write the current states only, to a new folder."""
    latest(versions).write.mode("errorifexists").parquet(path)
