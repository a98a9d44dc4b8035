"""Runs that can be resumed: tables are staged one by one and shown together.

The log is a table of its own under the output folder. A table is written to the folder of its run and then logged as `staged`; when
all tables of a run are staged, one row `committed` shows them. Readers take the latest committed run, so they see the old set or
the new one. A run that is started again under the same id takes what is staged and makes the rest; a folder without its row is
written anew. Log rows are appended by Spark's own commit of a write, on any file system that Spark reads.

One driver writes a run at a time. A run that was committed isn't written again. Folders of old runs stay until they are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "run_id string, event string, name string, at timestamp, names array<string>"


def _log_path(out: str) -> str:
    return f"{out.rstrip('/')}/_runs/log"


def table_path(out: str, run_id: str, name: str) -> str:
    return f"{out.rstrip('/')}/_runs/{run_id}/{name}"


def run_log(spark: SparkSession, out: str) -> DataFrame:
    """run_id, event (staged or committed), name, at, names. Empty if nothing was logged."""
    try:
        return spark.read.schema(LOG).parquet(_log_path(out))
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def _append(spark: SparkSession, out: str, run_id: str, event: str, name: str | None = None, names: list[str] | None = None) -> None:
    row = spark.createDataFrame([(run_id, event, name, names)], "run_id string, event string, name string, names array<string>")
    row.withColumn("at", F.current_timestamp()).select("run_id", "event", "name", "at", "names").coalesce(1) \
        .write.mode("append").parquet(_log_path(out))


def staged_names(spark: SparkSession, out: str, run_id: str) -> set[str]:
    """The tables of a run that are finished; a run has few tables."""
    rows = run_log(spark, out).where((F.col("run_id") == run_id) & (F.col("event") == "staged")).select("name").distinct()
    return {r.name for r in rows.collect()}


def stage(spark: SparkSession, out: str, run_id: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` of the run: read if it is staged, else made, written and logged."""
    path = table_path(out, run_id, name)
    if name not in staged_names(spark, out, run_id):
        make().write.mode("overwrite").parquet(path)
        _append(spark, out, run_id, "staged", name)
    return spark.read.parquet(path)


def commit(spark: SparkSession, out: str, run_id: str, names: list[str]) -> None:
    """Show the named tables of the run to readers. All must be staged; a run that is committed stays as it is."""
    missing = sorted(set(names) - staged_names(spark, out, run_id))
    if missing:
        raise ValueError(f"not staged in run {run_id}: {', '.join(missing)}")
    log = run_log(spark, out)
    if not log.where((F.col("run_id") == run_id) & (F.col("event") == "committed")).limit(1).count():
        _append(spark, out, run_id, "committed", names=sorted(names))


def committed_run(spark: SparkSession, out: str) -> tuple[str, list[str]] | None:
    """The id and table names of the latest committed run; of two in the same instant, the one with the larger id."""
    row = run_log(spark, out).where(F.col("event") == "committed").agg(F.max(F.struct("at", "run_id", "names")).alias("r")).first()
    return None if row.r is None else (row.r.run_id, list(row.r.names))


def read_committed(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The table `name` of the latest committed run."""
    found = committed_run(spark, out)
    if found is None or name not in found[1]:
        raise ValueError(f"no committed table {name} in {out}")
    return spark.read.parquet(table_path(out, found[0], name))
