"""Incremental scan, trends, unseen comments and analyser progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.joins import unmatched
from riskloom.streaming import state


def as_event_time(df: DataFrame, column: str, watermark: str) -> DataFrame:
    """Watermarks need a zoned timestamp; Parquet files may hold local ones."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, watermark)


def changed_files(new: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose (repo, path, sha) was not seen before, each once. Copies go before the join."""
    return unmatched(new.dropDuplicates(["repo", "path", "sha"]), seen, ["repo", "path", "sha"])


def track_changes(files: DataFrame, out: str, checkpoint: str, time: str = "ts", ttl_ms: int | None = None):
    """Stream of file versions to a table of changes: a version counts if it differs from the one before it, however old.

    The last version of each (repo, path) is kept in the state store, so a batch costs what it holds. Batches must not reach behind
    earlier ones. Each epoch writes a folder of its own, which a replayed batch replaces. A file whose state is older than `ttl_ms`
    counts as new.
    """
    state.use_state_store(files.sparkSession)
    changed = files.groupBy("repo", "path").transformWithState(
        state.LastVersion(time, ttl_ms), files.schema, "append", "processingTime" if ttl_ms else "none")
    return _by_epoch(changed, out, checkpoint)


def _by_epoch(rows: DataFrame, out: str, checkpoint: str):
    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(store)


def trend(findings: DataFrame, keys=("severity",), time: str = "ts", window: str = "1 day", slide: str | None = None,
          watermark: str = "2 days") -> DataFrame:
    """Findings per window and key; with `slide` the windows overlap."""
    timed = as_event_time(findings, time, watermark)
    frame = F.window(time, window, slide) if slide else F.window(time, window)
    return (timed.groupBy(frame.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n"))


def unseen_comments(comments: DataFrame, answered: DataFrame) -> DataFrame:
    """Comments that have no answer yet, each once."""
    keys = ["repo", "issue", "comment_id"]
    return unmatched(comments.dropDuplicates(keys), answered, keys)


def track_comments(comments: DataFrame, out: str, checkpoint: str):
    """Stream of comments to a table of those to answer, each once however late its copies come.

    The keys of all comments so far are in the state store; an epoch writes a folder of its own with the comments that are new.
    """
    return _by_epoch(comments.dropDuplicates(["repo", "issue", "comment_id"]), out, checkpoint)


def stalled_agents(progress: DataFrame, timeout_ms: int = 3_600_000, watermark: str | None = None) -> DataFrame:
    """Stream of progress to a row (agent, status, progress, last_update, stalled_at) whenever an analyser is silent for the timeout.

    With a watermark, time is that of the updates; without, it is the clock, and a row comes though nothing else does.
    """
    state.use_state_store(progress.sparkSession)
    rows = progress.select("agent", "status", F.col("progress").cast("double").alias("progress"), F.col("ts").cast("timestamp").alias("ts"),
                           F.col("event_id").cast("long").alias("event_id")).where("ts is not null and event_id is not null")
    rows = rows.withWatermark("ts", watermark) if watermark else rows
    return rows.groupBy("agent").transformWithState(
        state.Silence(timeout_ms, bool(watermark)), "agent string, status string, progress double, last_update timestamp, stalled_at timestamp",
        "append", "eventTime" if watermark else "processingTime")


def agent_status(progress: DataFrame, timeout: str = "1 hour", now: Column | None = None) -> DataFrame:
    """Latest status of each analyser; stalled when its last update is older than the timeout.

    Updates are in order of time, then event id.
    """
    return _judged(_latest(progress.withColumn("updates", F.lit(1).cast("bigint"))), timeout, now)


def _latest(updates: DataFrame) -> DataFrame:
    return updates.groupBy("agent").agg(
        F.max_by(F.struct("status", "progress", "ts", "event_id"), F.struct("ts", "event_id")).alias("_last"),
        F.sum("updates").alias("updates")).select("agent", "_last.*", "updates")


def track_status(progress: DataFrame, out: str, checkpoint: str):
    """Stream of progress to a table of the latest status: each epoch's folder holds one row per analyser."""
    def step(batch: DataFrame, epoch: int) -> None:
        rows = batch.select("agent", "status", "progress", "ts", "event_id", F.lit(1).cast("bigint").alias("updates"))
        if epoch:
            rows = rows.unionByName(batch.sparkSession.read.schema(rows.schema).parquet(f"{out}/epoch={epoch - 1}"))
        _latest(rows).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return progress.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)


def tracked_status(table: DataFrame, timeout: str = "1 hour", now: Column | None = None) -> DataFrame:
    """`agent_status` from the table of `track_status` (with its epochs): the timeout counts from now, without new updates too."""
    last = table.groupBy("agent").agg(F.max_by(F.struct("status", "progress", "ts", "event_id", "updates"), "epoch").alias("l"))
    return _judged(last.select("agent", "l.*"), timeout, now)


def _judged(latest: DataFrame, timeout: str, now: Column | None) -> DataFrame:
    current = F.current_timestamp() if now is None else now
    late = F.col("ts").cast("timestamp") + F.expr(f"INTERVAL {timeout}") < current
    done = F.col("status").isin("completed", "failed", "terminated")
    return latest.select("agent", "status", "progress", F.col("ts").alias("last_update"), "updates", (late & ~done).alias("stalled"))


def agent_sessions(progress: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Stretches of work of each analyser: updates with no break longer than the gap."""
    timed = progress.withColumn("ts", F.col("ts").cast("timestamp"))
    return (timed.groupBy(F.session_window("ts", f"{gap_seconds} seconds").alias("w"), "agent")
            .agg(F.count(F.lit(1)).alias("updates"))
            .select("agent", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "updates"))


def agent_sessions_stream(progress: DataFrame, gap_seconds: int = 1800, watermark: str = "1 hour") -> DataFrame:
    """The same on a stream, with Spark's own session windows."""
    timed = as_event_time(progress, "ts", watermark)
    return (timed.groupBy(F.session_window("ts", f"{gap_seconds} seconds").alias("w"), "agent")
            .agg(F.count(F.lit(1)).alias("updates"))
            .select("agent", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "updates"))
