"""Queries on incremental and streaming forms, and on stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.checks import sqltext as q
from riskloom.checks import views
from riskloom.functions import severity
from riskloom.operators import rollups
from riskloom.session import ensure_checkpoint_dir
from riskloom.sources import runs, tables
from riskloom.streaming import jobs

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def work_folder(spark, name):
    """A new folder next to the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stream_table(spark, sf, name):
    """A driver table as a file stream, whether it is one file or a folder of files."""
    schema = views.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf.rstrip('/')}/{name}.parque[t]")   # a stream takes a single file by a pattern only


def drain(df, spark, name):
    """Runs a stream in append mode over all data there is, and reads back what it wrote.

    Every epoch has a folder of its own, so a replayed one replaces itself.
    """
    out = work_folder(spark, name)

    def store(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{out}/data/epoch={epoch}")

    (df.writeStream.outputMode("append").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
     .foreachBatch(store).start().awaitTermination())
    return spark.read.parquet(f"{out}/data").drop("epoch")


def tracked(spark, name, start):
    """The same for a stream that keeps a table of its own: `start(out, checkpoint)` gives its writer."""
    out = work_folder(spark, name)
    start(f"{out}/data", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/data").drop("epoch")


_DAILY = "select date_trunc('day', ts)::timestamp as window_start, date_trunc('day', ts)::timestamp + interval 1 day as window_end, event_type as severity, count(*) as n from events group by 1, 2, 3"
_SLIDING = """with s as (select date_trunc('day', ts)::timestamp - to_days(cast(k as int)) as window_start, event_type as severity from events, range(0, 7) t(k))
    select window_start, window_start + interval 7 day as window_end, severity, count(*) as n from s group by 1, 2, 3"""


def _events(df):
    return df.selectExpr("ts", "event_type as severity")


@query("daily_trend", _DAILY)
def daily_trend(spark, sf):
    return jobs.trend(_events(views.table(spark, sf, "events")))


@query("merged_trend", """select strftime(date_trunc('week', ts), '%Y-%m-%d') as week, count(*) as n_rows, count(distinct user_id) as users, count(distinct event_type) as types,
    true as users_near, true as types_near from events group by 1""")
def merged_trend(spark, sf):
    """Days as stored sketches, added up to weeks; their estimates lie within four standard errors of the exact counts."""
    events = views.table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    days = rollups.sketched(events, ["day"], ["user_id", "event_type"])
    week = lambda c: F.date_format(F.date_trunc("week", c), "yyyy-MM-dd").alias("week")
    weeks = rollups.estimates(rollups.merged(days.withColumn("week", week("day")), ["week"]))
    exact = events.groupBy(week("ts")).agg(
        F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"))
    near = lambda found, true: F.abs(F.col(found) - F.col(true)) <= 4 * rollups.standard_error() * F.col(true)
    return weeks.join(exact, "week").select("week", "n_rows", "users", "types", near("n_user_id", "users").alias("users_near"),
                                              near("n_event_type", "types").alias("types_near"))


@query("sliding_trend", _SLIDING)
def sliding_trend(spark, sf):
    return jobs.trend(_events(views.table(spark, sf, "events")), window="7 days", slide="1 day")


@query("daily_trend_stream", f"with t as ({_DAILY}) select * from t where window_end <= (select max(ts)::timestamp - interval 2 day from events)")
def daily_trend_stream(spark, sf):
    """Windows come out, and leave the state, when the watermark has passed them."""
    return drain(jobs.trend(_events(stream_table(spark, sf, "events"))), spark, "trend")


_VERSION = "'u' || cast(user_id % 40 as varchar(20)) as repo, 'f' || cast(event_id % 60 as varchar(20)) as path, event_type as sha"


@query("changed_files", f"""with v as (select distinct {_VERSION} from events) select v.* from v where not exists (select 1 from (select distinct {_VERSION} from events where ts < timestamp '2024-01-10') s where s.repo = v.repo and s.path = v.path and s.sha = v.sha)""")
def changed_files(spark, sf):
    events = views.table(spark, sf, "events")
    versions = events.selectExpr(*_VERSION.split(", "))
    return jobs.changed_files(versions, events.where("ts < timestamp '2024-01-10'").selectExpr(*_VERSION.split(", ")))


@query("changed_files_stream", f"with v as (select {_VERSION}, ts from events), l as (select *, lag(sha) over (partition by repo, path order by ts, sha) as before from v) select repo, path, sha, ts from l where sha is distinct from before")
def changed_files_stream(spark, sf):
    versions = stream_table(spark, sf, "events").selectExpr(*_VERSION.split(", "), "ts")
    return tracked(spark, "changed", lambda out, checkpoint: jobs.track_changes(versions, out, checkpoint))


_COMMENT = "repo, issue, comment_id, body"


@query("unseen_comments", f"select distinct {_COMMENT} from v_comments where comment_id not in (select comment_id from v_comments where turn % 4 = 1)")
def unseen_comments(spark, sf):
    c = views.comments(spark, sf)
    return jobs.unseen_comments(c, c.where("turn % 4 = 1")).select("repo", "issue", "comment_id", "body")


@query("unseen_comments_stream", f"select distinct {_COMMENT} from v_comments")
def unseen_comments_stream(spark, sf):
    rows = stream_table(spark, sf, "conversations").selectExpr(
        "'r' || cast(conv_id % 25 as varchar(20)) as repo", "conv_id as issue", "conv_id * 1000 + turn as comment_id", "text as body",
        "explode(case when turn % 3 = 0 then array(1, 2) else array(1) end) as copy").drop("copy")
    return tracked(spark, "comments", lambda out, checkpoint: jobs.track_comments(rows, out, checkpoint))


@query("agent_status", """with r as (select *, row_number() over (partition by agent order by ts desc, event_id desc) as rn, count(*) over (partition by agent) as updates from v_progress)
    select agent, status, round(progress, 6) as progress, ts as last_update, updates, ts + interval 1 hour < timestamp '2024-01-31' and status not in ('completed', 'failed', 'terminated') as stalled from r where rn = 1""")
def agent_status(spark, sf):
    s = jobs.agent_status(views.progress(spark, sf), "1 hour", F.lit("2024-01-31").cast("timestamp"))
    return s.withColumn("progress", F.round("progress", 6))


@query("agent_status_stream", SQL["agent_status"])
def agent_status_stream(spark, sf):
    progress = stream_table(spark, sf, "events").selectExpr(
        "'agent_' || cast(user_id % 12 as varchar(20)) as agent", "event_type as status", "ts", "value as progress", "event_id")
    out = work_folder(spark, "status")
    jobs.track_status(progress, f"{out}/data", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    s = jobs.tracked_status(spark.read.parquet(f"{out}/data"), "1 hour", F.lit("2024-01-31").cast("timestamp"))
    return s.withColumn("progress", F.round("progress", 6))


@query("stalled_agents_stream", """with n as (select *, lead(ts) over (partition by agent order by ts, event_id) as next from v_progress)
    select agent, status, round(progress, 6) as progress, ts::timestamp as last_update, ts::timestamp + interval 6 hour as stalled_at from n
    where status not in ('completed', 'failed', 'terminated') and coalesce(next, (select max(ts) - interval 1 day from v_progress)) > ts + interval 6 hour""")
def stalled_agents_stream(spark, sf):
    progress = stream_table(spark, sf, "events").selectExpr(
        "'agent_' || cast(user_id % 12 as varchar(20)) as agent", "event_type as status", "ts", "value as progress", "event_id")
    return drain(jobs.stalled_agents(progress, 6 * 3_600_000, "1 day"), spark, "stalled").withColumn("progress", F.round("progress", 6))


_SESSIONS = """with l as (select agent, ts, lag(ts) over (partition by agent order by ts) as prev from v_progress),
    s as (select *, sum(case when prev is null or epoch_us(ts) - epoch_us(prev) > 1800000000 then 1 else 0 end) over (partition by agent order by ts rows unbounded preceding) as k from l)
    select agent, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as updates from s group by agent, k"""


@query("agent_sessions", _SESSIONS)
def agent_sessions(spark, sf):
    return jobs.agent_sessions(views.progress(spark, sf))


@query("agent_sessions_stream", f"with e as ({_SESSIONS}) select * from e where session_end <= (select max(ts)::timestamp - interval 1 hour from v_progress)")
def agent_sessions_stream(spark, sf):
    progress = stream_table(spark, sf, "events").selectExpr("'agent_' || cast(user_id % 12 as varchar(20)) as agent", "ts")
    return drain(jobs.agent_sessions_stream(progress), spark, "sessions")


@query("stored_findings", f"select repo, path, start_line, check_id, l_orderkey, l_linenumber, l_partkey, {q.report_severity('impact')} as severity from v_findings")
def stored_findings(spark, sf):
    out = work_folder(spark, "tables")
    found = views.findings(spark, sf).select("repo", "path", "start_line", "check_id", "l_orderkey", "l_linenumber", "l_partkey",
                                             severity.report_severity(F.col("impact")).alias("severity"))
    tables.write_tables({"findings": found}, out, {"findings": ["severity"]})
    return tables.read_table(spark, out, "findings")


@query("committed_tables", f"""with r as (select repo, {q.report_severity('impact')} as severity, count(*) as n from v_findings group by 1, 2)
    select repo, severity, n, sum(n) over (partition by repo)::bigint as total from r""")
def committed_tables(spark, sf):
    """Two tables of a run, staged and shown together; the run is resumed, and an unfinished later one isn't seen."""
    out = work_folder(spark, "runs")
    found = views.findings(spark, sf).select("repo", severity.report_severity(F.col("impact")).alias("severity"))
    counts = runs.stage(spark, out, "first", "counts", lambda: found.groupBy("repo", "severity").agg(F.count("*").alias("n")))
    totals = lambda: runs.stage(spark, out, "first", "totals", lambda: counts.groupBy("repo").agg(F.sum("n").alias("total")))
    totals()
    runs.commit(spark, out, "first", ["counts", "totals"])
    runs.stage(spark, out, "second", "counts", lambda: counts.limit(0))
    return runs.read_committed(spark, out, "counts").join(runs.read_committed(spark, out, "totals"), "repo")
