"""Streaming forms against their batch twins, with late rows."""

import glob
import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.checks.streams import drain, tracked
from riskloom.streaming import jobs

T0 = datetime(2024, 1, 1)
SCHEMA = "repo string, path string, sha string, ts timestamp, severity string, agent string, issue int, comment_id int"


def batch(spark, rows):
    return spark.createDataFrame([(r, p, s, T0 + timedelta(minutes=m), sev, a, 1, c) for r, p, s, m, sev, a, c in rows], SCHEMA)


ROWS = [[("r", f"f{i % 5}", f"s{i % 3}", i * 37, "HIGH" if i % 2 else "LOW", f"a{i % 2}", i % 9) for i in range(60)],
        [("r", f"f{i % 5}", f"s{i % 4}", 1000 + i * 41, "HIGH", f"a{i % 3}", i % 11) for i in range(60)]]


@pytest.fixture()
def stream(spark, tmp_path):
    """A file stream of two batches, one file each."""
    def make(extra=()):
        for n, rows in enumerate([*ROWS, *extra]):
            batch(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return make


def everything(spark):
    return batch(spark, ROWS[0]).unionByName(batch(spark, ROWS[1]))


def counted(df):
    return Counter(map(tuple, df.collect()))


LAST = [("r", "f0", "end", 60 * 24 * 400, "HIGH", "a0", 99)]      # moves every watermark past the rest


def test_trend(spark, stream):
    got = drain(jobs.trend(stream([LAST])), spark, "t")
    assert counted(got) == counted(jobs.trend(everything(spark)))


def test_sliding_trend_counts_each_row_in_every_window(spark):
    got = jobs.trend(everything(spark), window="7 days", slide="1 day")
    assert sum(r.n for r in got.collect()) == 7 * 120


def test_changes_are_told_however_old_the_version_before(spark, tmp_path):
    """A version that comes again much later is no change; one that comes back after another is."""
    later = [("r", "f0", s, 60 * 24 * d, "LOW", "a", 0) for d, s in ((100, "x"), (200, "x"), (300, "y"))]
    back = [("r", "f0", s, 60 * 24 * d, "LOW", "a", 0) for d, s in ((350, "y"), (360, "x"))]
    for rows in (ROWS[0], later, back):
        batch(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = tracked(spark, "c", lambda out, checkpoint: jobs.track_changes(frame, out, checkpoint))
    want, last = Counter(), {}
    for _, p, s, m, *_ in sorted([*ROWS[0], *later, *back], key=lambda x: (x[3], x[2])):
        if last.get(p) != s:
            want[(p, s, T0 + timedelta(minutes=m))] += 1
        last[p] = s
    assert counted(got.select("path", "sha", "ts")) == want


def test_changes_cost_what_a_batch_holds_and_survive_a_restart(spark, tmp_path):
    """Many epochs, some after a restart: each reads its own rows only, and nothing is lost or told twice."""
    rng = random.Random(4)
    rows, folder = [], tmp_path / "in"
    want, last = Counter(), {}
    for part in range(4):
        for epoch in range(4):
            new = [("r", f"f{rng.randrange(40)}", rng.choice(["a", "b", None]), 1000 * len(rows) + i, "LOW", "a", 0) for i in range(60)]
            rows.append(new)
            batch(spark, new).coalesce(1).write.mode("append").parquet(str(folder))
            for _, p, s, m, *_ in new:
                if p not in last or last[p] != s:
                    want[(p, s, T0 + timedelta(minutes=m))] += 1
                last[p] = s
        frame = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
        query = jobs.track_changes(frame, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        epochs = [p for p in query.recentProgress if p.numInputRows]
        assert len(epochs) == 4 and all(p.numInputRows == 60 for p in epochs)
        assert all(p.stateOperators[0].numRowsTotal <= 40 for p in epochs)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert counted(got.select("path", "sha", "ts")) == want


def test_a_replayed_batch_replaces_itself(spark, stream, tmp_path):
    """The last epoch again, as after a failure before its commit, leaves the table as it was."""
    frame, out, checkpoint = stream(), str(tmp_path / "out"), tmp_path / "c"
    run = lambda: jobs.track_changes(frame, out, str(checkpoint)).trigger(availableNow=True).start().awaitTermination()
    run()
    before = counted(spark.read.parquet(out))
    commits = [int(p.name) for p in (checkpoint / "commits").iterdir() if p.name.isdigit()]
    assert len(commits) >= 2
    (checkpoint / "commits" / str(max(commits))).unlink()
    (checkpoint / "commits" / f".{max(commits)}.crc").unlink(missing_ok=True)
    run()
    assert counted(spark.read.parquet(out)) == before and before


def test_silence_alone_tells_a_stalled_agent(spark, tmp_path):
    """One batch, then nothing: the row comes by the clock. An agent that is done isn't told."""
    rows = [("a", "running", 0.3, 0), ("b", "completed", 1.0, 1), ("c", "running", 0.1, 2), ("c", "failed", 0.2, 3)]
    schema = "agent string, status string, progress double, ts timestamp, event_id bigint"
    spark.createDataFrame([(a, s, p, T0 + timedelta(minutes=m), m) for a, s, p, m in rows], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = jobs.stalled_agents(stream, 3000).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")) \
        .trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            time.sleep(1)
            told = [(r.agent, r.status, r.last_update) for r in spark.read.schema("agent string, status string, last_update timestamp").parquet(out).collect()] \
                if glob.glob(f"{out}/*.parquet") else []
            if told:
                break
    finally:
        query.stop()
    assert told == [("a", "running", T0)]


def test_changed_files_batch(spark):
    seen = batch(spark, ROWS[0]).select("repo", "path", "sha")
    new = everything(spark).select("repo", "path", "sha")
    want = set(map(tuple, new.collect())) - set(map(tuple, seen.collect()))
    assert counted(jobs.changed_files(new, seen)) == Counter(dict.fromkeys(want, 1))


def test_comments_are_answered_once(spark, stream):
    """Also one whose copy comes a year later."""
    frame = stream([[("r", "f", "s", 60 * 24 * 400, "LOW", "a", 3)]])
    got = tracked(spark, "m", lambda out, checkpoint: jobs.track_comments(frame.select("repo", "issue", "comment_id", "ts"), out, checkpoint))
    assert counted(got.select("comment_id")) == counted(everything(spark).select("comment_id").distinct())


def test_sessions(spark, stream):
    got = drain(jobs.agent_sessions_stream(stream([LAST]), 3000), spark, "s")
    assert counted(got) == counted(jobs.agent_sessions(everything(spark), 3000))


def test_a_late_row_is_dropped(spark, stream):
    """A row far behind the watermark comes in a batch of its own, after the watermark has moved."""
    frame = jobs.trend(stream([[("r", "f", "s", 60 * 24 * 30, "HIGH", "a", 1)], [("r", "late", "s", 1, "LOW", "a", 1)], [("r", "f", "s", 60 * 24 * 60, "HIGH", "a", 1)]]), watermark="1 hour")
    got = drain(frame, spark, "l")
    first_day = {r.severity: r.n for r in got.where(F.col("window_start") == F.lit(T0).cast("timestamp")).collect()}
    in_time = Counter(r[4] for r in ROWS[0] + ROWS[1] if r[3] < 60 * 24)
    assert first_day == dict(in_time)


def test_agent_status(spark):
    rows = [("a", "running", 0.1, 0), ("a", "completed", 1.0, 50), ("b", "running", 0.3, 10), ("c", "running", 0.5, 200)]
    df = spark.createDataFrame([(a, s, p, T0 + timedelta(minutes=m), m) for a, s, p, m in rows], "agent string, status string, progress double, ts timestamp, event_id int")
    got = {r.agent: (r.status, r.stalled) for r in jobs.agent_status(df, "1 hour", F.lit(T0 + timedelta(minutes=210))).collect()}
    assert got == {"a": ("completed", False), "b": ("running", True), "c": ("running", False)}


def test_status_of_a_stream(spark, tmp_path):
    """Two batches, one late row, and a timeout that passes without new updates."""
    rows = [[("a", "running", 0.1, 0), ("b", "running", 0.3, 10)], [("a", "completed", 1.0, 50), ("a", "running", 0.05, -5), ("c", "running", 0.5, 200)]]
    schema = "agent string, status string, progress double, ts timestamp, event_id bigint"
    for part in rows:
        df = spark.createDataFrame([(a, s, p, T0 + timedelta(minutes=m), m) for a, s, p, m in part], schema)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    jobs.track_status(stream, out, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    table = spark.read.parquet(out)
    for minutes, stalled in ((205, {"b"}), (300, {"b", "c"})):
        got = {r.agent: r for r in jobs.tracked_status(table, "1 hour", F.lit(T0 + timedelta(minutes=minutes))).collect()}
        assert {a for a, r in got.items() if r.stalled} == stalled and got["a"].status == "completed" and got["a"].updates == 3


def test_real_files(spark, tmp_path):
    """Names with spaces, nested folders, links and a file that can't be read."""
    from riskloom.sources import files
    (tmp_path / "r" / "src dir").mkdir(parents=True)
    (tmp_path / "r" / "src dir" / "a b.py").write_text("x")
    (tmp_path / "r" / "go.mod").write_text("module m")
    (tmp_path / "r" / "link.mod").symlink_to(tmp_path / "r" / "go.mod")
    found = files.inventory(files.scan_files(spark, str(tmp_path))).collect()
    assert {(r.repo, r.path, r.type) for r in found} == {("r", "src dir/a b.py", "file"), ("r", "go.mod", "file"), ("r", "link.mod", "file"), ("r", "src dir", "dir")}
    assert files.unreadable_files(spark, str(tmp_path)).collect() == []
