"""What must not grow with the input: memory per key, files, copies of prompts; and tables that are folders."""

import os
import tracemalloc
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from riskloom.checks import streams
from riskloom.streaming.state import Silence

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
T0 = datetime(2024, 1, 1)


def counted(df):
    return Counter(map(tuple, df.collect()))


def test_a_streamed_table_may_be_a_folder(spark, tmp_path):
    """Large tables are folders of files; a stream reads them like the single file, and batches do so too."""
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    want = counted(streams.unseen_comments_stream(spark, SF))
    assert want and counted(streams.unseen_comments_stream(spark, str(tmp_path))) == want


class Handle:
    """State of one key, as the state store hands it out."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, timer):
        self.timers.discard(timer)

    def registerTimer(self, timer):
        self.timers.add(timer)


class Clock:
    def getCurrentWatermarkInMs(self):
        return 0


def _told(rows):
    silence = Silence(6 * 3_600_000, True)
    silence.init(Handle())
    return [(r.status, r.last_update) for r in silence.handleInputRows(("a",), rows, Clock())]


def _updates(n, days=30):
    """Updates in no order, with a pause of a day after each day of work, and copies of an update under another status."""
    for i in range(n):
        k = i * 7919 % n
        day, part = divmod(k * days / n, 1)
        row = {"status": ("running", "started", "completed")[k % 3], "progress": 0.5, "ts": T0 + timedelta(days=2 * day + part / 2), "event_id": k}
        yield row
        if k % 1000 == 0:
            yield {**row, "status": "copy"}


def test_silence_holds_the_ends_of_stretches_only(spark):
    rows = sorted(_updates(3000), key=lambda r: (r["ts"], r["event_id"]))
    want, last = [], None
    for r in rows:
        if last is not None and (r["ts"], r["event_id"]) <= (last["ts"], last["event_id"]):
            continue
        if last is not None and last["status"] != "completed" and r["ts"] - last["ts"] > timedelta(hours=6):
            want.append((last["status"], last["ts"]))
        last = r
    assert _told(_updates(3000)) == want and len(want) > 5
    tracemalloc.start()
    try:
        _told(_updates(60_000))
        assert tracemalloc.get_traced_memory()[1] < 2_000_000     # all rows at once take 20 MB
    finally:
        tracemalloc.stop()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_prompts_meet_their_findings_without_a_nested_loop(spark):
    """The only join without an equal key is the one with the single count of files."""
    from riskloom.checks import review
    joins = [line for line in _plan(review.parsed_fixes(spark, SF)).splitlines() if "Join " in line]
    assert joins and not [line for line in joins if "sha2(" in line]


def test_replies_come_in_frames_not_in_batches():
    import pandas as pd

    from riskloom.plans import review
    calls = []

    def make():
        return lambda texts: calls.append(len(texts)) or [t.upper() for t in texts]

    frame = pd.DataFrame({"prompt_id": [str(i) for i in range(100)], "prompt": [f"p{i}" for i in range(100)]})
    got = list(review._asker(make, 16)(iter([frame, frame.iloc[:0]])))
    assert [len(g) for g in got] == [100] and calls == [16] * 6 + [4]
    assert got[0]["reply"].tolist() == [f"P{i}" for i in range(100)] and got[0]["prompt_id"].tolist() == [str(i) for i in range(100)]


def test_lines_are_numbered_per_file_and_not_per_finding(spark, files_of):
    from riskloom.operators import content
    files = files_of({"r": {"a.py": "\n".join(f"l{i}" for i in range(1, 41)), "b.py": "x"}})
    rows = [("r", "a.py", s, s + d) for s in range(1, 41) for d in (0, 1, 5) if s + d <= 40] + [("r", "b.py", 1, 1), ("r", "b.py", 2, 2), ("r", "a.py", 3, 2)]
    found = content.marked_context(spark.createDataFrame(rows, "repo string, path string, start_line int, end_line int"), files)
    above = _plan(found).split("Join ")[0]
    assert "transform(" not in above and "transform(" in _plan(found)
    got = {(r.path, r.start_line, r.end_line): r.context for r in found.collect()}
    text = {"a.py": [f"l{i}" for i in range(1, 41)], "b.py": ["x"]}
    want = {(p, s, e): "\n".join((">>> " if s <= i <= e else "    ") + f"{i:4d}: {text[p][i - 1]}" for i in range(max(0, s - 10) + 1, min(len(text[p]), e + 10) + 1))
            for _, p, s, e in rows if s <= e <= len(text[p])}
    assert got == want


def test_a_store_of_replies_keeps_no_second_copy_of_the_prompts(spark, tmp_path, monkeypatch):
    from riskloom.plans import review
    stored = []
    monkeypatch.setattr(review, "cut_lineage", lambda df, cut=review.cut_lineage: stored.append(df.columns) or cut(df))
    prompts = spark.range(200).selectExpr("cast(id as string) as prompt_id", "repeat(cast(id % 50 as string), 500) as prompt")

    def make():
        return lambda texts: [t[:1] for t in texts]

    def none():
        raise RuntimeError("the store should have answered")

    for client in (make, none):
        got = review.infer_stored(prompts, client, str(tmp_path / "store")).collect()
        assert {r.prompt_id: r.reply for r in got} == {str(i): str(i % 50)[0] for i in range(200)} and not [r for r in got if r.error]
    assert stored and not [c for c in stored if "prompt" in c]


def test_prompts_read_findings_and_contexts_no_more_than_needed(spark):
    """Files are named by all findings, not by a second grouping of them; a context's text is made per repository, in a shuffle of its own."""
    from riskloom.checks import review
    plan = _plan(review.model_usage(spark, SF))
    assert len([line for line in plan.splitlines() if "Aggregate [" in line and "check_id#" in line.split("]")[0]]) == 1
    told = [line for line in plan.splitlines() if "format_string(Language" in line]
    assert len(told) == 1 and "prompt" not in told[0] and "RepartitionByExpression [xxhash64(repo#" in plan


def test_keep_first_holds_each_value_once_and_tells_equal_rows_apart(spark):
    from riskloom.operators.ranking import keep_first
    rows = [("k", 1, None, "b"), ("k", 1, 5, "b"), ("k", 1, 5, "a"), ("k", 2, None, "a"), (None, None, 3, "c"), (None, 1, 1, "c")]
    for order, want in ((["n"], {("k", 1, None, "b"), (None, None, 3, "c")}), ([-F.col("n")], {("k", 2, None, "a"), (None, None, 3, "c")}),
                        (["t", "n"], {("k", 1, 5, "a"), (None, None, 3, "c")})):
        for turned in (rows, rows[::-1]):
            df = spark.createDataFrame(turned, "k string, n int, m int, t string").repartition(3)
            assert {tuple(r) for r in keep_first(df, ["k"], order).collect()} == want
    assert "min_by(" not in _plan(keep_first(df, ["k"], ["n", "m"]))
    held = df.withColumn("more", F.create_map("t", "n")).where("k = 'k'")
    assert [(r.n, r.more) for r in keep_first(held, ["k"], ["n", "t", "m"]).collect()] == [(1, {"a": 1})]


def test_a_reply_is_read_once_by_the_filters_on_its_document(spark):
    from riskloom.plans import review
    rows = [("a", 'So: {"is_legitimate": true, "confidence": 0.9}.'), ("b", "no"), ("c", None), ("d", '{"is_legitimate": tr}'), ("e", "{}")]
    told = review.parse_validations(spark.createDataFrame(rows, "prompt_id string, reply string"))
    assert _plan(told).count("from_json(") == 1
    assert sorted((r.prompt_id, r.is_legitimate, r.confidence) for r in told.collect()) == [("a", True, 0.9), ("e", False, 0.0)]
    rows = [("r", "i", '{"fix": "x", "confidence": 0.7}'), ("s", "i", '{"fix": "x", "confidence": 0.4}'), ("t", "i", "text"), ("u", "i", None)]
    fixed = review.parse_fixes(spark.createDataFrame(rows, "check_id string, impact string, reply string"))
    assert _plan(fixed).count("from_json(") == 1
    assert sorted((r.check_id, r.fixed_code == "x", r.confidence, r.manual) for r in fixed.collect()) == [("r", True, 0.7, False), ("t", False, 0.6, True)]


def test_a_validated_stage_groups_what_its_prompts_hold(spark, files_of):
    """What no prompt holds isn't grouped; findings meet their replies by the id's bytes, and get the id back as text."""
    from riskloom.plans import review
    files = files_of({"r": {"a.py": "\n".join(f"l{i}" for i in range(1, 201)), "package.json": "{}"}})
    found = spark.range(4000).selectExpr("if(id < 0, 'x', 'r') repo", "'a.py' path", "cast(id % 200 + 1 as int) start_line", "cast(id % 200 + 1 as int) end_line",
                                         "'c' || id div 400 check_id", "if(id % 400 < 200, 'b', 'a') impact", "if(id % 3 = 0, 'm', 'n') message", "sha2(string(id), 256) code")
    groups = []
    real = review.keep_first
    review.keep_first = lambda df, keys, order: groups.append(df.columns) or real(df, keys, order)
    try:
        kept = review.validate_stage(found, files, review.repo_context(files), lambda: lambda ps: ['{"is_legitimate": %s, "confidence": 0.9}' % ("Impact: a" in p and "true" or "false") for p in ps])
    finally:
        review.keep_first = real
    assert groups == [["repo", "path", "start_line", "end_line", "check_id", "impact", "message"]]
    rows = kept.collect()
    assert len(rows) == 4000 and {r.is_legitimate for r in rows} == {True} and len({r.prompt_id for r in rows}) == 2000 and {len(r.prompt_id) for r in rows} == {64}
    first = kept.columns
    assert first[0] == "prompt_id" and first[1:9] == found.columns
