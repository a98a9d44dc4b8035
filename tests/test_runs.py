"""Resumed runs, the store of replies, related findings."""

import itertools
import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from riskloom.operators.related import overlap_groups, related_findings
from riskloom.plans import review
from riskloom.plans.scans import Tables
from riskloom.sources import runs

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_a_run_is_resumed_and_shown_whole(spark, tmp_path):
    out, made, broken = str(tmp_path / "out"), [], {"on": True}

    def shared(t):
        made.append("_shared")
        return spark.range(5)

    def first(t):
        made.append("first")
        return t["_shared"].where("id < 3")

    def second(t):
        made.append("second")
        if broken["on"]:
            raise RuntimeError("lost")
        return t["first"].agg(F.sum("id").alias("total"))

    makers = {"_shared": shared, "first": first, "second": second}
    assert runs.committed_run(spark, out) is None
    with pytest.raises(RuntimeError, match="lost"):
        Tables(makers).commit(spark, out, "a")
    assert runs.committed_run(spark, out) is None
    with pytest.raises(ValueError, match="no committed table"):
        runs.read_committed(spark, out, "first")
    with pytest.raises(ValueError, match="not staged in run a: second"):
        runs.commit(spark, out, "a", ["first", "second"])
    broken["on"] = False
    made.clear()
    Tables(makers).commit(spark, out, "a")
    assert made == ["second"]
    assert runs.read_committed(spark, out, "second").first().total == 3

    # The next run is seen as a whole or not at all.
    other = {"first": lambda t: spark.range(9), "second": second}
    broken["on"] = True
    with pytest.raises(RuntimeError):
        Tables(other).commit(spark, out, "b")
    assert runs.committed_run(spark, out) == ("a", ["first", "second"]) and runs.read_committed(spark, out, "first").count() == 3
    broken["on"] = False
    Tables(other).commit(spark, out, "b")
    assert runs.committed_run(spark, out)[0] == "b" and runs.read_committed(spark, out, "second").first().total == 36
    Tables(makers).commit(spark, out, "a")          # committed before: stays an earlier run
    assert runs.committed_run(spark, out)[0] == "b"


def test_a_table_without_its_log_row_is_written_again(spark, tmp_path):
    out = str(tmp_path / "out")
    spark.range(100).write.parquet(runs.table_path(out, "a", "t"))   # a crash between the write and its row
    assert runs.stage(spark, out, "a", "t", lambda: spark.range(3)).count() == 3


def _counting(folder, fail=lambda p: False):
    def make():
        def complete(prompts):
            if any(fail(p) for p in prompts):
                raise RuntimeError("no")
            with open(f"{folder}/{os.getpid()}", "a") as log:
                log.writelines(p + "\n" for p in prompts)
            return [review.Reply(p.upper(), len(p), 1) for p in prompts]
        return complete
    return make


def _asked(folder):
    return sorted(line for name in os.listdir(folder) for line in open(f"{folder}/{name}").read().split())


def test_replies_are_kept(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    store = str(tmp_path / "store")
    rows = [(str(i), f"p{i % 50}") for i in range(120)] + [("null", None), ("empty", "")]
    prompts = spark.createDataFrame(rows, "prompt_id string, prompt string")
    options = dict(batch=4, partitions=3, retries=0, wait=0.0)
    got = review.infer_stored(prompts, _counting(calls, lambda p: p == "p7"), store, **options).collect()
    by_id = {r.prompt_id: r for r in got}
    assert len(got) == 122 and by_id["null"].reply is None and by_id["null"].error is None and by_id["empty"].reply == ""
    assert all(by_id[i].reply == p.upper() for i, p in rows if p and p != "p7") and "no" in by_id["7"].error and by_id["57"].error
    assert _asked(calls) == sorted(f"p{i}" for i in range(50) if i != 7)     # the empty prompt has no word to count
    again = {r.prompt_id: r for r in review.infer_stored(prompts, _counting(calls), store, **options).collect()}
    assert again["7"].reply == "P7" and again["7"].error is None
    assert _asked(calls) == sorted(f"p{i}" for i in range(50))
    other = review.infer_stored(prompts.where("prompt_id = '1'"), _counting(calls), store, model="other", **options).collect()
    assert other[0].reply == "P1" and _asked(calls).count("p1") == 2
    none = review.infer_stored(prompts.limit(0), _counting(calls), str(tmp_path / "none"), **options)
    assert none.collect() == []


KILLED = """
import os, sys
sys.path.insert(0, {root!r})
from riskloom.plans import review
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2,3]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
class Lost(BaseException):
    pass
def make():
    def complete(prompts):
        dead = {calls!r} + "-dead"
        if "p11" in prompts and not os.path.exists(dead):
            open(dead, "w").close()
            raise Lost()
        with open({calls!r} + "/" + str(os.getpid()), "a") as log:
            log.writelines(p + chr(10) for p in prompts)
        return [p.upper() for p in prompts]
    return complete
prompts = spark.createDataFrame([(str(i), f"p{{i}}") for i in range(60)], "prompt_id string, prompt string")
got = review.infer_stored(prompts, make, {store!r}, batch=3, partitions=2).collect()
assert sorted(r.reply for r in got) == sorted(f"P{{i}}" for i in range(60))
"""


def test_a_repeated_task_asks_for_no_reply_twice(tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    code = KILLED.format(root=ROOT, calls=str(calls), store=str(tmp_path / "store"))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=90)
    assert done.returncode == 0, done.stderr[-3000:]
    assert os.path.exists(f"{calls}-dead") and _asked(calls) == sorted(f"p{i}" for i in range(60))


@pytest.mark.parametrize("few", [0, 100_000])
@pytest.mark.parametrize("ids", ["id", "id % 700"])
def test_a_store_gets_few_files_and_texts_stay_where_they_are(spark, tmp_path, monkeypatch, few, ids):
    """Some 500 batches leave a file per 64 and one per task; each prompt is asked once, whether ids repeat or not."""
    calls = tmp_path / "calls"
    calls.mkdir()
    store = str(tmp_path / "store")
    monkeypatch.setattr(review, "_FEW", few)
    prompts = spark.range(0, 2000, 1, 2).selectExpr(f"cast({ids} as string) prompt_id", "concat('p', id % 1900) prompt")
    got = review.infer_stored(prompts, _counting(calls, lambda p: p == "p9"), store, batch=4, retries=0, wait=0.0).collect()
    assert len(got) == 2000 and {r.reply for r in got} == {f"P{i}" for i in range(1900) if i != 9} | {None} and sum(r.error is not None for r in got) == 2
    assert _asked(calls) == sorted(f"p{i}" for i in range(1900) if i != 9)
    left = [name for _, _, names in os.walk(store) for name in names if not name.startswith(".")]
    assert len(left) <= 24 and all(name.endswith(".parquet") for name in left) and review.stored_replies(spark, store).count() == 1899


def test_an_attempt_finds_what_the_one_before_it_asked(tmp_path):
    rows = [(f"k{i}", f"r{i}", 1, 1, None) for i in range(9)]
    before, other = review._TaskFiles(str(tmp_path), 3), review._TaskFiles(str(tmp_path), 4)
    other.add([("other", "r", 1, 1, None)])
    before.add(rows[:4])
    before.add([*rows[4:8], ("bad", None, 0, 0, "no")])
    for _ in range(2):          # one by one, and put together
        done, failed = review._TaskFiles(str(tmp_path), 3).answered()
        assert done == {f"k{i}" for i in range(8)} | {"bad"} and failed == [("bad", None, 0, 0, "no")]
        before.merge()
    assert len(os.listdir(tmp_path)) == 2


FINDINGS = "repo string, path string, start_line int, end_line int, check_id string, impact string"


def _components(ranges):
    """Lines of overlapping ranges, pair by pair."""
    groups = {r: r for r in ranges}

    def top(r):
        while groups[r] != r:
            r = groups[r]
        return r
    for a, b in itertools.combinations(ranges, 2):
        if a[0] <= b[1] and b[0] <= a[1]:
            x, y = sorted((top(a), top(b)))
            groups[y] = x
    return {r[0]: min(s[0] for s in ranges if top(s) == top(r)) for r in ranges}


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_overlaps_over_blocks(spark, block):
    ranges = sorted({(s, s + (s * 7 + k * 11) % 9 - 2) for s in range(0, 90, 2) for k in range(2)} | {(200, 460), (300, 301), (459, 459), (461, 470)})
    rows = [("r", "a", s, e, "code-xss-analyser-1", "LOW") for s, e in ranges]
    got = {r.start_line: r.group_line for r in overlap_groups(spark.createDataFrame(rows, FINDINGS), block=block).collect()}
    assert got == _components([(s, max(s, e)) for s, e in ranges])


def test_related_findings_of_three_analysers(spark):
    rows = [("r", "a", 1, 5, "code-xss-analyser-1", "LOW"), ("r", "a", 4, 9, "code-injection-analyser-2", "CRITICAL"),
            ("r", "a", 9, None, "code-path-analyser-3", "HIGH"), ("r", "a", 10, 2, "code-xss-analyser-1", "LOW"),
            ("r", "b", 3, 3, "code-xss-analyser-1", None), (None, None, 3, 4, "code-xss-analyser-1", "LOW"),
            ("r", "a", None, 99, "code-xss-analyser-1", "LOW"), ("r", "a", None, None, "code-path-analyser-1", "INFO")]
    found = spark.createDataFrame(rows, FINDINGS)
    got = {(r.repo, r.path, r.start_line): r for r in related_findings(found, block=4).collect()}
    one = got["r", "a", 1]
    assert (one.end_line, one.n, one.impact, len(one.agents), one.corroborated) == (9, 3, "CRITICAL", 3, True)
    assert got["r", "a", 10].end_line == 10 and got["r", "b", 3].impact is None and not got["r", "b", 3].corroborated
    assert got[None, None, 3].n == 1 and (got["r", "a", None].n, got["r", "a", None].end_line) == (2, None) and len(got) == 5
    assert related_findings(found.limit(0)).collect() == []


def test_one_line_with_most_findings(spark):
    hot = spark.range(30_000).selectExpr("'r' repo", "'a' path", "if(id % 3 = 0, 7, cast(id as int)) start_line", "if(id % 3 = 0, 7, cast(id as int)) end_line",
                                         "'code-xss-analyser-1' check_id", "'LOW' impact")
    got = related_findings(hot)
    assert got.count() == 20_000 and got.where("start_line = 7").first().n == 10_001


def test_related_findings_are_dealt_out_by_block_once(spark):
    """Findings are moved for their line, their block and their group, and nothing but a row per block besides."""
    found = spark.createDataFrame([(None, "p", i, i + 1 if i % 5 else i, "code-xss-analyser-stored", "HIGH") for i in range(1, 40)]
                                  + [("r", "p", None, 9, "code-xss-analyser-stored", None)] * 2, FINDINGS)
    grouped = related_findings(found, by=("impact",), block=3)
    got = {(r.repo, r.impact, r.start_line): (r.end_line, r.n) for r in grouped.collect()}
    assert got == {(None, "HIGH", 5 * k + 1): (min(5 * k + 5, 40), 5 if k < 7 else 4) for k in range(8)} | {("r", None, None): (None, 2)}
    plan = grouped._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning", plan)) <= 6 and "ReusedExchange" in plan
