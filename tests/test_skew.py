"""Hot keys: every skew path must give exactly what the plain path gives."""

import re
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import content, dedup, fixes, joins, metrics, ranking, skew
from riskloom.plans import review
from riskloom.session import setting


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds more than a third of all rows, with many full copies."""
    data = [("hot", "f1", i % 50, i % 7) for i in range(400)] + [(f"k{i % 40}", f"f{i % 3}", i % 90, i % 7) for i in range(600)]
    return spark.createDataFrame(data, "repo string, path string, line int, v int").repartition(6)


def counted(df):
    return Counter(map(tuple, df.collect()))


def test_copies_get_different_salts(rows):
    same = rows.withColumn("line", F.lit(1)).withColumn("v", F.lit(1)).where("repo = 'hot'")
    assert same.select(skew.row_salt(same, 8).alias("s")).distinct().count() > 1


def test_number_rows_equals_window(rows):
    unique = rows.groupBy("repo", "path", "line", "v").count()
    order = ["path", "line", "v"]
    window = Window.partitionBy("repo").orderBy(*order)
    want = counted(unique.select("repo", *order, F.row_number().over(window).cast("bigint").alias("rn")))
    for depth in (0, 1, 2):
        assert counted(skew.number_rows(unique, ["repo"], order, depth=depth).select("repo", *order, "rn")) == want


def test_number_rows_with_few_and_many(spark, rows):
    gaps = rows.groupBy("repo", "path", "line", "v").count().withColumn("repo", F.expr("nullif(repo, 'k3')")).withColumn("line", F.expr("nullif(line, 4)"))
    unique = gaps.select("repo", "path", "line", "v").distinct()
    order = ["path", "line", "v"]
    want = counted(unique.withColumn("rn", F.row_number().over(Window.partitionBy("repo").orderBy(*order)).cast("bigint")))
    for few in (0, 15, 10_000):
        for depth in (1, 2):
            assert counted(skew.number_rows(unique, ["repo"], order, depth=depth, few=few)) == want


def test_rows_of_small_keys_meet_no_counts(rows):
    """Beside the keys with many rows, windows hold all rows of a key and deal them out once."""
    plan = skew.number_rows(rows, ["repo"], ["path", "line", "v"])._jdf.queryExecution().executedPlan().toString()
    assert "coalesce(repo" not in plan and "isnull(repo" not in plan      # as null-safe equality deals out anew for the join


def test_rows_of_large_keys_are_counted_by_ranges(spark):
    """Nothing is grouped by the order's columns, which may have as many values as there are rows."""
    many = spark.range(6000).selectExpr("if(id % 3 > 0, 'hot', 'k' || id % 7) repo", "xxhash64(id) % 3000 a", "id % 5 b", "id c")
    numbered = skew.number_rows(many, ["repo"], ["a", "b", "c"], few=100)
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    grouped = {name.split("#")[0] for keys in re.findall(r"Aggregate \[([^\]]*)\]", plan) for name in keys.split(", ")}
    assert grouped == {"_key", "_range"}
    window = Window.partitionBy("repo").orderBy("a", "b", "c")
    assert counted(numbered) == counted(many.withColumn("rn", F.row_number().over(window).cast("bigint")))


def test_number_rows_without_keys(rows):
    unique = rows.select("repo", "line").distinct()
    got = skew.number_rows(unique, [], ["repo", "line"]).orderBy("rn").collect()
    assert [r.rn for r in got] == list(range(1, len(got) + 1))
    assert [(r.repo, r.line) for r in got] == sorted((r.repo, r.line) for r in got)


def test_chunked_lists_are_bounded_and_whole(rows):
    lists = skew.chunked_lists(rows.withColumn("n", F.monotonically_increasing_id()), ["repo"], ["line", "v", "n"], F.col("line"), "xs", 25)
    got = lists.collect()
    assert max(len(r.xs) for r in got) <= 25 and sum(len(r.xs) for r in got) == 1000
    assert sorted(r.part for r in got if r.repo == "hot") == list(range(1, 17))


def test_context_with_a_hot_file(spark, files_of):
    files = files_of({"r": {"a.py": "\n".join(f"l{i}" for i in range(1, 31)), "b.py": "x"}})
    findings = spark.createDataFrame([("r", "a.py", i % 30 + 1, i % 30 + 1, f"c{i}") for i in range(200)] + [("r", "b.py", 1, 1, "c"), ("r", "gone.py", 1, 1, "c")],
                                     "repo string, path string, start_line int, end_line int, check_id string")
    assert content.marked_context(findings, files).count() == 201


def test_routing_with_a_hot_repository(spark, files_of):
    files = files_of({"hot": {f"lib/x{i}.txt": "" for i in range(100)}, "b": {"auth.py": ""}}).select("repo", "path")
    assert joins.route_files(files, joins.agent_names()).where("repo = 'hot'").count() == 500   # no analyser has a relevant file there, so all get all


def test_fixes_with_a_hot_file(spark, files_of):
    files = files_of({"r": {"a.py": "\n".join(f"l{i}" for i in range(1, 101)), "b.py": "x\ny"}})
    rows = [("r", "a.py", i, i + i % 2, f"n{i}", i % 10 / 10) for i in range(1, 101)] + [("r", "b.py", 2, 2, "z", 0.9), ("r", "b.py", 2, 9, "bad", 1.0), ("r", "c.py", 1, 1, "no", 1.0)]
    todo = spark.createDataFrame(rows, "repo string, path string, start_line int, end_line int, fixed_code string, confidence double")
    rows = fixes.select_fixes(files, todo).collect()
    status = Counter(r.status for r in rows)
    assert sum(status.values()) == 103 and status["missing"] == 1 and status["invalid"] >= 1
    touch = lambda a, b: (a.repo, a.path) == (b.repo, b.path) and a.start_line <= b.end_line and b.start_line <= a.end_line
    taken = [r for r in rows if r.status == "applied"]
    assert not any(touch(a, b) for i, a in enumerate(taken) for b in taken[:i])
    assert all(any(touch(a, b) and b.confidence >= a.confidence for b in taken) for a in rows if a.status == "overlapped")
    assert sum(r.n_fixes for r in fixes.apply_fixes(files, todo).collect()) == len(taken)


def test_fixes_that_do_not_touch_are_all_applied(spark, files_of):
    files = files_of({"r": {"a.py": "1\n2\n3\n4\n5\n6\n7\n8", "b.py": "x"}})
    rows = [("r", "a.py", 1, 3, "A", 0.9), ("r", "a.py", 3, 5, "B", 0.5), ("r", "a.py", 5, 7, "C", 0.8)]
    todo = spark.createDataFrame(rows, "repo string, path string, start_line int, end_line int, fixed_code string, confidence double")
    assert [(r.path, r.content, r.n_fixes) for r in fixes.apply_fixes(files, todo).collect()] == [("a.py", "A\n4\nC\n8", 2)]
    assert sorted(r.path for r in fixes.apply_fixes(files, todo, untouched=True).collect()) == ["a.py", "b.py"]


def test_secrets_in_a_hot_file(spark):
    findings = spark.createDataFrame([("r", "a", i, i + 150, f"c{i}") for i in range(1, 200)], "repo string, path string, start_line int, end_line int, check_id string")
    secrets = spark.createDataFrame([("r", "a", n, "token") for n in (1, 64, 128, 300, 400)], "repo string, path string, line int, detector string")
    want = Counter(n for n in (1, 64, 128, 300, 400) for i in range(1, 200) if i <= n <= i + 150)
    assert Counter(r.line for r in joins.secrets_in_findings(secrets, findings).collect()) == want


def test_dedup_is_idempotent_and_ignores_order(rows):
    f = rows.select("repo", "path", F.col("line").alias("start_line"), F.col("v").alias("check_id"), F.lit(1).alias("n"))
    once = dedup.dedup_agent(f, ["n"])
    assert counted(once) == counted(dedup.dedup_agent(once, ["n"])) == counted(dedup.dedup_agent(f.repartition(1), ["n"]))


def test_two_repositories_are_the_union_of_each(rows):
    f = rows.select("repo", "path", F.col("line").alias("start_line"), (F.col("line") + 2).alias("end_line"), F.lit("code-xss-analyser-a").alias("check_id"), F.lit("HIGH").alias("impact"))
    parts = [f.where("repo = 'hot'"), f.where("repo <> 'hot'")]
    for op in (ranking.merge_ranges, metrics.code_metrics, metrics.systemic_patterns, ranking.top_files):
        assert counted(op(f)) == counted(op(parts[0])) + counted(op(parts[1]))


def test_prompts_of_one_repository_are_made_in_many_places(spark):
    """2,100 parts meet five comments, and a repository without fixes, or without a name, meets none."""
    done = spark.range(2100).selectExpr("if(id < 0, 'none', 'r') repo", "'a.py' path", "cast(id as int) start_line", "cast(id as int) end_line", "'xss' vulnerability", "'d' || id description", "id")
    asked = [("r", i, f"why {i}") for i in range(5)] + [("other", 5, "and %s?"), (None, 6, "who?")]
    with setting(spark, "spark.sql.adaptive.enabled", "false"), setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        made = review.reply_prompts(spark.createDataFrame(asked, "repo string, comment_id int, body string"), done, ["id"], size=1)
        got = made.withColumn("place", F.spark_partition_id()).collect()
    assert len({r.place for r in got if r.repo == "r"}) > 1
    prompt = "You help developers with automated security fixes.\n\n%s\n\nComment:\n%s\n\nAnswer the question briefly, with technical detail where it helps, and name the next step."
    want = {(i, n): prompt % (f"Applied fixes:\n{n}. xss in a.py (lines {n - 1}-{n - 1}): d{n - 1}", f"why {i}") for i in range(5) for n in range(1, 2101)}
    want |= {(5, 1): prompt % ("No fixes were applied.", "and %s?"), (6, 1): prompt % ("No fixes were applied.", "who?")}
    assert {(r.comment_id, r.part): r.prompt for r in got} == want and len(got) == len(want)
