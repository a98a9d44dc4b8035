"""Severity scales, filters, names, reports and code context."""

import pytest
from pyspark.sql import functions as F

from riskloom import dims
from riskloom.functions import findings as ff
from riskloom.functions import paths, severity, text
from riskloom.operators import content, dedup, filters, metrics, ranking

IMPACTS = ["HIGH", "critical", "Medium", "LOW", "INFO", "", "odd"]


@pytest.fixture(scope="module")
def impacts(spark):
    return spark.createDataFrame([(i,) for i in IMPACTS], "impact string")


def values(df, expr):
    return [r.x for r in df.select(expr.alias("x")).collect()]


def test_severity_expressions(impacts):
    i = F.col("impact")
    assert values(impacts, severity.scanner_severity(i)) == ["CRITICAL", "CRITICAL", "ERROR", "WARNING", "INFO", "INFO", "INFO"]
    assert values(impacts, severity.report_severity(i)) == ["HIGH", "HIGH", "MEDIUM", "LOW", "INFO", "INFO", "INFO"]
    assert values(impacts, severity.severity4_from_impact(i)) == ["HIGH", "CRITICAL", "MEDIUM", "LOW", "MEDIUM", "MEDIUM", "MEDIUM"]
    assert values(impacts, severity.horizon(i)) == ["this week", "immediate"] + ["this month"] * 5


def test_level_names(spark):
    levels = spark.createDataFrame([(x,) for x in ("ERROR", "WARNING", "INFO", "NOTE", "HIGH", "x")], "l string")
    assert values(levels, severity.severity4_from_level(F.col("l"))) == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "HIGH", "MEDIUM"]


@pytest.mark.parametrize("minimum, n", [("CRITICAL", 2), ("ERROR", 3), ("warning", 4), ("INFO", 7), ("unknown", 7)])
def test_scanner_filter(impacts, minimum, n):
    assert filters.filter_scanner_severity(impacts, minimum).count() == n


@pytest.mark.parametrize("minimum, n", [("CRITICAL", 0), ("HIGH", 2), ("MEDIUM", 3), ("INFO", 7), ("unknown", 7)])
def test_report_filter(impacts, minimum, n):
    assert filters.filter_report_severity(impacts, minimum).count() == n


def test_four_level_filter(spark):
    df = spark.createDataFrame([("HIGH",), ("LOW",), ("high",), ("odd",)], "severity string")
    assert filters.filter_severity4(df, "low").count() == 2
    assert filters.filter_severity4(df, "odd").count() == 4


def test_report_drops_critical_by_default(impacts):
    assert filters.report_eligible(impacts).count() == 3
    assert filters.report_eligible(impacts, ("CRITICAL", "HIGH")).count() == 2


@pytest.mark.parametrize("check_id, title, kind, cwe", [
    ("python.lang.sql-injection", "Lang.sql Injection", "unknown", "CWE-94"),
    ("javascript.xss_check", "Xss Check", "unknown", "CWE-79"),
    ("code-injection-analyser-path_thing", "Code Injection Analyser Path Thing", "injection", "CWE-94"),
    ("code-xss-analyser-stored", "Code Xss Analyser Stored", "xss", "CWE-79"),
    ("go.", "Go.", "unknown", "CWE-1000"),
])
def test_names(spark, check_id, title, kind, cwe):
    row = spark.range(1).select(ff.clean_title(F.lit(check_id)).alias("t"), ff.agent_type(F.lit(check_id)).alias("k"), ff.cwe_of(F.lit(check_id)).alias("c")).first()
    if kind == "unknown" and "-" in check_id:
        kind = check_id.split("-")[1]
    assert (row.t, row.k, row.c) == (title, kind, cwe)


def test_rule_type(spark):
    rows = spark.createDataFrame([("python.lang.sql-injection",), ("plain",), ("a.b.",)], "c string")
    assert values(rows, ff.rule_type(F.col("c"))) == ["sql injection", "plain", ""]


@pytest.mark.parametrize("code, name", [
    ("def run(x):", "run(x):"), ("  async function go ( a )", "go"), ("x = 1", "unknown"), ("function  f(", "f"), ("undef x", "unknown"), ("a\n\tdef  g (", "g"), ("", "unknown")])
def test_function_name(spark, code, name):
    assert spark.range(1).select(ff.function_name(F.lit(code)).alias("n")).first().n == name


@pytest.mark.parametrize("original, fixed, ok", [
    ("x", "", False), ("x", " \n ", False), ("x = 1", "  x = 1 ", False), ("x", "// a\n# b", False), ("x", "# a\ny = 2", True), ("x", "y", True), ("x", "\n\n  // a\n\n", False)])
def test_valid_fix(spark, original, fixed, ok):
    assert spark.range(1).select(ff.is_valid_fix(F.lit(original), F.lit(fixed)).alias("v")).first().v is ok


@pytest.mark.parametrize("path, start, end, want", [
    ("src/a.py", 3, 3, "https://h/o/r/blob/main/src/a.py#L3"), ("src/a.py", 3, 5, "https://h/o/r/blob/main/src/a.py#L3-L5"),
    ("/tmp/temp-77/repo/src/a.py", 1, 1, "https://h/o/r/blob/main/src/a.py#L1"), ("/tmp/temp-77/repo", 1, 1, "https://h/o/r/blob/main//tmp/temp-77/repo#L1")])
def test_deep_link(spark, path, start, end, want):
    for target in ("https://h/o/r", "https://h/o/r/", "https://h/o/r.git"):
        assert spark.range(1).select(paths.deep_link(F.lit(target), F.lit(path), F.lit(start), F.lit(end)).alias("u")).first().u == want


def test_metadata(spark):
    df = spark.createDataFrame([({"cwe": "CWE-1", "x": "y"},), ({},)], "m map<string,string>")
    assert [tuple(r.t) for r in df.select(ff.cwe_owasp(F.col("m")).alias("t")).collect()] == [("CWE-1", ""), ("", "")]


def test_secret_predicates(spark):
    df = spark.createDataFrame([("a", "leaked PASSWORD"), ("code-auth-x", None), ("b", "fine"), (None, None)], "c string, m string")
    assert values(df, ff.is_secret_finding(F.col("c"), F.col("m"))) == [True, True, False, False]
    assert values(spark.createDataFrame([("API_key_exposure",), ("key",)], "t string"), ff.is_secret_type(F.col("t"))) == [True, False]


TEXT = "\n".join(f"line {i}" for i in range(1, 31))


def brute_marked(s, e, n=10):
    lines = TEXT.split("\n")
    return "\n".join(f"{'>>> ' if s <= i + 1 <= e else '    '}{i + 1:4d}: {lines[i]}" for i in range(max(0, s - n), min(len(lines), e + n)))


def brute_numbered(s, e, n):
    lines = TEXT.split("\n")
    return "\n".join(f"{i:4d}: {lines[i - 1]}" for i in range(max(1, s - n), min(len(lines), e + n) + 1))


@pytest.mark.parametrize("s, e", [(1, 1), (5, 8), (15, 15), (29, 30), (30, 30), (0, 3), (31, 31), (4, 2), (10, 99)])
def test_contexts(spark, files_of, s, e):
    files = files_of({"r": {"a.py": TEXT}})
    finding = spark.createDataFrame([("r", "a.py", s, e), ("r", "gone.py", s, e)], "repo string, path string, start_line int, end_line int")
    valid = 1 <= s <= e <= 30
    numbered = content.numbered_context(finding, files, 3).collect()
    assert len(numbered) == 1
    assert numbered[0].vulnerable_code == ("\n".join(TEXT.split("\n")[s - 1:e]) if valid else "")
    if valid:
        assert numbered[0].context == brute_numbered(s, e, 3)
    marked = content.marked_context(finding, files).collect()
    assert [r.context for r in marked] == ([brute_marked(s, e)] if valid else [])
    assert len(content.fix_context(finding, files).collect()) == int(valid)


def test_long_line_numbers_are_not_cut(spark):
    lines = F.transform(F.sequence(F.lit(1), F.lit(12000)), lambda i: F.lit("x"))
    got = spark.range(1).select(text.numbered_context(lines, F.lit(11000), F.lit(11000), 0).alias("c")).first().c
    assert got == "11000: x"


def test_keep_first_and_report_dedup(spark):
    df = spark.createDataFrame([("l", 1, 2, "t", 3), ("l", 1, 2, "t", 1), ("l", 1, 3, "t", 2)], "link string, start_line int, end_line int, title string, seq int")
    assert sorted(r.seq for r in dedup.dedup_report(df, ["seq"]).collect()) == [1, 2]


def test_validation_filter_keeps_unvalidated(spark):
    df = spark.createDataFrame([(1, True, 0.9), (2, True, 0.69), (3, True, 0.7), (4, False, 0.99), (5, None, None)], "id int, is_legitimate boolean, validation_confidence double")
    assert sorted(r.id for r in filters.apply_validation(df).collect()) == [1, 3, 5]
    assert filters.apply_validation(df, enabled=False).count() == 5
    s = metrics.validation_summary(filters.mark_filtered(df.withColumn("repo", F.lit("r")))).first()
    assert (s.total, s.legitimate, s.filtered, s.false_positive_rate) == (5, 3, 2, 40.0)


def test_fix_gates(spark):
    df = spark.createDataFrame([(0.49,), (0.5,), (0.79,), (0.8,)], "confidence double")
    assert [r.gate for r in filters.gate_fixes(df).collect()] == ["rejected", "skipped", "skipped", "accepted"]


def test_agent_order(spark):
    df = spark.createDataFrame([(i, n) for n, i in enumerate(["LOW", "CRITICAL", "HIGH", "INFO", "MEDIUM", "high"])], "impact string, start_line int")
    df = df.withColumns({"path": F.lit("p"), "check_id": F.lit("c")})
    assert [r.impact for r in ranking.sort_agent_findings(df).collect()] == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "high"]
    assert [r.impact for r in ranking.sort_agent_findings(df, compat=True).collect()] == ["HIGH", "MEDIUM", "LOW", "CRITICAL", "INFO", "high"]


def test_type_order(spark):
    df = spark.createDataFrame([("b", "LOW"), ("a", "LOW"), ("c", "HIGH"), ("d", "LOW"), ("d", "LOW")], "title string, severity string")
    df = df.withColumns({"repo": F.lit("r"), "path": F.lit("p"), "start_line": F.lit(1)})
    assert [r.title for r in ranking.type_order(df).orderBy("position").collect()] == ["d", "c", "a", "b"]


def test_display_order(spark):
    df = spark.createDataFrame([("LOW", 2), ("HIGH", 1), ("INFO", 0)], "severity string, n int")
    assert [(r.severity, r.position) for r in ranking.display_severities(df).orderBy("position").collect()] == [("HIGH", 2), ("LOW", 4)]


def test_merge_ranges(spark):
    df = spark.createDataFrame([(1, 3), (2, 2), (4, 5), (9, 9), (8, 12), (20, 21)], "start_line int, end_line int").withColumns({"repo": F.lit("r"), "path": F.lit("p")})
    got = lambda gap: sorted((r.start_line, r.end_line, r.n_findings) for r in ranking.merge_ranges(df, gap).collect())
    assert got(0) == [(1, 3, 2), (4, 5, 1), (8, 12, 2), (20, 21, 1)]
    assert got(1) == [(1, 5, 3), (8, 12, 2), (20, 21, 1)]
    assert got(3) == [(1, 12, 5), (20, 21, 1)]


def test_agent_scopes(spark):
    df = spark.createDataFrame([("src/a.py",), ("test/a.py",), ("a_test.py",), ("lib/a.c",), ("x.vue",)], "path string")
    got = {(r.path, r.agent.split("-")[1]) for r in filters.scope_files(df).collect()}
    assert ("src/a.py", "injection") in got and ("test/a.py", "injection") not in got and ("a_test.py", "injection") not in got
    assert ("a_test.py", "auth") in got and ("lib/a.c", "race") in got and ("lib/a.c", "xss") not in got and ("x.vue", "xss") in got


def test_dimension_sizes():
    assert len(dims.LANGUAGE_BY_EXTENSION) == 28 and len(dims.HIGHLIGHT_BY_EXTENSION) == 29 and len(dims.SECRET_DISPLAY_NAMES) == 29
    assert len(dims.AGENT_TYPES) == len(dims.RUN_PHASES) == 8 and len(dims.AGENT_STATUSES) == 5 and len(dims.KEY_FILE_NAMES) == 14
