"""Functions around lines: nested ones, one-liners, strings and comments, indentation, unclosed ones, odd input."""

from pyspark.sql import functions as F

from riskloom.operators import scopes


def spans(files_of, code, path="a.js"):
    return sorted((r.name, r.start_line, r.end_line) for r in scopes.scopes(files_of({"r": {path: code}})).collect())


def around(spark, files_of, code, places, path="a.js"):
    found = spark.createDataFrame([("r", path, n) for n in places], "repo string, path string, start_line int")
    rows = scopes.enclosing_functions(found, files_of({"r": {path: code}})).collect()
    return sorted((r.start_line, r.function, r.function_start, r.function_end) for r in rows if r.start_line is not None)


def test_nested_functions(spark, files_of):
    code = "x()\nfunction a(p) {\n  if (p) {\n    y()\n  } else {\n    z()\n  }\n  function b()\n  {\n    c()\n  }\n  d()\n}\ne()"
    assert spans(files_of, code) == [("a", 2, 13), ("b", 8, 11)]
    assert around(spark, files_of, code, [1, 2, 6, 8, 10, 11, 12, 13, 14, 99]) == [
        (1, "unknown", None, None), (2, "a", 2, 13), (6, "a", 2, 13), (8, "b", 8, 11), (10, "b", 8, 11), (11, "b", 8, 11),
        (12, "a", 2, 13), (13, "a", 2, 13), (14, "unknown", None, None), (99, "unknown", None, None)]


def test_one_line_and_no_body(files_of):
    assert spans(files_of, "fn one() { two() }\nfn head();\nfn three() {\n}\npub fn four(\n  a: i32,\n) {\n  b()\n}", "a.rs") == [
        ("four", 5, 9), ("one", 1, 1), ("three", 3, 4)]


def test_strings_and_comments_hold_no_braces(files_of):
    assert spans(files_of, "func (s *S) Run() {\n  a := \"}\"\n  // }\n  b := '{'\n}\nfunc Next() {\n}", "a.go") == [("Next", 6, 7), ("Run", 1, 5)]


def test_indentation(spark, files_of):
    code = "def a(x):\n    y = {\n1: 2}\n\n    def b(z):\n        # note\n        q()\n\n    w()\nv()\nclass K:\n\tasync def m(self):\n\t\tu()"
    assert spans(files_of, code.replace("\n1: 2}", "\n      1: 2}"), "a.py") == [("a", 1, 9), ("b", 5, 8), ("m", 12, 13)]
    assert spans(files_of, code, "a.py") == [("a", 1, 2), ("b", 5, 8), ("m", 12, 13)]
    assert around(spark, files_of, code.replace("\n1: 2}", "\n      1: 2}"), [7, 9, 10, 13], "a.py") == [
        (7, "b", 5, 8), (9, "a", 1, 9), (10, "unknown", None, None), (13, "m", 12, 13)]


def test_unclosed_and_odd_input(spark, files_of):
    assert spans(files_of, "function a() {\n  b(\n  c") == [("a", 1, 3)]
    assert spans(files_of, "}\n}\nfunction a() {\n}\n}") == [("a", 3, 4)]
    assert spans(files_of, "") == []
    files = files_of({"r": {"a.js": "function a() {\n}"}})
    assert scopes.enclosing_functions(spark.createDataFrame([], "repo string, path string, start_line int"), files).collect() == []
    blank = spark.createDataFrame([("r", "a.js", None), ("r", "gone.js", 1), ("r", "a.js", 1), ("r", "a.js", 1)],
                                  "repo string, path string, start_line int")
    assert sorted(r.function for r in scopes.enclosing_functions(blank, files).collect()) == ["a", "a", "unknown", "unknown"]


def test_a_long_file_and_a_hot_one(spark, files_of):
    code = "function outer() {\n" + "".join(f"  function f{i}() {{\n    g()\n  }}\n" for i in range(3000)) + "}"
    found = spark.range(9003).selectExpr("'r' as repo", "'a.js' as path", "cast(id + 1 as int) as start_line")
    rows = scopes.enclosing_functions(found.union(found), files_of({"r": {"a.js": code}}))
    by_name = {r.function: r["count"] for r in rows.groupBy("function").count().collect()}
    assert len(by_name) == 3002 and by_name["f17"] == 6 and by_name["outer"] == 4 and by_name["unknown"] == 2


def test_small_contents_with_many_lines_are_not_put_together(spark, files_of):
    files = files_of({"r": {f"f{i}.js": "function a() {\n  x\n}\n" * 50 for i in range(200)}})
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = files.select("repo", "path", F.lit(2).alias("start_line"))
    plan = scopes.enclosing_functions(found, files)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(path" in plan and "REPARTITION_BY_NUM" in plan
    assert scopes._dealt(files).rdd.getNumPartitions() == n and scopes.scopes(files).count() == 200 * 50
