"""Flows through variables: long ones, broken ones, replaced values, several sources, odd input."""

from riskloom.operators import flows, matching


def flows_of(files_of, code, path="a.py"):
    files = files_of({"r": {path: code}})
    rows = flows.variable_flows(files, matching.code_points(files)).collect()
    return sorted((r.source_line, r.sink_line, r.sink_type, r.steps) for r in rows)


def test_a_flow_over_five_assignments(files_of):
    code = "a = request.args['q']\nb = a + 1\nlet c = f(b)\nString d = c.trim()\ne := d\ng += e\nother = 1\ndb.query(g)"
    assert flows_of(files_of, code) == [(1, 8, "database_query", 6)]


def test_controls_and_replaced_values_break_a_flow(files_of):
    assert flows_of(files_of, "a = request.args['q']\nb = validate(a)\ndb.query(b)") == []
    assert flows_of(files_of, "a = request.args['q']\na = 'fixed'\ndb.query(a)") == []
    assert flows_of(files_of, "a = request.args['q']\ndb.query(escape(a))") == []
    assert flows_of(files_of, "a = request.args['q']\nb = 'a'\ndb.query(b, \"a\")") == []
    assert flows_of(files_of, "db.query(a)\na = request.args['q']") == []
    assert flows_of(files_of, "if a == request.args['q']:\ndb.query(a)") == []


def test_the_nearest_source_counts(files_of):
    code = "a = request.args['q']\nb = sys.argv[1]\nc = a + b\nb = 0\ndb.query(c)\neval(request.form['x'])\nos.system(a)"
    assert flows_of(files_of, code) == [(1, 7, "command_execution", 1), (2, 5, "database_query", 2), (6, 6, "code_evaluation", 0)]


def test_a_value_that_feeds_itself(files_of):
    assert flows_of(files_of, "a = sys.argv[1]\n" + "a = a + a\n" * 30 + "eval(a)") == [(1, 32, "code_evaluation", 31)]


def test_variables_stay_in_their_file(spark, files_of):
    files = files_of({"r": {"a.py": "a = sys.argv[1]", "b.py": "eval(a)"}, "s": {"a.py": "eval(a)\n", "c.py": ""}})
    assert flows.variable_flows(files, matching.code_points(files)).collect() == []
    none = files.limit(0)
    assert flows.variable_flows(none, matching.code_points(none)).collect() == []
    blank = spark.createDataFrame([("r", "x", "file", 0, None)], files.schema)
    assert flows.variable_flows(blank, matching.code_points(blank)).collect() == []
