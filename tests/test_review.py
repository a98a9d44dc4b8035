"""Reports, replies, prompts, model calls and fixes."""

import json

import pytest
from pyspark.sql import functions as F

from riskloom.checks import all_queries
from riskloom.functions import text
from riskloom.operators import fixes
from riskloom.plans import review, scans
from riskloom.sources import files as sources
from riskloom.sources import reports, tables

FINDING = {"check_id": "a.b", "path": "x.py", "start": {"line": 1, "col": 1}, "end": {"line": 2, "col": 3}, "extra": {"message": "m", "lines": "\n  x = 1\n", "metadata": {"impact": "high"}}}
REPLY = {"agent_id": "a", "analysis_type": "t", "files_analyzed": [], "vulnerabilities": [
    {"type": "sqli", "file": "f.py", "line_start": 3, "line_end": 4, "severity": "HIGH", "confidence": 0.9, "description": "d", "vulnerable_code": "def f(", "secure_fix": "s", "fix_explanation": "e"}], "patterns": []}


def test_scanner_reports(spark, tmp_path):
    docs = {"clean": json.dumps({"results": [FINDING, FINDING], "errors": []}), "noisy": "log {\n".replace("{", "") + json.dumps({"results": [FINDING], "errors": [{"type": "Syntax", "level": "warn", "message": "bad", "code": 3, "path": "z"}]}) + "\nbye",
            "none": "nothing", "broken": '{"results": [{"check_id": '+ "}"}
    for name, body in docs.items():
        (tmp_path / f"{name}.json").write_text(body)
    found, errors = reports.scan_sast_json(spark, str(tmp_path))
    name = F.regexp_extract("source", r"([a-z]+)\.json$", 1)
    assert sorted(r.s for r in found.select(name.alias("s")).collect()) == ["clean", "clean", "noisy"]
    assert sorted((r.s, r.type) for r in errors.select(name.alias("s"), "type").collect()) == [("broken", "ParseError"), ("noisy", "Syntax")]
    norm = reports.to_vulnerabilities(found).first()
    assert (norm.severity, norm.norm_confidence, norm.code_line) == ("HIGH", 0.9, "x = 1")


def test_secret_reports(spark, tmp_path):
    rows = [{"level": "info", "msg": "start"}, {"DetectorName": "AWSKey", "Verified": True, "Redacted": "a", "SourceMetadata": {"Data": {"Filesystem": {"file": "f", "line": 3}}}},
            {"DetectorName": "x_y", "SourceMetadata": {"Data": {"Git": {"file": "g", "line": 4}}}}, {"DetectorName": "z", "SourceMetadata": {"Data": {}}}, {"DetectorName": "", "SourceMetadata": {"Data": {}}}]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = sorted((r.path, r.line, r.secret_type, r.verified) for r in reports.scan_secret_jsonl(spark, str(tmp_path)).collect())
    assert got == [("", 0, "Z", False), ("f", 3, "AWS Access Key", True), ("g", 4, "X Y", False)]


def envelopes():
    body = json.dumps(REPLY)
    fenced = f"Here:\n```json\n{body}\n```"
    return {"result": json.dumps({"type": "r", "result": fenced}), "content": json.dumps({"result": "", "content": body}),
            "messages": json.dumps({"messages": [{"content": [{"text": fenced}]}]}), "raw": fenced, "bad": body[:-4], "empty": "no json"}


def test_agent_results(spark, tmp_path):
    for agent, reply in envelopes().items():
        (tmp_path / agent).mkdir()
        (tmp_path / agent / "results.json").write_text(reply)
    (tmp_path / "missing").mkdir()
    got = reports.scan_agent_results(spark, str(tmp_path)).collect()
    assert sorted(r.agent_id for r in got) == ["content", "messages", "raw", "result"]
    assert {(r.type, r.line_start, r.confidence) for r in got} == {("sqli", 3, 0.9)}


def test_unwrap_and_payload(spark):
    df = spark.createDataFrame([('{"result": "a"}',), ('{"content": "b"}',), ('{"x": 1}',), ("plain {1} x } y",), ("none",)], "t string")
    got = [(r.u, r.p) for r in df.select(text.unwrap_reply(F.col("t")).alias("u"), text.json_payload(F.col("t")).alias("p")).collect()]
    assert got == [("a", '{"result": "a"}'), ("b", '{"content": "b"}'), ('{"x": 1}', '{"x": 1}'), ("plain {1} x } y", "{1} x }"), ("none", None)]


def test_parse_validations(spark):
    ok = json.dumps({"is_legitimate": True, "confidence": 0.8, "reasoning": "r"})
    df = spark.createDataFrame([("1", "text " + ok), ("2", "none"), ("3", '{"is_legitimate": tru}'), ("4", None)], "prompt_id string, reply string")
    got = review.parse_validations(df).collect()
    assert [(r.prompt_id, r.is_legitimate, r.confidence) for r in got] == [("1", True, 0.8)]


def test_parse_fixes(spark):
    make = lambda c: json.dumps({"vulnerability": "v", "severity": "s", "fix": "f", "explanation": "e", "confidence": c})
    df = spark.createDataFrame([("1", make(0.9)), ("2", make(0.4)), ("3", "sorry"), ("4", make(0.5))], "prompt_id string, reply string").withColumns({"check_id": F.lit("c"), "impact": F.lit("HIGH")})
    got = {r.prompt_id: (r.vulnerability, r.confidence, r.manual) for r in review.parse_fixes(df).collect()}
    assert got == {"1": ("v", 0.9, False), "3": ("c", 0.6, True), "4": ("v", 0.5, False)}


def test_model_calls_retry_and_keep_every_prompt(spark):
    def make_flaky():
        calls = {"n": 0}

        def complete(prompts):
            calls["n"] += 1
            if calls["n"] == 1:
                raise RuntimeError("first call fails")
            if any("boom" in p for p in prompts):
                raise RuntimeError("boom")
            return [review.Reply(p.upper(), len(p), 1) for p in prompts]
        return complete

    df = spark.createDataFrame([(str(i), "boom" if i == 7 else f"p{i}") for i in range(40)], "prompt_id string, prompt string").repartition(3)
    got = {r.prompt_id: r for r in review.infer(df, make_flaky, batch=8, retries=1).collect()}
    assert len(got) == 40 and got["7"].reply is None and "boom" in got["7"].error
    assert all(got[str(i)].reply == f"P{i}" and got[str(i)].input_tokens == len(f"p{i}") for i in range(40) if i != 7)


def test_validation_stage(spark, files_of):
    files = files_of({"r": {"a.py": "\n".join(f"l{i}" for i in range(50)), "package.json": '{"dependencies": {"express": "1", "helmet": "2"}}'}})
    rows = [("r", "a.py", n, n, f"c{n}", "HIGH", "m") for n in range(1, 9)] + [("r", "a.py", 99, 99, "outside", "HIGH", "m")]
    findings = spark.createDataFrame(rows, "repo string, path string, start_line int, end_line int, check_id string, impact string, message string")

    def client():
        def complete(prompts):
            out = []
            for p in prompts:
                n = int(p.split("Rule: c")[1].split("\n")[0])
                out.append("?" if n == 1 else json.dumps({"is_legitimate": n % 2 == 0, "confidence": 0.6 if n == 2 else 0.9}))
            return out
        return complete
    context = review.repo_context(files)
    kept = review.validate_stage(findings, files, context, client)
    assert sorted(r.check_id for r in kept.collect()) == ["c1", "c4", "c6", "c8", "outside"]
    prompt = review.validation_prompts(findings, files, context).first().prompt
    assert "Express Helmet" in prompt and "helmet" in prompt and ">>> " in prompt


def test_apply_fixes_matches_brute_force(spark, files_of):
    lines = [f"l{i}" for i in range(1, 21)]
    files = files_of({"r": {"a": "\n".join(lines), "b": "x"}})
    todo = [("r", "a", 2, 3, "A\nB\nC", 0.9), ("r", "a", 3, 4, "loses", 0.5), ("r", "a", 10, 10, "", 0.9), ("r", "a", 18, 20, "end", 0.9), ("r", "a", 19, 25, "bad", 1.0)]
    df = spark.createDataFrame(todo, "repo string, path string, start_line int, end_line int, fixed_code string, confidence double")
    want = list(lines)
    for s, e, code in [(18, 20, "end"), (10, 10, ""), (2, 3, "A\nB\nC")]:
        want[s - 1:e] = code.split("\n")
    got = {r.path: (r.content, r.n_fixes) for r in fixes.apply_fixes(files, df, untouched=True).collect()}
    assert got == {"a": ("\n".join(want), 3), "b": ("x", 0)}


def test_change_summary_parts(spark):
    df = spark.createDataFrame([("r", f"f{i}", i, i + 1, "v", "d") for i in range(7)], "repo string, path string, start_line int, end_line int, vulnerability string, description string")
    parts = fixes.change_summary(df, ["path"], size=3).orderBy("part").collect()
    assert [r.part for r in parts] == [1, 2, 3] and all("(7 vulnerabilities)" in r.title for r in parts)
    assert sum(r.body.count("**v**") for r in parts) == 7 and parts[2].body.endswith("7. **v** in `f6` (lines 6-7)\n   - d")


def test_agent_prompt_parts(spark, files_of):
    files = files_of({"r": {f"src/a{i}.py": "x" for i in range(5)}})
    routes = files.select("repo", "path").withColumn("agent", F.lit("code-path-analyser"))
    got = review.agent_prompts(routes, review.repo_context(files), size=2).orderBy("part").collect()
    assert [r.n_files for r in got] == [2, 2, 1] and len({r.prompt_id for r in got}) == 3
    assert "Path traversal" in got[0].prompt and "- src/a0.py\n- src/a1.py" in got[0].prompt


def test_enhance(spark):
    found = review.to_findings(spark.createDataFrame([("r", "code-xss-analyser", "stored", "f.py", 1, 2, "HIGH", 0.456, "d", "function show(", "s", "e")],
        "repo string, agent string, type string, file string, line_start int, line_end int, severity string, confidence double, description string, vulnerable_code string, secure_fix string, fix_explanation string"))
    row = review.enhance(found.withColumn("vuln_id", F.lit("VULN-0001"))).first()
    assert (row.type, row.cwe_id, row.confidence, row.location.function, row.exploit_example) == ("xss", "CWE-79", "0.46", "show", "<script>alert('XSS')</script>")
    assert found.first().check_id == "code-xss-analyser-stored" and found.first().end_col == 100


def test_files_are_written_and_found_again(spark, tmp_path):
    """A file is put where it is read, without a committer that renames a folder for each."""
    rows = [("r", f"src/d{i}/f.py", f"text {i} é\n") for i in range(60)] + [("s", "a.py", "x")]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    assert sources.write_files(files.repartition(3), str(tmp_path / "out")) == 61
    assert sources.write_files(files.where("repo = 's'"), str(tmp_path / "out")) == 1
    found = sources.scan_files(spark, str(tmp_path / "out")).select("repo", "path", "content").collect()
    assert sorted(map(tuple, found)) == sorted(rows)
    for repo, path, content in [("r", "../out.py", "x"), ("..", "a", "x"), ("r/../..", "a", "x"), ("r", "a", None)]:
        with pytest.raises(Exception, match="no file can be written"):
            sources.write_files(spark.createDataFrame([(repo, path, content)], files.schema), str(tmp_path / "out"))
    assert sources.write_files(files.limit(0), str(tmp_path / "none")) == 0


def test_small_files_are_read_by_few_tasks(spark, tmp_path):
    """1,800 files of some bytes each, where Spark takes 32 to a task beside the cores; what is read is the same."""
    rows = [(f"r{i % 3}", f"a/b{i}/c.txt" if i % 2 else f"c{i}.txt", f"text {i}") for i in range(1800)]
    files = spark.createDataFrame(rows, "repo string, path string, content string").repartition(4)
    assert sources.write_files(files, str(tmp_path / "out")) == 1800
    found = sources.scan_files(spark, str(tmp_path / "out"))
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted((r.repo, r.path, r.content) for r in found.collect()) == sorted(rows)


def test_files_on_disk_of_odd_sources(spark, tmp_path):
    docs = [(1, "a/b", "x"), (2, "a=b c", "y\n"), (3, "é%2F", ""), (4, "plain", "z")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = all_queries()["files_on_disk"](spark, str(tmp_path)).collect()
    size = {(source, f"folder=d{i}", "file"): len(text) + 1 for i, source, text in docs}
    assert {(r.repo, r.folder, r.type): r.size for r in got} == size | {(*k[:2], "dir"): 0 for k in size}


def test_scan_files_targets_and_tables(spark, tmp_path):
    (tmp_path / "src" / "one" / "lib").mkdir(parents=True)
    (tmp_path / "src" / "one" / "lib" / "a.py").write_text("x = 'é'\n")
    (tmp_path / "src" / "two").mkdir()
    (tmp_path / "src" / "two" / "README.md").write_text("doc")
    files = sources.scan_files(spark, str(tmp_path / "src"))
    assert {(r.repo, r.path, r.content) for r in files.collect()} == {("one", "lib/a.py", "x = 'é'\n"), ("two", "README.md", "doc")}
    assert {(r.path, r.type) for r in sources.inventory(files).collect()} == {("lib/a.py", "file"), ("lib", "dir"), ("README.md", "file")}
    assert sources.doc_insights(files).first().relevance == 0.8
    assert "content" not in sources.scan_files(spark, str(tmp_path / "src"), with_content=False).columns
    (tmp_path / "t.txt").write_text("https://github.com/a/b\n\n# c\nnope\n")
    assert {(r.owner, r.valid) for r in sources.scan_targets(spark, str(tmp_path / "t.txt")).collect()} == {("a", True), (None, False)}
    tables.write_tables({"files": files}, str(tmp_path / "out"), {"files": ["repo"]})
    assert tables.read_table(spark, str(tmp_path / "out"), "files").count() == 2


@pytest.mark.parametrize("mode", ["standard", "orchestrated"])
def test_whole_scans(spark, files_of, mode):
    files = files_of({"r": {"app.py": "q = request.args.get('q')\ncur.execute(\"select a from t where b='\" + q)\npassword = 'correct-horse'", "node_modules/x.js": "eval(x)", "auth/login.py": "pickle.loads(b)"}})
    out = {name: df.collect() for name, df in scans.scan(files, mode).items()}
    ids = {r.check_id for r in out["findings"]}
    assert "code-injection-analyser-sql_execute_concat" in ids
    if mode == "standard":
        assert all(not r.path.startswith("node_modules") for r in out["findings"]) and len(out["secrets"]) == 1
        assert out["profiles"][0].primary_language == "Python"
    else:
        assert [(r.source_line, r.sink_line, r.sink_type) for r in out["data_flows"]] == [(1, 2, "database_query")]
        assert out["vulnerabilities"][0].vuln_id.startswith("VULN-")


def test_replies_are_read_once(spark):
    replies = spark.createDataFrame([("a", '{"vulnerabilities": [null, {"type": "x"}], "patterns": []}'), ("b", "{]}"), ("c", "none"), ("d", None)], "agent_id string, reply string")
    found, patterns, errors = reports.parse_agent_replies(replies), reports.agent_patterns(replies), reports.reply_errors(replies)
    assert {(r.agent_id, r.type) for r in found.collect()} == {("a", None), ("a", "x")} and patterns.collect() == []
    assert sorted((r.agent_id, r.reason) for r in errors.collect()) == [("b", "broken JSON"), ("c", "no JSON object"), ("d", "no JSON object")]
    for df, n in ((found, 2), (patterns, 2), (errors, 1)):      # the envelope, and the document
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == n
