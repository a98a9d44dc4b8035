"""Rules, secrets, pages and data flow on small files, checked against plain Python."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.functions import findings as ff
from riskloom.operators import matching
from riskloom.rule_catalog import ALL_RULES, CODE_POINTS, SECRET_DETECTORS, Rule

SAMPLES = {
    "a.py": "import os\nos.system('x ' + y)\nyaml.load(f)\nyaml.load(f, Loader=SafeLoader)\nhashlib.md5(b)\n@app.route('/a')\n@app.route('/b')  # login_required\npassword = 'correct-horse'",
    "b.js": "el.innerHTML = x;\neval(code)\nMath.random()\nkey = 'abcdefghij0123456789'",
    "c.java": "Statement s; s.executeQuery(\"select a from t where b=\" + c)\nnew Random().nextInt()",
    "d.go": "import \"math/rand\"\nexec.Command(x)",
    "e.txt": "nothing to see\n\n",
    "f.html": "<a>{{ x|safe }}</a>\r\n<p>v-html</p>",
}
LANG = {"py": "Python", "js": "JavaScript", "java": "Java", "go": "Go"}


@pytest.fixture(scope="module")
def files(files_of):
    return files_of({"r": SAMPLES})


def expected(rules):
    out = set()
    for path, content in SAMPLES.items():
        language = LANG.get(path.rsplit(".", 1)[1])
        for n, line in enumerate(content.split("\n"), start=1):
            for r in rules:
                if r.languages and language not in r.languages:
                    continue
                if re.search(r.regex, line) and not (r.not_regex and re.search(r.not_regex, line)):
                    out.add((path, n, r.rule_id))
    return out


def test_rules_match_brute_force(files):
    got = {(r.path, r.start_line, r.check_id) for r in matching.match_rules(files).collect()}
    assert got == expected(ALL_RULES)
    assert ("a.py", 3, "code-deserial-analyser-yaml_load") in got and ("a.py", 4, "code-deserial-analyser-yaml_load") not in got


def test_user_rules_from_a_table(spark, files):
    rules = [Rule("mine", "me", (), r"rand", r"Random", "LOW", "CWE-1"), Rule("py-only", "me", ("Python",), r"o", None, "LOW", "CWE-1")]
    frame = spark.createDataFrame([(r.rule_id, r.agent, list(r.languages), r.regex, r.not_regex, r.impact, r.cwe) for r in rules],
                                  "rule_id string, agent string, languages array<string>, regex string, not_regex string, impact string, cwe string")
    got = {(r.path, r.start_line, r.check_id) for r in matching.match_rules(files, frame).collect()}
    assert got == expected(rules)


def test_many_rules(files):
    rules = [Rule(f"r{i}", "x", (), rf"{w}", None, "LOW", "CWE-1") for i, w in enumerate(["os", "el", "new", "zzz"] * 100)]
    assert matching.match_rules(files, rules).count() == len(expected(rules))


@pytest.mark.parametrize("regex, needles", [(r.regex, r.needles) for r in ALL_RULES] + [(c[2], c[3]) for c in CODE_POINTS] + [(d[1], d[2]) for d in SECRET_DETECTORS])
def test_every_match_contains_a_needle(regex, needles):
    @settings(max_examples=25, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(regex))
    def check(text):
        found = re.search(regex, text)
        if found and text.isascii():
            assert any(n in found.group(0).lower() for n in needles)
    check()


def test_secrets(spark, files_of):
    files = files_of({"r": {"x": "a\ntoken = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" key='short'\nAKIA" + "ABCDEFGHIJKLMNOP", "y": "token = 'aaaaaaaaaaaaaaaaaaaa' token = 'bbbbbbbbbbbbbbbbbbbb'"}})
    got = sorted((r.path, r.line, r.detector, r.redacted[:6], len(r.redacted)) for r in matching.detect_secrets(files).collect())
    assert got == [("x", 2, "token", "24be**", 40), ("x", 3, "awskey", "AKIA**", 20), ("y", 1, "token", "aaaa**", 20), ("y", 1, "token", "bbbb**", 20)]
    strong = matching.detect_secrets(files, min_entropy=2.0).collect()
    assert {r.detector for r in strong} == {"token", "awskey"} and len(strong) == 2


def test_entropy(spark):
    df = spark.createDataFrame([("",), ("aaaa",), ("abcd",), ("aabb",)], "t string").select(ff.shannon_entropy(F.col("t")).alias("e"))
    assert [round(r.e, 6) for r in df.collect()] == [0.0, 0.0, 2.0, 1.0]


@pytest.mark.parametrize("detector, want", [
    ("AWSKey", "AWS Access Key"), ("github_token", "Token"), ("GithubToken", "GitHub Token"), ("my_odd thing", "My Odd Thing"), ("GCPServiceKey", "GCP Key"), ("SlackTokenV2", "Slack Token"),
])
def test_secret_names(spark, detector, want):
    assert spark.range(1).select(ff.secret_type(F.lit(detector)).alias("t")).first().t == want


def test_data_flow(spark, files_of):
    files = files_of({"r": {
        "a.py": "q = request.args.get('q')\nx = 1\ncur.execute(q)",
        "b.py": "q = request.args.get('q')\nq = sanitize(q)\ncur.execute(q)",
        "c.py": "q = request.args.get('q')\n" + "\n" * 30 + "cur.execute(q)",
        "d.py": "cur.execute(q)\nq = request.args.get('q')"}})
    got = {(r.path, r.source_line, r.sink_line, r.controlled) for r in matching.taint_pairs(matching.code_points(files), 20).collect()}
    assert got == {("a.py", 1, 3, False), ("b.py", 1, 3, True)}


def test_pages(spark):
    pages = spark.createDataFrame([(1, "<script>alert(1)</script><meta http-equiv='Content-Security-Policy'>"), (2, "<a href='x' onclick='y()'>z</a>")], "page_id int, html string")
    got = {(r.page_id, r.check_id) for r in matching.html_checks(pages).collect()}
    assert got == {(1, "inline_script"), (2, "missing_csp"), (2, "event_handler")}


@pytest.mark.parametrize("value, hit", [
    ("../../etc/passwd", True), ("..%2F..%2Fetc", True), ("..%252Fetc", True), ("....//x", True), ("..\\win", True), ("..%c0%afetc", True), ("..／etc", True),
    ("a/b..c", False), ("100%", False), ("%zz../x", True),
])
def test_traversal(spark, value, hit):
    df = spark.createDataFrame([(value,)], "v string")
    assert (matching.traversal_hits(df, "v").count() == 1) is hit


def test_magic(spark):
    df = spark.createDataFrame([(1, b"\xac\xed\x00\x05rest"), (2, b"\x80\x04x"), (3, b"BZh9"), (4, b"\x1f\x8b\x08"), (5, b"text"), (6, b"")], "id int, data binary")
    assert {r.id: r.format for r in matching.match_magic(df).collect()} == {
        1: "Java Serialization", 2: "Python Pickle Protocol 4", 3: "Bzip2 compressed (possible serialized)", 4: "Gzip compressed (possible serialized)"}
