"""The driver tables seen as files, findings, manifests, replies and so on.

Each view exists twice with the same meaning: as a DataFrame, and as a SQL text that is
put in front of the oracle queries that use it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.files import spread

# ---------------------------------------------------------------- shared texts
_FILE_PATH = """
 (case cast(doc_id % 10 as int) when 0 then 'src/auth/login_' when 1 then 'src/db/query_' when 2 then 'test/t_'
   when 3 then 'node_modules/m_' when 4 then 'src/view/v_' when 5 then 'config/c_' when 6 then 'src/upload/file_'
   when 7 then 'src/crypto/token_' when 8 then 'robin/x_' else 'src/' end) || cast(doc_id as varchar(20)) ||
 (case lang when 'en' then '.py' when 'fr' then '.js' when 'de' then '.java' when 'es' then '.go' else '' end)"""

_CHECK_ID = """'code-' || (case cast(l_linenumber % 5 as int) when 0 then 'injection' when 1 then 'xss' when 2 then 'path'
   when 3 then 'crypto' else 'auth' end) || '-analyser-' || lower(l_returnflag)"""

_IMPACT = """(case cast(l_orderkey % 6 as int) when 0 then 'HIGH' when 1 then 'MEDIUM' when 2 then 'LOW' when 3 then 'INFO'
   when 4 then 'CRITICAL' else '' end)"""

# Dotted rule ids, as a scanner gives them.
_DOTTED_ID = """(case cast(l_partkey % 8 as int) when 0 then 'python.lang.security.' when 1 then 'javascript.express.'
   when 2 then 'java.spring.audit.' when 3 then 'go.' when 4 then 'typescript.react.' when 5 then 'php.' when 6 then 'ruby.rails.'
   else '' end) || (case cast(l_linenumber % 4 as int) when 0 then 'sql-injection' when 1 then 'weak_crypto-md5'
   when 2 then 'path-traversal' else 'hardcoded-api_key' end)"""

_KIND = """(case cast(o_orderkey % 12 as int) when 0 then 'package.json' when 1 then 'requirements.txt' when 2 then 'pom.xml'
   when 3 then 'go.mod' when 4 then 'Gemfile' when 5 then 'composer.json' when 6 then 'App.jsx' when 7 then 'manage.py'
   when 8 then 'main.go' when 9 then 'index.ts' when 10 then 'config/app.php' else 'server.js' end)"""

_MANIFEST_PATH = f"""(case cast(o_orderkey % 5 as int) when 0 then '' when 1 then 'app/' else 'svc' || cast(o_orderkey as varchar(20)) || '/' end)
   || {_KIND}"""

_DEP1 = """(case cast(o_custkey % 6 as int) when 0 then 'react' when 1 then 'next' when 2 then 'vue' when 3 then '@angular/core'
   when 4 then 'express' else 'koa' end)"""
_DEP2 = """(case cast(o_custkey % 5 as int) when 0 then 'helmet' when 1 then 'mongodb' when 2 then 'webpack' when 3 then 'lodash'
   else 'jsonwebtoken' end)"""
_DEV = """(case cast(o_custkey % 4 as int) when 0 then 'typescript' when 1 then 'vite' when 2 then '@types/node' else 'react' end)"""
_VER = "cast(o_custkey % 9 as varchar(20))"

_MANIFEST_TEXT = f"""(case cast(o_orderkey % 12 as int)
   when 0 then '{{"name": "m", "dependencies": {{"' || {_DEP1} || '": "^' || {_VER} || '.0.0", "' || {_DEP2} || '": "1.2"}}, "devDependencies": {{"'
     || {_DEV} || '": "~2"}}' || (case when o_custkey % 7 = 0 then '' else '}}' end)
   when 1 then '# pinned' || chr(10) || (case cast(o_custkey % 4 as int) when 0 then 'Django==4.' when 1 then 'Flask>=2.' when 2 then 'flask-sqlalchemy<=2.'
     else 'FastAPI==0.' end) || {_VER} || chr(10) || chr(10) || (case cast(o_custkey % 3 as int) when 0 then 'psycopg2==2.9' when 1 then 'celery' else 'redis>=3' end) || chr(10)
   when 2 then '<project><artifactId>' || (case cast(o_custkey % 3 as int) when 0 then 'spring-boot-starter-web' when 1 then 'spring-security-core'
     else 'hibernate-core' end) || '</artifactId><artifactId>junit</artifactId></project>'
   when 3 then 'module x' || chr(10) || 'require github.com/gin-gonic/gin v1.' || {_VER} || chr(10) || chr(9) || 'github.com/gorilla/mux v1.' || {_VER} || chr(10) || ')'
     || (case when o_custkey % 2 = 0 then chr(10) || 'gorm.io/GORM v1' else '' end)
   when 4 then 'gem ''' || (case cast(o_custkey % 3 as int) when 0 then 'Rails' when 1 then 'sinatra' else 'devise' end) || '''' || chr(10) || 'gem ''rspec'''
   when 5 then '{{"require": {{"' || (case cast(o_custkey % 3 as int) when 0 then 'laravel/framework' when 1 then 'symfony/console' else 'doctrine/orm' end) || '": "^8"}}}}'
   else '// code' end)"""

_AGENT = """(case cast(o_orderkey % 5 as int) when 0 then 'code-injection-analyser' when 1 then 'code-xss-analyser'
   when 2 then 'code-path-analyser' when 3 then 'code-crypto-analyser' else 'code-auth-analyser' end)"""

# An analyser's answer about one order: two findings, or a broken document.
_AGENT_DOC = f"""'```json' || chr(10) || '{{"agent_id": "a' || cast(o_orderkey % 5 as varchar(20)) || '", "analysis_type": "' || {_AGENT}
   || '", "files_analyzed": ["f1"], "vulnerabilities": [{{"type": "' || (case cast(o_custkey % 3 as int) when 0 then 'sqli' when 1 then 'stored' else 'api_key_exposure' end)
   || '", "file": "src/p' || cast(o_custkey % 20 as varchar(20)) || '.py", "line_start": ' || cast(o_custkey % 40 + 1 as varchar(20)) || ', "line_end": '
   || cast(o_custkey % 40 + 3 as varchar(20)) || ', "severity": "' || (case cast(o_orderkey % 3 as int) when 0 then 'HIGH' when 1 then 'MEDIUM' else 'CRITICAL' end)
   || '", "confidence": 0.' || cast(o_custkey % 9 + 1 as varchar(20)) || ', "description": "hardcoded token in code", "vulnerable_code": "def handler(request):", '
   || '"exploit_example": "x", "secure_fix": "use a vault", "fix_explanation": "keeps it out"}}, {{"type": "weak", "file": "src/q.py", "line_start": 1, "line_end": 2, '
   || '"severity": "LOW", "confidence": 0.5, "description": "minor", "vulnerable_code": "x = 1", "exploit_example": "", "secure_fix": "", "fix_explanation": ""}}], '
   || '"patterns": [{{"pattern": "no validation", "instances": ["a:1", "b:2"], "recommendation": "add it"}}]' || (case when o_orderkey % 11 = 0 then '' else '}}' end)
   || chr(10) || '```'"""

_REPORT_TEXT = f"""(case when o_orderkey % 13 = 0 then 'no document here' else
   'INFO scan started' || chr(10) || '{{"results": [{{"check_id": "python.lang.sql-injection", "path": "src/p' || cast(o_custkey % 20 as varchar(20)) || '.py", "start": {{"line": '
   || cast(o_custkey % 40 + 1 as varchar(20)) || ', "col": 1}}, "end": {{"line": ' || cast(o_custkey % 40 + 2 as varchar(20)) || ', "col": 9}}, "extra": {{"message": "m' || o_orderstatus
   || '", "lines": "\\n  x = 1", "metadata": {{"impact": "' || (case cast(o_orderkey % 4 as int) when 0 then 'high' when 1 then 'CRITICAL' when 2 then 'LOW' else '' end)
   || '"}}}}}}, {{"check_id": "go.weak-crypto", "path": "a.go", "start": {{"line": 2, "col": 1}}, "end": {{"line": 2, "col": 5}}, "extra": {{"message": "w", "lines": "y", "metadata": {{}}}}}}], '
   || '"errors": [' || (case when o_orderkey % 3 = 0 then '{{"type": "Syntax", "level": "warn", "message": "bad", "code": 3, "path": "z.py"}}' else '' end) || ']'
   || (case when o_orderkey % 17 = 0 then '' else '}}' end) || chr(10) || 'done' end)"""

_SERVICE_TEXT = """'{"findings": [{"rule_id": "python.lang.exec", "path": "s' || cast(o_custkey % 20 as varchar(20)) || '.py", "message": "m", "severity": "'
   || (case cast(o_orderkey % 5 as int) when 0 then 'ERROR' when 1 then 'WARNING' when 2 then 'INFO' when 3 then 'NOTE' else 'ODD' end)
   || '", "start_line": ' || cast(o_custkey % 30 + 1 as varchar(20)) || ', "end_line": 40, "start_column": 1, "end_column": 2, "code": "exec(x)", "fix": "", "metadata": {'
   || (case when o_orderkey % 2 = 0 then '"cwe": "CWE-78", "owasp": "A03"' else '"cwe": "CWE-78"' end) || '}}], "errors": ["late"], "stats": {"files_scanned": 1, "rules_run": 2, "findings_count": 1, "duration": "1s"}}'"""

_SECRET_TEXT = """(case cast(event_id % 6 as int)
   when 0 then '{"level": "info", "msg": "scanning", "logger": "main"}'
   when 1 then '{"DetectorName": "' || d || '", "DetectorType": 1, "Verified": true, "Raw": "r", "Redacted": "ab**", "SourceMetadata": {"Data": {"Filesystem": {"file": "src/a'
     || cast(user_id % 20 as varchar(20)) || '.py", "line": ' || cast(user_id % 7 as varchar(20)) || '}}}, "ExtraData": {"k": "v"}}'
   when 2 then '{"DetectorName": "' || d || '", "DetectorType": 1, "Verified": false, "Raw": "r", "Redacted": "cd**", "SourceMetadata": {"Data": {"Git": {"commit": "c", "file": "src/b'
     || cast(user_id % 20 as varchar(20)) || '.go", "email": "e", "repository": "x", "timestamp": "t", "line": 4}}}}'
   when 3 then '{"DetectorName": "' || d || '", "Verified": true, "Redacted": "", "SourceMetadata": {"Data": {}}}'
   when 4 then '{"DetectorName": "", "Verified": true, "SourceMetadata": {"Data": {"Filesystem": {"file": "x", "line": 1}}}}'
   else '{"DetectorName": "' || d || '", "Verified": false, "Redacted": "ab**", "SourceMetadata": {"Data": {"Filesystem": {"file": "src/a1.py", "line": 1}}}}' end)"""
_DETECTOR = """(case cast(user_id % 8 as int) when 0 then 'AWSKey' when 1 then 'GithubToken' when 2 then 'my_custom thing' when 3 then 'SlackTokenV2'
   when 4 then 'PrivateKey' when 5 then 'MongoDBConn' when 6 then 'Tokenizer' else 'rest_api' end)"""

_URL = """(case cast(page_id % 9 as int) when 0 then 'https://github.com/own' || cast(page_id as varchar(20)) || '/repo-a.git' when 1 then 'git@github.com:team/re_po' || cast(page_id as varchar(20)) || '.git'
   when 2 then 'http://github.com/o/r.s/' when 3 then 'https://github.com/o/' when 4 then 'https://github.com/only' when 5 then '  # comment'
   when 6 then '' when 7 then 'https://gitlab.com/a/b' else '  ' || url end)"""

_TRAVERSAL = """(case cast(page_id % 8 as int) when 0 then '../../../etc/passwd' when 1 then '..%2F..%2Fetc' when 2 then '..%252F..%252Fetc'
   when 3 then '....//....//x' when 4 then '..' || chr(92) || 'windows' when 5 then '..%c0%afetc' when 6 then '..／..／etc' else 'plain/' end) || cast(page_id as varchar(20))"""

# Lines of code that the rules look for, by file extension. One is put below each document.
CODE_SAMPLES = (
    (".py", 'cursor.execute("SELECT * FROM users WHERE id = " + user_id)'), (".py", "os.system('ping ' + host)"),
    (".py", "subprocess.call(cmd, shell=True)"), (".js", "eval(input)"), (".py", "return render_template_string(page)"),
    (".java", 'stmt.executeQuery("SELECT a FROM t WHERE b=" + name)'), (".java", 'session.createQuery("from U where n=" + n)'),
    (".go", "out := exec.Command(name)"), (".js", "element.innerHTML = text;"), (".js", "document.write(text)"),
    (".js", "return <div dangerouslySetInnerHTML={{__html: t}} />"), (".py", "{{ user_input|safe }}"),
    (".py", "data = open(base + request.user).read()"), (".py", "zipfile.ZipFile(f).extractall()"),
    (".php", "include($_GET['page']);"), (".js", "fs.readFile(req.params.name, cb)"), (".java", "File f = new File(name);"),
    (".py", "digest = hashlib.md5(data)"), (".py", "cipher = AES.new(key, AES.MODE_ECB)"), (".py", "n = random.randint(1, 9)"),
    (".py", "ctx.verify_mode = ssl.CERT_NONE"), (".java", 'MessageDigest.getInstance("MD5")'), (".js", "crypto.createHash('md5')"),
    (".go", 'import "math/rand"'), (".py", "@app.route('/x')"), (".py", "@app.route('/y') # login_required"),
    (".py", "response.set_cookie('a', 'b')"), (".py", "response.set_cookie('a', 'b', secure=True)"), (".js", "const t = jwt.decode(s)"),
    (".py", "obj = pickle.loads(blob)"), (".py", "cfg = yaml.load(text)"), (".py", "cfg = yaml.load(text, Loader=SafeLoader)"),
    (".java", "new ObjectInputStream(in).readObject()"), (".php", "$o = unserialize($s);"), (".cs", "new BinaryFormatter().Read(s)"),
    (".java", "DocumentBuilderFactory.newInstance()"), (".py", "import xml.etree.ElementTree"), (".php", "simplexml_load_string($x)"),
    (".c", "if (stat(p, &s) == 0) fd = open(p, 0);"), (".py", "if os.path.exists(p): f = open(p)"),
    (".js", "await Promise.all(xs.map(x => out.push(x)))"), (".go", "go func() { global = 1 }()"),
    (".py", "aws = 'AKIA" + "ABCDEFGHIJ234567'"), (".py", "password = 'correct-horse-battery'"), (".js", "key = 'abcdefghij0123456789'"),
    (".py", "h = 'eyJhbGciOiJI" + ".eyJzdWIiOiIx" + ".c2lnbmF0dXJl'"), (".c", "-----BEGIN RSA " + "PRIVATE KEY-----"),
)


def _sample(column: int, sql: bool) -> str:
    values = ", ".join("'" + row[column].replace("'", "''") + "'" for row in CODE_SAMPLES)
    position = f"cast(doc_id % {len(CODE_SAMPLES)} as int) + 1"
    return f"list_extract([{values}], {position})" if sql else f"element_at(array({values}), {position})"


def _code_path(sql: bool) -> str:
    return ("(case cast(doc_id % 4 as int) when 0 then 'src/auth/login_' when 1 then 'src/db/query_' when 2 then 'lib/' else 'src/upload_' end)"
            f" || cast(doc_id as varchar(20)) || {_sample(0, sql)}")


def _code_text(sql: bool) -> str:
    return (f"text || chr(10) || (case when doc_id % 3 = 0 then '' else 'value = request.args.get(\"q\")' end) || chr(10) || {_sample(1, sql)}"
            " || chr(10) || (case when doc_id % 5 = 0 then 'value = validate(value)' else '' end) || chr(10) || 'db.query(value)'")


# Code that hands input on over up to six assignments; some files clean it, overwrite it or read it again on the way.
_FLOW_TEXT = """'a0 = request.args.get("q")' || chr(10) || (case when doc_id % 6 >= 1 then 'String a1 = wrap(a0, "a0")' else 'b1 = 1' end) || chr(10)
   || (case when doc_id % 6 >= 2 then 'a2 := a1 + suffix' else 'a1 == a0' end) || chr(10) || (case when doc_id % 11 = 0 then 'a2 = "fixed a0"' else '# ' || left(text, 20) end) || chr(10)
   || (case when doc_id % 6 >= 3 then 'const a3 = a2.trim()' else 'note(a0)' end) || chr(10) || (case when doc_id % 7 = 0 then 'a3 = sanitize(a3)' else 'c += a3' end) || chr(10)
   || (case when doc_id % 6 >= 4 then 'a4 = f(a3, a1)' else 'd = c' end) || chr(10) || (case when doc_id % 6 >= 5 then 'a5 = a4' else '' end) || chr(10)
   || (case when doc_id % 13 = 0 then 'a4 = sys.argv[1]' else 'e = d' end) || chr(10) || 'db.query(a' || cast(doc_id % 6 as varchar(20)) || ')' || chr(10)
   || (case cast(doc_id % 4 as int) when 0 then 'os.system(e)' when 1 then 'open(escape(a0))' when 2 then 'eval(request.form["x"])' else 'eval(c)' end)"""

# Functions in braces and by indentation: nested, on one line, in comments and strings, never closed.
_SCOPE_TEXT = """(case when doc_id % 2 = 0 then 'function outer' || cast(doc_id as varchar(20)) || '() {' || chr(10) || '  eval(a)' || chr(10)
   || (case cast(doc_id % 5 as int) when 0 then '  async function inner(x) { return eval(x) }' when 1 then '  function inner(x)' || chr(10) || '  {' || chr(10) || '    if (x) {' || chr(10) || '      eval(x)' || chr(10) || '    } else {' || chr(10) || '      eval("{")' || chr(10) || '    }' || chr(10) || '  }'
     when 2 then '  // function gone() {' || chr(10) || '  s = "}"' when 3 then '  function open() {' else '  function none()' end)
   || chr(10) || '  eval(b)' || chr(10) || '}' || chr(10) || 'eval(c)' || chr(10) || 'function last() {' || chr(10) || '  eval(d)' || chr(10) || '}' || chr(10) || 'eval(e)'
  else 'def outer(a):' || chr(10) || '    eval(a)' || chr(10)
   || (case cast(doc_id % 3 as int) when 0 then '    def inner' || cast(doc_id as varchar(20)) || '(b):' || chr(10) || '        eval(b)' || chr(10) || chr(10) || '# note' || chr(10) || '        eval(b)' when 1 then '    # def gone(d):' else '    def inner(b): return eval(b)' end)
   || chr(10) || '    eval(c)' || chr(10) || 'eval(d)' || chr(10) || 'class K:' || chr(10) || '    async def method(self):' || chr(10) || '        eval(self)' end)"""
_SCOPE_PATH = """'src/scope_' || cast(doc_id as varchar(20)) || (case when doc_id % 2 = 0 then '.js' else '.py' end)"""

# ---------------------------------------------------------------- SQL side
SQL_VIEWS = {
    "v_files": f"select source as repo, doc_id, text as content, n_chars as size, 'file' as type, lang, {_FILE_PATH} as path from documents",
    "v_code": f"select *, length(content) as size from (select source as repo, doc_id, {_code_path(True)} as path, {_code_text(True)} as content, 'file' as type from documents)",
    "v_flow_code": f"select source as repo, 'src/flow_' || cast(doc_id as varchar(20)) || '.py' as path, {_FLOW_TEXT} as content from documents",
    "v_scope_code": f"select source as repo, {_SCOPE_PATH} as path, {_SCOPE_TEXT} as content from documents",
    "v_findings": f"""select l_suppkey as repo, 'src/p' || cast(l_partkey % 20 as varchar(20)) || '.py' as path,
 cast(l_orderkey % 40 + 1 as int) as start_line, cast(l_orderkey % 40 + 1 + l_linenumber as int) as end_line,
 {_CHECK_ID} as check_id, {_IMPACT} as impact, l_quantity / 50 as confidence, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem""",
    "v_dotted": f"""select l_suppkey as repo, 'src/p' || cast(l_partkey % 20 as varchar(20)) || '.py' as path,
 cast(l_orderkey % 40 + 1 as int) as start_line, cast(l_orderkey % 40 + 1 + l_linenumber as int) as end_line,
 {_DOTTED_ID} as check_id, {_IMPACT} as impact, l_quantity / 50 as confidence, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem""",
    "v_places": "select repo, (case when doc_id % 50 = 49 then 'gone/' else '' end) || path as path, doc_id from v_files",
    "v_file_findings": f"""select f.repo, f.path, cast(l_linenumber as int) as start_line, cast(l_linenumber + l_orderkey % 3 as int) as end_line,
 {_CHECK_ID} as check_id, {_IMPACT} as impact, 'message ' || l_linestatus as message, l_quantity / 50 as confidence, l_orderkey, l_linenumber, l_partkey, l_suppkey
 from lineitem l join v_places f on l.l_partkey % (select count(*) from documents) = f.doc_id""",
    "v_validations": """select f.repo, f.path, l.quality = 1 as is_legitimate, cast(0.5 as double) + cast(0.1 as double) * (f.doc_id % 6) as validation_confidence
 from labels l join v_files f on f.doc_id = l.doc_id""",
    "v_manifests": f"""select 'r' || cast(o_custkey as varchar(20)) as repo, {_MANIFEST_PATH} as path, 'file' as type, {_MANIFEST_TEXT} as content,
 length({_MANIFEST_TEXT}) as size, o_orderkey, regexp_extract({_MANIFEST_PATH}, '([^/]*)$', 1) as base from orders""",
    "v_replies": "select conv_id, turn, 'noise ' || json_object('result', text) as raw from conversations where role = 'assistant'",
    "v_agent_replies": f"""select 'r' || cast(o_custkey as varchar(20)) as repo, {_AGENT} as agent, o_orderkey, {_AGENT_DOC} as doc,
 (case cast(o_orderkey % 4 as int) when 0 then json_object('type', 'result', 'result', {_AGENT_DOC}) when 1 then json_object('type', 'text', 'result', '', 'content', {_AGENT_DOC})
  when 2 then json_object('messages', json_array(json_object('content', json_array(json_object('text', {_AGENT_DOC}))))) else {_AGENT_DOC} end) as reply from orders""",
    "v_agent_findings": """select r.repo, r.agent, r.o_orderkey, v.type as type, v.file as file, v.line_start as line_start, v.line_end as line_end, v.severity as severity,
 v.confidence as confidence, v.description as description, v.vulnerable_code as vulnerable_code, v.secure_fix as secure_fix, v.fix_explanation as fix_explanation
 from (select repo, agent, o_orderkey, unnest(from_json(regexp_extract(doc, '(?s)(\\{.*\\})', 1),
  '{"vulnerabilities": [{"type": "VARCHAR", "file": "VARCHAR", "line_start": "INTEGER", "line_end": "INTEGER", "severity": "VARCHAR", "confidence": "DOUBLE", "description": "VARCHAR", "vulnerable_code": "VARCHAR", "secure_fix": "VARCHAR", "fix_explanation": "VARCHAR"}]}').vulnerabilities) as v
 from v_agent_replies where json_valid(regexp_extract(doc, '(?s)(\\{.*\\})', 1))) r""",
    "v_reports": f"select o_orderkey, {_REPORT_TEXT} as raw from orders",
    "v_services": f"select o_orderkey, {_SERVICE_TEXT} as raw from orders",
    "v_secret_lines": f"select cast(user_id as varchar(20)) as repo, event_id, {_SECRET_TEXT} as raw from (select *, {_DETECTOR} as d from events)",
    "v_urls": f"select page_id, {_URL} as raw from pages",
    "v_payloads": f"select page_id, {_TRAVERSAL} as value from pages",
    "v_progress": "select 'agent_' || cast(user_id % 12 as varchar(20)) as agent, event_type as status, ts, value as progress, event_id from events",
    "v_comments": """select 'r' || cast(conv_id % 25 as varchar(20)) as repo, conv_id as issue, conv_id * 1000 + turn as comment_id, text as body, turn, role from conversations
 union all select 'r' || cast(conv_id % 25 as varchar(20)), conv_id, conv_id * 1000 + turn, text, turn, role from conversations where turn % 3 = 0""",
    "v_fixes": f"""select f.repo, f.path, cast(l_linenumber as int) as start_line, cast(l_linenumber + l_orderkey % 3 as int) as end_line, {_CHECK_ID} as vulnerability,
 'fixed line ' || cast(l_orderkey as varchar(20)) || (case when l_orderkey % 4 = 0 then chr(10) || 'second' else '' end) as fixed_code, 'line ' || cast(l_orderkey as varchar(20)) as description,
 l_quantity / 50 as confidence, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem l join v_places f on l.l_partkey % (select count(*) from documents) = f.doc_id""",
}


def with_views(sql: str) -> str:
    """The SQL with the views it uses (and those they use) in front, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in SQL_VIEWS and name not in needed:
                visit(SQL_VIEWS[name])
                needed.append(name)

    visit(sql)
    head = ", ".join(f"{n} as ({SQL_VIEWS[n]})" for n in needed)
    body = sql.strip()
    if not head:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {head}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {head}, {body[5:]}"
    return f"with {head} {body}"


# ---------------------------------------------------------------- Spark side
_ROW_KEYS = {"documents": ["doc_id"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey"], "orders": ["o_orderkey"],
             "events": ["event_id"], "conversations": ["conv_id", "turn"], "pages": ["page_id"]}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")
    return spread(scan, _ROW_KEYS[name]) if name in _ROW_KEYS else scan


def files(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "source as repo", "doc_id", "text as content", "n_chars as size", "'file' as type", "lang", f"{_FILE_PATH} as path")


def code_files(spark, sf) -> DataFrame:
    """Documents with a line of risky code, a source above it and a sink below it."""
    return (table(spark, sf, "documents").selectExpr("source as repo", "doc_id", f"{_code_path(False)} as path", f"{_code_text(False)} as content", "'file' as type")
            .withColumn("size", F.length("content").cast("bigint")))


def flow_code(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("source as repo", "'src/flow_' || cast(doc_id as varchar(20)) || '.py' as path", f"{_FLOW_TEXT} as content")


def scope_code(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("source as repo", f"{_SCOPE_PATH} as path", f"{_SCOPE_TEXT} as content")


_FINDING_COLUMNS = (
    "l_suppkey as repo", "'src/p' || cast(l_partkey % 20 as varchar(20)) || '.py' as path",
    "cast(l_orderkey % 40 + 1 as int) as start_line", "cast(l_orderkey % 40 + 1 + l_linenumber as int) as end_line")
_FINDING_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
ORDER = list(_FINDING_ORDER)


def findings(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        *_FINDING_COLUMNS, f"{_CHECK_ID} as check_id", f"{_IMPACT} as impact", "l_quantity / 50 as confidence", *_FINDING_ORDER)


def dotted(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        *_FINDING_COLUMNS, f"{_DOTTED_ID} as check_id", f"{_IMPACT} as impact", "l_quantity / 50 as confidence", *_FINDING_ORDER)


def _placed_lines(spark, sf) -> DataFrame:
    """Every row of lineitem with a document's place; some places name files that don't exist."""
    listed = files(spark, sf)
    places = listed.selectExpr("repo", "(case when doc_id % 50 = 49 then 'gone/' else '' end) || path as path", "doc_id")
    lines = table(spark, sf, "lineitem").crossJoin(listed.agg(F.count(F.lit(1)).alias("n_files"))) \
        .withColumn("_place", F.col("l_partkey") % F.col("n_files"))     # a column, so that the three are joined in this order
    return lines.join(places, F.col("_place") == F.col("doc_id"))


def file_findings(spark, sf) -> DataFrame:
    rows = _placed_lines(spark, sf)
    return rows.selectExpr(
        "repo", "path", "cast(l_linenumber as int) as start_line", "cast(l_linenumber + l_orderkey % 3 as int) as end_line",
        f"{_CHECK_ID} as check_id", f"{_IMPACT} as impact", "'message ' || l_linestatus as message",
        "l_quantity / 50 as confidence", *_FINDING_ORDER)


def validations(spark, sf) -> DataFrame:
    places = files(spark, sf).select("repo", "path", "doc_id")
    return table(spark, sf, "labels").join(places, "doc_id").selectExpr(
        "repo", "path", "quality = 1 as is_legitimate", "cast(0.5 as double) + cast(0.1 as double) * (doc_id % 6) as confidence")


def manifests(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "'r' || cast(o_custkey as varchar(20)) as repo", f"{_MANIFEST_PATH} as path", "'file' as type",
        f"{_MANIFEST_TEXT} as content", "o_orderkey").withColumn("size", F.length("content").cast("bigint"))


def replies(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").where("role = 'assistant'").selectExpr(
        "conv_id", "turn", "'noise ' || to_json(named_struct('result', text)) as raw")


def agent_replies(spark, sf) -> DataFrame:
    base = table(spark, sf, "orders").selectExpr(
        "'r' || cast(o_custkey as varchar(20)) as repo", f"{_AGENT} as agent", "o_orderkey", f"{_AGENT_DOC} as doc")
    return base.withColumn("reply", F.expr("""case cast(o_orderkey % 4 as int)
        when 0 then to_json(named_struct('type', 'result', 'result', doc))
        when 1 then to_json(named_struct('type', 'text', 'result', '', 'content', doc))
        when 2 then to_json(named_struct('messages', array(named_struct('content', array(named_struct('text', doc))))))
        else doc end"""))


def reports(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("o_orderkey", f"{_spark_text(_REPORT_TEXT)} as raw")


def services(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("o_orderkey", f"{_SERVICE_TEXT} as raw")


def secret_lines(spark, sf) -> DataFrame:
    return (table(spark, sf, "events").selectExpr("*", f"{_DETECTOR} as d")
            .selectExpr("cast(user_id as varchar(20)) as repo", "event_id", f"{_SECRET_TEXT} as raw"))


def urls(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").selectExpr("page_id", f"{_URL} as raw")


def payloads(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").selectExpr("page_id", f"{_TRAVERSAL} as value")


def progress(spark, sf) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "'agent_' || cast(user_id % 12 as varchar(20)) as agent", "event_type as status", "ts", "value as progress", "event_id")


def comments(spark, sf) -> DataFrame:
    rows = table(spark, sf, "conversations").selectExpr(
        "'r' || cast(conv_id % 25 as varchar(20)) as repo", "conv_id as issue", "conv_id * 1000 + turn as comment_id",
        "text as body", "turn", "role")
    return rows.unionByName(rows.where("turn % 3 = 0"))


def fixes(spark, sf) -> DataFrame:
    rows = _placed_lines(spark, sf)
    return rows.selectExpr(
        "repo", "path", "cast(l_linenumber as int) as start_line", "cast(l_linenumber + l_orderkey % 3 as int) as end_line",
        f"{_CHECK_ID} as vulnerability",
        "'fixed line ' || cast(l_orderkey as varchar(20)) || (case when l_orderkey % 4 = 0 then chr(10) || 'second' else '' end) as fixed_code",
        "'line ' || cast(l_orderkey as varchar(20)) as description", "l_quantity / 50 as confidence", *_FINDING_ORDER)


def pages(spark, sf) -> DataFrame:
    return table(spark, sf, "pages")


def _spark_text(sql: str) -> str:
    """Backslashes are escapes inside Spark SQL strings, plain characters in ANSI ones."""
    return sql.replace("\\", "\\\\")
