"""Rule catalogs for line matching.

A rule is plain data: `regex` must hold and `not_regex` must not hold on the same line, in
files of one of `languages` (empty = any file). The expressions avoid look-around and
back-references, so they mean the same in every regular-expression engine. `needles` are
lower-case texts of which every match contains one (empty = unknown): a file without any of
them is never searched with the expression.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from riskloom import dims


class Rule(NamedTuple):
    rule_id: str
    agent: str
    languages: tuple
    regex: str
    not_regex: str | None = None
    impact: str = "MEDIUM"
    cwe: str = dims.DEFAULT_CWE
    needles: tuple = ()


def _group(agent: str, cwe: str, *rows) -> list[Rule]:
    out = []
    for name, languages, impact, needles, regex, *rest in rows:
        out.append(Rule(f"{agent}-{name}", agent, tuple(languages), regex, rest[0] if rest else None, impact, cwe,
                        needles))
    return out


_JS = ("JavaScript", "TypeScript")
_PY, _JAVA, _PHP, _GO, _CS, _C = ("Python",), ("Java",), ("PHP",), ("Go",), ("C#",), ("C", "C++")

# --------------------------------------------------------------------------
# Line patterns of the eight analysers and the secret group.
# --------------------------------------------------------------------------
INJECTION_RULES = _group(
    "code-injection-analyser", "CWE-94",
    ("sql_concat", (), "CRITICAL", ("select ",), r"(?i)select .* from .*['\"] *\+"),
    ("sql_fstring", _PY, "CRITICAL", ("select ",), r"(?i)f['\"]select .*\{"),
    ("sql_execute_concat", (), "CRITICAL", ("execute(",), r"(?i)execute\(.*['\"] *\+"),
    ("orm_extra", _PY, "MEDIUM", (".extra(",), r"\.extra\("),
    ("os_system", _PY, "HIGH", ("os.system(",), r"os\.system\("),
    ("shell_true", _PY, "HIGH", ("shell",), r"(?i)shell *= *true"),
    ("eval", (), "HIGH", ("eval(",), r"\beval\("),
    ("function_constructor", _JS, "HIGH", ("function(",), r"\bFunction\("),
    ("child_process", _JS, "HIGH", ("child_process", ".exec("), r"child_process|\.exec\("),
    ("mongo_where", _JS, "MEDIUM", ("$where",), r"\$where"),
    ("template_from_input", _PY, "HIGH", ("template(", "render_template_string("), r"\bTemplate\(|render_template_string\("),
    ("jdbc_concat", _JAVA, "CRITICAL", ("executequery(",), r"executeQuery\(.*\+"),
    ("hql_concat", _JAVA, "HIGH", ("createquery(",), r"createQuery\(.*\+"),
    ("spel", _JAVA, "MEDIUM", ("parseexpression(",), r"parseExpression\("),
    ("xpath", _JAVA, "MEDIUM", ("xpath",), r"(?i)xpath.*\+"),
    ("go_query_sprintf", _GO, "HIGH", (".query(",), r"\.Query\(.*Sprintf"),
    ("go_command", _GO, "MEDIUM", ("exec.command(",), r"exec\.Command\("),
)
XSS_RULES = _group(
    "code-xss-analyser", "CWE-79",
    ("inner_html", (), "HIGH", ("innerhtml",), r"innerHTML\s*="),
    ("outer_html", (), "HIGH", ("outerhtml",), r"outerHTML\s*="),
    ("document_write", (), "HIGH", ("document.write",), r"document\.write(?:ln)?\("),
    ("jquery_html", _JS, "MEDIUM", (".html(",), r"\.html\("),
    ("timer_string", _JS, "MEDIUM", ("settimeout(", "setinterval("), r"set(?:Timeout|Interval)\(\s*[a-z_]+ *,"),
    ("event_attribute", _JS, "MEDIUM", ("setattribute(",), r"setAttribute\(['\"]on[a-z]+['\"]"),
    ("react_raw_html", (), "HIGH", ("dangerouslysetinnerhtml",), r"dangerouslySetInnerHTML"),
    ("vue_raw_html", (), "HIGH", ("v-html",), r"v-html"),
    ("angular_bypass", (), "HIGH", ("bypasssecuritytrust",), r"bypassSecurityTrust"),
    ("template_safe", (), "MEDIUM", ("safe",), r"\|\s*safe\b"),
    ("autoescape_off", (), "MEDIUM", ("autoescape ",), r"autoescape (?:off|false)"),
    ("csp_unsafe", (), "LOW", ("unsafe-inline", "unsafe-eval"), r"unsafe-(?:inline|eval)"),
)
PATH_RULES = _group(
    "code-path-analyser", "CWE-22",
    ("open_user", _PY, "HIGH", ("open(",), r"open\([^)]*\+.*user"),
    ("join_user", _PY, "HIGH", ("os.path.join(",), r"os\.path\.join\([^)]*user"),
    ("send_file_user", _PY, "HIGH", ("send_file(",), r"send_file\([^)]*user"),
    ("zip_extract", _PY, "MEDIUM", ("zipfile.",), r"zipfile\..*extractall"),
    ("tar_extract", _PY, "MEDIUM", ("tarfile.",), r"tarfile\..*extractall"),
    ("php_include", _PHP, "CRITICAL", ("include(", "require("), r"(?:include|require)\(.*\$_(?:GET|POST)"),
    ("php_file_read", _PHP, "HIGH", ("file_get_contents(", "readfile(", "fopen("), r"(?:file_get_contents|readfile|fopen)\(.*\$"),
    ("node_read", _JS, "HIGH", ("fs.readfile(", "fs.createreadstream("), r"fs\.(?:readFile|createReadStream)\("),
    ("node_join_request", _JS, "HIGH", ("path.join(",), r"path\.join\(.*req\."),
    ("node_require_variable", _JS, "MEDIUM", ("require(",), r"require\([a-zA-Z_]+\)"),
    ("java_new_file", _JAVA, "MEDIUM", ("new file",), r"new File(?:Reader)?\("),
    ("java_paths_get", _JAVA, "MEDIUM", ("paths.get(", "fileinputstream("), r"Paths\.get\(|FileInputStream\("),
)
CRYPTO_RULES = _group(
    "code-crypto-analyser", "CWE-327",
    ("py_md5", _PY, "HIGH", ("hashlib.md5(",), r"hashlib\.md5\("),
    ("py_sha1", _PY, "MEDIUM", ("hashlib.sha1(",), r"hashlib\.sha1\("),
    ("py_des", _PY, "HIGH", ("crypto.cipher.des",), r"Crypto\.Cipher\.DES"),
    ("py_arc4", _PY, "HIGH", ("crypto.cipher.arc4",), r"Crypto\.Cipher\.ARC4"),
    ("ecb_mode", (), "HIGH", ("mode_ecb", "/ecb/"), r"MODE_ECB|/ECB/"),
    ("py_random", _PY, "MEDIUM", ("random.randint(", "random.random("), r"random\.(?:randint|random)\("),
    ("py_cert_none", _PY, "HIGH", ("cert_none",), r"CERT_NONE"),
    ("java_md5", _JAVA, "HIGH", ("messagedigest",), r"MessageDigest\.getInstance\(\"MD5\"\)"),
    ("java_sha1", _JAVA, "MEDIUM", ("messagedigest",), r"MessageDigest\.getInstance\(\"SHA1\"\)"),
    ("java_rsa_1024", _JAVA, "HIGH", ("initialize(1024)",), r"initialize\(1024\)"),
    ("java_random", _JAVA, "MEDIUM", ("new random()",), r"new Random\(\)"),
    ("java_trust_all", _JAVA, "HIGH", ("trustallcerts",), r"(?i)trustAllCerts"),
    ("js_md5", _JS, "HIGH", ("createhash(",), r"createHash\(['\"]md5['\"]\)"),
    ("js_math_random", _JS, "MEDIUM", ("math.random(",), r"Math\.random\("),
    ("js_tls_off", _JS, "HIGH", ("node_tls_reject_unauthorized",), r"NODE_TLS_REJECT_UNAUTHORIZED"),
    ("go_weak_import", _GO, "HIGH", ("crypto/md5", "crypto/des", "crypto/rc4"), r"crypto/(?:md5|des|rc4)"),
    ("go_math_rand", _GO, "MEDIUM", ("math/rand",), r"math/rand"),
    ("verify_off", (), "HIGH", ("verify", "check_hostname", "cert_none", "trust"), r"(?i)verify.*false|check_hostname.*false|cert_none|trust.*all"),
)
AUTH_RULES = _group(
    "code-auth-analyser", "CWE-287",
    ("sql_in_login", (), "HIGH", ("username", "login"), r"(?i)username.*password.*query|login.*where.*="),
    ("route_without_login", _PY, "MEDIUM", ("@app.route",), r"@app\.route", r"login_required|auth"),
    ("admin_without_check", _PY, "MEDIUM", ("admin", "privileged", "sensitive"), r"(?i)admin|privileged|sensitive", r"require|check|auth"),
    ("direct_object_reference", _PY, "MEDIUM", ("get", "find_by_id"), r"(?i)get.*id\)|User\.get\(|find_by_id"),
    ("cookie_flags", _PY, "MEDIUM", ("cookie", "session"), r"(?i)cookie|session", r"(?i)secure|httponly|samesite"),
    ("session_fixation", _PHP, "MEDIUM", ("session_start", "session_regenerate"), r"session_start|session_regenerate"),
    ("jwt_unverified", ("Python", "JavaScript", "TypeScript"), "HIGH", ("jwt",), r"(?i)\bjwt\b", r"(?i)verify|validate"),
)
DESERIAL_RULES = _group(
    "code-deserial-analyser", "CWE-502",
    ("pickle", _PY, "CRITICAL", ("pickle.",), r"c?[Pp]ickle\.(?:loads?|Unpickler)"),
    ("yaml_load", _PY, "HIGH", ("yaml.load(",), r"yaml\.load\(", r"safe_load|SafeLoader"),
    ("marshal_dill", _PY, "HIGH", ("marshal.loads", "dill.loads"), r"(?:marshal|dill)\.loads"),
    ("java_stream", _JAVA, "HIGH", ("objectinputstream", "readobject()", "deserialize"), r"ObjectInputStream|readObject\(\)|deserialize"),
    ("java_xml", _JAVA, "HIGH", ("xmldecoder", "xstream"), r"XMLDecoder|XStream"),
    ("jackson_typing", _JAVA, "HIGH", ("enabledefaulttyping", "@jsontypeinfo"), r"enableDefaultTyping|@JsonTypeInfo"),
    ("php_unserialize", _PHP, "HIGH", ("unserialize(", "__wakeup", "__destruct"), r"unserialize\(|__wakeup|__destruct"),
    ("php_phar", _PHP, "HIGH", ("phar",), r"phar://|file_get_contents.*phar"),
    ("net_formatter", _CS, "CRITICAL", ("binaryformatter", "deserialize"), r"BinaryFormatter|Deserialize"),
    ("net_contract", _CS, "MEDIUM", ("datacontractserializer",), r"DataContractSerializer"),
)
XXE_RULES = _group(
    "code-xxe-analyser", "CWE-611",
    ("java_parser", _JAVA, "HIGH", ("documentbuilderfactory", "saxparserfactory", "xmlreaderfactory"), r"DocumentBuilderFactory|SAXParserFactory|XMLReaderFactory",
     r"disallow-doctype-decl|external-general-entities"),
    ("java_unmarshal", _JAVA, "MEDIUM", ("unmarshal", "parsexml", "loadxml"), r"unmarshal|parseXML|loadXML",
     r"disallow-doctype-decl|external-general-entities"),
    ("py_parser", _PY, "MEDIUM", ("xml.etree", "lxml", "xml.dom", "xml.sax", "xmlparser"), r"xml\.etree|lxml|xml\.dom|xml\.sax|XMLParser", r"defusedxml|resolve_entities.*False"),
    ("net_parser", _CS, "MEDIUM", ("xmldocument", "xpathdocument", "xmlreader", "loadxml", "readxml"), r"XmlDocument|XPathDocument|XmlReader|LoadXml|ReadXml",
     r"XMLResolver.*null|DtdProcessing\.Prohibit"),
    ("php_parser", _PHP, "MEDIUM", ("simplexml_load", "domdocument", "xml_parse"), r"simplexml_load|DOMDocument|xml_parse"),
    ("js_parser", _JS, "MEDIUM", ("xml2js", "libxmljs", "fast-xml-parser"), r"xml2js|libxmljs|fast-xml-parser"),
    ("py_parse_call", _PY, "LOW", ("fromstring", "parse"), r"fromstring|parse", r"defusedxml"),
    ("java_xml_mapping", _JAVA, "LOW", ("@consumes", "@requestmapping"), r"@Consumes.*xml|@RequestMapping.*xml"),
    ("parse_request", ("JavaScript", "TypeScript", "Python"), "MEDIUM", ("parsestring", "fromstring"), r"parseString|fromstring.*request"),
    ("xml_endpoint", (), "LOW", ("application/xml", "text/xml", "content-type"), r"application/xml|text/xml|Content-Type.*xml"),
)
RACE_RULES = _group(
    "code-race-analyser", "CWE-362",
    ("c_check_then_open", _C, "HIGH", ("stat", "access"), r"(?:l?stat|access).*open"),
    ("py_check_then_open", _PY, "HIGH", ("os.stat", "os.path.exists"), r"os\.stat.*open|os\.path\.exists.*open"),
    ("java_check_then_open", _JAVA, "HIGH", ("file.exists",), r"File\.exists.*new.*File"),
    ("shared_increment", ("Java", "C++"), "LOW", ("++",), r"\.(?:count|value)\+\+|i\+\+", r"synchronized|Lock|Mutex|atomic"),
    ("shared_state", ("C", "C++", "Java"), "LOW", ("static", "global", "shared"), r"(?:static|global|shared).*="),
    ("js_shared_push", _JS, "MEDIUM", ("promise.all", "callback", "async", "await"), r"Promise\.all.*push|callback.*global|(?:async|await).*global"),
    ("go_shared", _GO, "MEDIUM", ("go",), r"go.*func.*global|goroutine.*shared", r"Lock|Mutex|atomic"),
)
SECRET_RULES = _group(
    "secret-scanner", "CWE-798",
    ("generic_assignment", (), "HIGH", ("secret", "token", "key"), r"(?i)(?:secret|token|key)[^=]{0,80}=[^'\"]{0,80}['\"][a-z0-9+/]{16,}['\"]"),
    ("password_assignment", (), "HIGH", ("password",), r"(?i)password[^=]{0,80}=[^'\"]{0,80}['\"][^'\"]{8,}['\"]"),
)

CODE_RULES: tuple[Rule, ...] = tuple(
    INJECTION_RULES + XSS_RULES + PATH_RULES + CRYPTO_RULES + AUTH_RULES + DESERIAL_RULES + XXE_RULES + RACE_RULES)
ALL_RULES: tuple[Rule, ...] = CODE_RULES + tuple(SECRET_RULES)

# --------------------------------------------------------------------------
# Checks on whole web pages. (id, impact, pattern, page must match)
# --------------------------------------------------------------------------
HTML_CHECKS = (
    ("inline_script", "MEDIUM", r"(?i)<script[^>]*>[^<]", True),
    ("missing_csp", "MEDIUM", r"(?i)content-security-policy", False),
    ("unsafe_csp", "LOW", r"(?i)unsafe-(?:inline|eval)", True),
    ("raw_template_output", "HIGH", r"(?i)\{\{[^}]*\|\s*safe\s*\}\}|autoescape (?:off|false)", True),
    ("event_handler", "MEDIUM", r"(?i)<[a-z][^>]*\son[a-z]+\s*=", True),
    ("raw_dom_write", "HIGH", r"innerHTML\s*=|document\.write", True),
    ("inline_frame", "LOW", r"(?i)<iframe", True),
    ("html_comment", "LOW", r"<!--", True),
)

# --------------------------------------------------------------------------
# Code points. (kind, type, pattern, needles)
# --------------------------------------------------------------------------
CODE_POINTS = (
    ("source", "http_request", r"request\.(?:args|form|json|params|GET|POST)|req\.(?:body|query|params)|\$_(?:GET|POST|REQUEST)|r\.(?:FormValue|URL\.Query)|getParameter\(", ("request.", "req.", "$_", "r.formvalue", "r.url.query", "getparameter(")),
    ("source", "command_line", r"sys\.argv|process\.argv|os\.Args|\bargv\[", ("argv", "os.args")),
    ("source", "file_read", r"\.read\(\)|readFileSync\(|ioutil\.ReadFile|Files\.readAll", (".read()", "readfilesync(", "ioutil.readfile", "files.readall")),
    ("source", "database_result", r"fetchone\(|fetchall\(|\.next\(\)|rows\.Scan\(", ("fetchone(", "fetchall(", ".next()", "rows.scan(")),
    ("source", "message_queue", r"basic_consume|KafkaConsumer|\.subscribe\(", ("basic_consume", "kafkaconsumer", ".subscribe(")),
    ("sink", "database_query", r"\.execute\(|\.query\(|executeQuery\(|\.raw\(", (".execute(", ".query(", "executequery(", ".raw(")),
    ("sink", "command_execution", r"os\.system\(|subprocess\.|exec\.Command\(|child_process|Runtime\.getRuntime", ("os.system(", "subprocess.", "exec.command(", "child_process", "runtime.getruntime")),
    ("sink", "file_access", r"\bopen\(|writeFile\(|new File\(|os\.Create\(", ("open(", "writefile(", "new file(", "os.create(")),
    ("sink", "code_evaluation", r"\beval\(|\bexec\(|new Function\(", ("eval(", "exec(", "new function(")),
    ("sink", "html_render", r"innerHTML|document\.write|render_template_string\(", ("innerhtml", "document.write", "render_template_string(")),
    ("sink", "xml_parse", r"xml\.etree|DocumentBuilder|simplexml_load", ("xml.etree", "documentbuilder", "simplexml_load")),
    ("sink", "deserialisation", r"pickle\.loads?|yaml\.load\(|unserialize\(|readObject\(", ("pickle.load", "yaml.load(", "unserialize(", "readobject(")),
    ("control", "input_validation", r"(?i)validate|sanitize|is_valid", ("validate", "sanitize", "is_valid")),
    ("control", "encoding", r"(?i)escape\(|encodeURI|html\.escape|bleach", ("escape(", "encodeuri", "html.escape", "bleach")),
    ("control", "authentication", r"(?i)login_required|authenticate|authorize", ("login_required", "authenticate", "authorize")),
    ("control", "prepared_statement", r"(?i)prepareStatement|PreparedStatement|\.prepare\(", ("preparestatement", "preparedstatement", ".prepare(")),
)

# --------------------------------------------------------------------------
# Secret detectors. (detector, pattern, needles); group 1 of the pattern is the secret.
# --------------------------------------------------------------------------
SECRET_DETECTORS = (
    ("token", r"(?i)\btoken[^=\n]{0,80}=[^'\"\n]{0,80}['\"]([a-z0-9+/_\-]{16,})['\"]", ("token",)),
    ("secret", r"(?i)\bsecret[^=\n]{0,80}=[^'\"\n]{0,80}['\"]([a-z0-9+/_\-]{16,})['\"]", ("secret",)),
    ("key", r"(?i)key[^=\n]{0,80}=[^'\"\n]{0,80}['\"]([a-z0-9+/_\-]{16,})['\"]", ("key",)),
    ("password", r"(?i)password[^=\n]{0,80}=[^'\"\n]{0,80}['\"]([^'\"]{8,})['\"]", ("password",)),
    ("awskey", r"\b(AKIA[0-9A-Z]{16})\b", ("akia",)),
    ("githubtoken", r"\b(gh[pousr]_[A-Za-z0-9]{36})\b", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("slacktoken", r"\b(xox[abprs]-[A-Za-z0-9\-]{10,})", ("xox",)),
    ("stripekey", r"\b(sk_live_[A-Za-z0-9]{16,})\b", ("sk_live_",)),
    ("privatekey", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", ("-----begin ",)),
    ("jwt_token", r"\b(eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})", ("eyj",)),
)


def ruleset_of(rule: Rule) -> str:
    """Rule set a rule belongs to: its language's, or the general ones."""
    if rule.agent == "secret-scanner":
        return "p/secrets"
    if rule.agent == "code-xss-analyser":
        return "p/xss"
    if not rule.languages:
        return "p/security-audit"
    return dims.LANGUAGE_RULESETS[rule.languages[0]][0]


RULES_SCHEMA = ("rule_id string, agent string, languages array<string>, regex string, not_regex string, "
                "impact string, cwe string, ruleset string")


def rules_frame(spark: SparkSession, rules=ALL_RULES) -> DataFrame:
    """The catalog as a small table, for joins on rule sets."""
    rows = [(r.rule_id, r.agent, list(r.languages), r.regex, r.not_regex, r.impact, r.cwe, ruleset_of(r))
            for r in rules]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def rules_from_frame(frame: DataFrame, limit: int = 10_000) -> tuple[Rule, ...]:
    """User rules out of a table. The catalog must be small; a bigger one is refused, not cut."""
    rows = frame.select("rule_id", "agent", "languages", "regex", "not_regex", "impact", "cwe").take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rules")
    return tuple(Rule(r.rule_id, r.agent, tuple(r.languages or ()), r.regex, r.not_regex, r.impact, r.cwe)
                 for r in sorted(rows, key=lambda r: r.rule_id))
