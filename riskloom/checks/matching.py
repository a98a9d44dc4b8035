"""Queries on lines, pages and whole scans."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from riskloom import dims
from riskloom.checks import sqltext as q
from riskloom.checks import views
from riskloom.functions import findings as ff
from riskloom.operators import content, dedup, filters, flows, joins, matching, metrics, ranking, scopes
from riskloom.plans import profile, scans
from riskloom.rule_catalog import (ALL_RULES, CODE_POINTS, CODE_RULES, HTML_CHECKS, SECRET_DETECTORS, Rule)

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


# Rules for what the documents really hold: licences, addresses and tokens.
TEXT_RULES = (
    Rule("license-line", "secret-scanner", (), r"(?i)license", None, "LOW", "CWE-1"),
    Rule("mail-address", "secret-scanner", (), r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]+", None, "MEDIUM", "CWE-2"),
    Rule("ip-without-token", "secret-scanner", (), r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", r"token", "HIGH", "CWE-3"),
    Rule("python-token", "secret-scanner", ("Python",), r"(?i)token\s*=", None, "CRITICAL", "CWE-4"),
)
TEXT_POINTS = (
    ("source", "mail", r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]+", ("@",)),
    ("source", "capital_the", r"De [a-z]", ("de ",)),
    ("sink", "license", r"(?i)license", ("license",)),
    ("sink", "ip", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", ()),
    ("control", "token", r"token", ("token",)),
    ("control", "quotes", r" que ", ()),
)


def _lines(view):
    return (f"select repo, path, cast(generate_subscripts(string_split(content, chr(10)), 1) as int) as line, "
            f"unnest(string_split(content, chr(10))) as text, {q.case_map(q.EXT, dims.LANGUAGE_BY_EXTENSION)} as language from {view}")


def _matches(view, rules):
    """Line by rule, one branch per rule, so that each expression is a constant."""
    def one(r):
        gate = f"{q.in_list('language', r.languages)} and " if r.languages else ""
        exclude = f" and not regexp_matches(text, {q.quote(r.not_regex)})" if r.not_regex else ""
        return (f"select repo, path, line as start_line, line as end_line, {q.quote(r.rule_id)} as check_id, {q.quote(r.agent)} as agent, "
                f"{q.quote(r.impact)} as impact, {q.quote(r.cwe)} as cwe, text as code from ln where {gate}regexp_matches(text, {q.quote(r.regex)}){exclude}")
    return f"(with ln as materialized ({_lines(view)}) " + " union all ".join(map(one, rules)) + ")"


@query("rule_matches", f"select * from {_matches('v_code', ALL_RULES)}")
def rule_matches(spark, sf):
    return matching.match_rules(views.code_files(spark, sf))


@query("custom_rule_matches", f"select * from {_matches('v_files', TEXT_RULES)}")
def custom_rule_matches(spark, sf):
    return matching.match_rules(views.files(spark, sf), rules_frame_of(spark))


def rules_frame_of(spark):
    rows = [(r.rule_id, r.agent, list(r.languages), r.regex, r.not_regex, r.impact, r.cwe) for r in TEXT_RULES]
    return spark.createDataFrame(rows, "rule_id string, agent string, languages array<string>, regex string, not_regex string, impact string, cwe string")


def _secrets(view):
    per = " union all ".join(
        f"select repo, path, line, {q.quote(name)} as detector, unnest(regexp_extract_all(text, {q.quote(rx)}, 1)) as value from l" for name, rx, _ in SECRET_DETECTORS)
    return f"""with l as ({_lines(view)}), s as ({per})
        select repo, path, line, detector, left(value, 4) || repeat('*', greatest(length(value) - 4, 0)) as redacted, sha256(value) as value_hash,
        round(list_aggregate(string_split(value, ''), 'entropy'), 6) as entropy, false as verified from s"""


@query("secrets", _secrets("v_code"))
def secrets(spark, sf):
    return matching.detect_secrets(views.code_files(spark, sf)).withColumn("entropy", F.round("entropy", 6))


@query("strong_secrets", f"with x as ({_secrets('v_code')}) select * from x where entropy >= 3.5")
def strong_secrets(spark, sf):
    return matching.detect_secrets(views.code_files(spark, sf), min_entropy=3.5).withColumn("entropy", F.round("entropy", 6))


def secret_report(spark, sf):
    """Secrets of the documents by repository and type, with their descriptions."""
    found = dedup.dedup_secrets(matching.detect_secrets(views.files(spark, sf)))
    named = found.withColumn("secret_type", ff.secret_type(F.col("detector"))).withColumn(
        "description", ff.secret_description(F.col("detector"), F.col("verified")))
    return ranking.sort_secrets(named).select("repo", "path", "line", "detector", "redacted", "secret_type", "description", "verified")


_DEDUP = f"with x as ({_secrets('v_files')}) select distinct repo, path, line, detector, redacted, verified from x"


@query("secret_report", f"""with d as ({_DEDUP}) select repo, path, line, detector, redacted, {q.secret_type('detector')} as secret_type,
    '⚠️ Potential ' || {q.secret_type('detector')} || ' detected - Verification needed to confirm if this is a valid secret' as description, verified from d""")
def _secret_report(spark, sf):
    return secret_report(spark, sf)


@query("secret_types", f"""with x as ({_secrets('v_code')}), d as (select distinct repo, path, line, detector, redacted from x),
    c as (select repo, {q.secret_type('detector')} as secret_type, count(*) as n, min(struct_pack(path := path, line := line)) as first from d group by 1, 2)
    select repo, secret_type, n, cast(row_number() over (partition by repo order by n desc, first, secret_type) as int) as position from c""")
def secret_types(spark, sf):
    return metrics.secret_counts(dedup.dedup_secrets(matching.detect_secrets(views.code_files(spark, sf))))


def _points(view, catalog):
    def one(c):
        return (f"select repo, path, line, {q.quote(c[0])} as kind, {q.quote(c[1])} as type, regexp_extract(text, {q.quote(c[2])}) as symbol "
                f"from ln where regexp_matches(text, {q.quote(c[2])})")
    return f"(with ln as materialized ({_lines(view)}) " + " union all ".join(map(one, catalog)) + ")"


@query("code_points", f"select * from {_points('v_code', CODE_POINTS)}")
def code_points(spark, sf):
    return matching.code_points(views.code_files(spark, sf))


@query("text_points", f"select * from {_points('v_files', TEXT_POINTS)}")
def text_points(spark, sf):
    return matching.code_points(views.files(spark, sf), TEXT_POINTS)


def _flows(view, catalog, n):
    return f"""with p as materialized (select * from {_points(view, catalog)}), s as (select k.repo, k.path, k.line as sink_line, k.type as sink_type, max(u.line) as source_line
        from p k join p u on k.repo = u.repo and k.path = u.path and u.line between k.line - {n} and k.line where k.kind = 'sink' and u.kind = 'source' group by 1, 2, 3, 4)
        select repo, path, source_line, sink_line, sink_type, exists (select 1 from p c where c.kind = 'control' and c.repo = s.repo and c.path = s.path
          and c.line between s.source_line and s.sink_line) as controlled from s"""


@query("data_flows", _flows("v_code", CODE_POINTS, 20))
def data_flows(spark, sf):
    return matching.taint_pairs(matching.code_points(views.code_files(spark, sf)), 20)


_VARIABLE_FLOWS = f"""with recursive p as materialized (select * from {_points('v_flow_code', CODE_POINTS)}),
    m as (select repo, path, line, bool_or(kind = 'source') as is_source, bool_or(kind = 'control') as is_control, list_sort(list(distinct type) filter (kind = 'sink')) as sinks from p group by 1, 2, 3),
    t as (select repo, path, line, text, regexp_extract(text, {q.quote(flows.ASSIGNMENT)}, ['var', 'op', 'code']) as a from ({_lines('v_flow_code')})),
    l as materialized (select repo, path, line, nullif(a.var, '') as var, coalesce(is_source, false) as is_source, coalesce(is_control, false) as is_control, sinks,
      list_distinct(list_concat(regexp_extract_all(regexp_replace(case when a.var = '' then text else a.code end, {q.quote(flows.QUOTED)}, ' ', 'g'), {q.quote(flows.IDENTIFIER)}),
        case when a.op in ('', '=', ':=') then [] else [a.var] end)) as uses from t left join m using (repo, path, line)),
    u as (select repo, path, line, unnest(uses) as var from l where (var is not null or len(sinks) > 0) and not is_control),
    e as materialized (select u.repo, u.path, u.line, max(d.line) as def_line from u join l d on d.repo = u.repo and d.path = u.path and d.var = u.var and d.line < u.line group by u.repo, u.path, u.line, u.var),
    reach as (select repo, path, line, line as source_line, 0 as hops from l where var is not null and is_source and not is_control
      union select e.repo, e.path, e.line, r.source_line, r.hops + 1 from reach r join e on e.repo = r.repo and e.path = r.path and e.def_line = r.line
        join l on l.repo = e.repo and l.path = e.path and l.line = e.line where l.var is not null),
    s as (select repo, path, line as sink_line, line as source_line, 0 as steps, sinks from l where len(sinks) > 0 and is_source and not is_control
      union all select l.repo, l.path, l.line, r.source_line, r.hops + 1, l.sinks from l join e using (repo, path, line) join reach r on r.repo = e.repo and r.path = e.path and r.line = e.def_line where len(l.sinks) > 0),
    b as (select repo, path, sink_line, sinks, min(row(steps, -source_line)) as b from s group by all)
    select repo, path, -b[2] as source_line, sink_line, unnest(sinks) as sink_type, b[1] as steps from b"""


_BARE = f"regexp_replace(regexp_replace(text, {q.quote(scopes.STRINGS)}, '', 'g'), {q.quote(scopes.COMMENT)}, '', 'g')"


@query("enclosing_functions", f"""with t as (select repo, path, line, text, language = 'Python' as py, {_BARE} as bare, nullif(regexp_extract(text, {q.quote(scopes.HEAD)}, 1), '') as name from ({_lines('v_scope_code')})),
    l as materialized (select *, length(regexp_extract(text, '^([ \t]*)', 1)) as indent, trim(bare) <> '' as code, contains(bare, '{{') as opens,
      sum(length(replace(bare, '}}', '')) - length(replace(bare, '{{', ''))) over (partition by repo, path order by line) as depth from t),
    h as (select a.*, coalesce((select max_by(b.depth, b.line) from l b where b.repo = a.repo and b.path = a.path and b.line < a.line), 0) as before,
      (select min(b.line) from l b where b.repo = a.repo and b.path = a.path and b.line >= a.line and b.opens) as body,
      (select min(b.line) from l b where b.repo = a.repo and b.path = a.path and b.line > a.line and b.name is not null) as next_head,
      (select max(b.line) from l b where b.repo = a.repo and b.path = a.path) as last_line from l a where a.name is not null),
    s as materialized (select repo, path, name, line as s, coalesce(case when py then (select min(b.line) - 1 from l b where b.repo = h.repo and b.path = h.path and b.line > h.line and b.code and b.indent <= h.indent)
      else (select min(b.line) from l b where b.repo = h.repo and b.path = h.path and b.line >= h.body and b.depth <= h.before) end, last_line) as e
      from h where py or (body is not null and (next_head is null or body < next_head)))
    select l.repo, l.path, l.line as start_line, coalesce(max_by(s.name, s.s), 'unknown') as function, cast(max(s.s) as int) as function_start, cast(max_by(s.e, s.s) as int) as function_end
    from l left join s on s.repo = l.repo and s.path = l.path and l.line between s.s and s.e where contains(l.text, 'eval(') group by l.repo, l.path, l.line""")
def enclosing_functions(spark, sf):
    code = views.scope_code(spark, sf)
    found = content.lines(code).where(F.contains("text", F.lit("eval("))).select("repo", "path", F.col("line").alias("start_line"))
    return scopes.enclosing_functions(found, code)


@query("variable_flows", _VARIABLE_FLOWS)
def variable_flows(spark, sf):
    code = views.flow_code(spark, sf)
    return flows.variable_flows(code, matching.code_points(code))


@query("text_flows", _flows("v_files", TEXT_POINTS, 8))
def text_flows(spark, sf):
    return matching.taint_pairs(matching.code_points(views.files(spark, sf), TEXT_POINTS), 8)


@query("nearest_sources", f"""with p as materialized (select * from {_points('v_files', TEXT_POINTS)})
    select distinct k.repo, k.path, k.line, (select max(u.line) from p u where u.kind = 'source' and u.repo = k.repo and u.path = k.path and u.line between k.line - 8 and k.line) as source_line
    from p k where k.kind = 'sink'""")
def nearest_sources(spark, sf):
    return matching.nearest_source(matching.code_points(views.files(spark, sf), TEXT_POINTS), 8)


@query("page_checks", " union all ".join(
    f"select page_id, url, {q.quote(c)} as check_id, {q.quote(i)} as impact from pages where {'' if present else 'not '}regexp_matches(html, {q.quote(rx)})"
    for c, i, rx, present in HTML_CHECKS))
def page_checks(spark, sf):
    return matching.html_checks(views.pages(spark, sf))


@query("traversal_payloads", r"""with d as (select page_id, value, replace(replace(replace(replace(replace(replace(replace(value, '%c0%af', '/'), '%252F', '%2F'), '%2F', '/'), '／', '/'), '＼', chr(92)), '', ''), '%c0%af', '/') as decoded from v_payloads)
    select page_id, value, decoded, not (contains(value, '../') or contains(value, '..' || chr(92))) as encoded from d where contains(decoded, '../') or contains(decoded, '..' || chr(92))""")
def traversal_payloads(spark, sf):
    return matching.traversal_hits(views.payloads(spark, sf), "value")


_MAGIC = [*dims.MAGIC_SIGNATURES, ("00", None)]


@query("serialised_payloads", "select doc_id, case cast(doc_id % 6 as int) " + " ".join(
    f"when {i} then {q.quote(name)}" for i, (_, name) in enumerate(dims.MAGIC_SIGNATURES)) + " end as format from documents where doc_id % 6 < 5")
def serialised_payloads(spark, sf):
    head = "case cast(doc_id % 6 as int) " + " ".join(f"when {i} then unhex('{s}')" for i, (s, _) in enumerate(_MAGIC)) + " end"
    docs = views.table(spark, sf, "documents").selectExpr("doc_id", f"concat({head}, cast(text as binary)) as data")
    return matching.match_magic(docs)


_ALGORITHMS = ("MD5", "sha256", "AES-256", "rc4", "rsa-2048", "argon2", "unknown-x")
_ALGORITHM = "case cast(o_orderkey % 7 as int) " + " ".join(f"when {i} then '{a}'" for i, a in enumerate(_ALGORITHMS)) + " end"


@query("crypto_grades", f"select o_orderkey, algorithm, {q.case_map('lower(algorithm)', dims.CRYPTO_GRADES, 'unknown')} as grade from (select o_orderkey, {_ALGORITHM} as algorithm from orders)")
def crypto_grades(spark, sf):
    return matching.crypto_grade(views.table(spark, sf, "orders").selectExpr("o_orderkey", f"{_ALGORITHM} as algorithm"))


# ------------------------------------------------------------------ whole scans
def _routed(agents):
    from riskloom.checks.findings import _route_sql
    rel = " union all ".join(f"select repo, path, {q.quote(a)} as agent, {_route_sql(a)} as rel from src" for a in agents)
    return f"select repo, path, agent from (select *, bool_or(rel) over (partition by repo, agent) as any_rel from ({rel})) where rel or not any_rel"


_SOURCE = q.in_list(q.EXT, dims.SOURCE_EXTENSIONS)
_FAN = f"""with src as (select repo, path from v_code where {_SOURCE}), m as (select * from {_matches('v_code', CODE_RULES)}), r as ({_routed(joins.agent_names())})
    select m.* from m join r on m.repo = r.repo and m.path = r.path and m.agent = r.agent"""


@query("analyser_matches", _FAN)
def analyser_matches(spark, sf):
    return scans.fan_out(views.code_files(spark, sf).where(F.expr("1 = 1")))


@query("orchestrated_patterns", f"""with fan as ({_FAN}), c as (select repo, {q.agent_type('check_id')} as type, count(*) as n from fan group by 1, 2 having count(*) >= 2)
    select repo, type, n, format('PATTERN-{{:03d}}', row_number() over (partition by repo order by n desc, type)) as pattern_id,
    {q.case_map('type', dims.SYSTEMIC_FIX_BY_TYPE, dims.DEFAULT_SYSTEMIC_FIX)} as systemic_fix from c""")
def orchestrated_patterns(spark, sf):
    return scans.run_orchestrated(views.code_files(spark, sf))["patterns"].drop("description")


@query("orchestrated_vulnerabilities", f"""with fan as ({_FAN}) select repo, format('VULN-{{:04d}}', row_number() over (partition by repo order by {q.rank_of('impact', dims.AGENT_SCALE)} desc, path, start_line, check_id)) as vuln_id,
    {q.agent_type('check_id')} as type, {q.cwe_of('check_id')} as cwe_id, impact as severity, '1.00' as confidence, path as file, start_line, check_id as sink, code as vulnerable_code,
    {q.case_map(q.agent_type('check_id'), dims.EXPLOIT_BY_TYPE, dims.DEFAULT_EXPLOIT)} as exploit_example from fan""")
def orchestrated_vulnerabilities(spark, sf):
    v = scans.run_orchestrated(views.code_files(spark, sf))["vulnerabilities"]
    return v.select("repo", "vuln_id", "type", "cwe_id", "severity", "confidence", F.col("location.file").alias("file"),
                    F.col("location.start_line").alias("start_line"), F.col("data_flow.sink").alias("sink"), "vulnerable_code", "exploit_example")


@query("orchestrated_flows", _flows("v_code", CODE_POINTS, 20).replace("with p as", f"with src as (select * from v_code where {_SOURCE}), p as").replace("from v_code)", "from src)"))
def orchestrated_flows(spark, sf):
    return scans.run_orchestrated(views.code_files(spark, sf))["data_flows"]


_STD = f"""with kept as (select * from v_code where not {q.any_contains('path', dims.SKIP_DIRECTORIES)} and {q.in_list(q.EXT, dims.ANALYSABLE_EXTENSIONS)} and size <= 1000000),
    m as (select * from {_matches('kept', ALL_RULES)})"""


@query("standard_titles", f"""{_STD}, s as (select *, {q.clean_title('check_id')} as title, {q.report_severity('impact')} as severity from m where upper(impact) in ('HIGH', 'MEDIUM', 'LOW')),
    c as (select repo, title, count(*) as n, min(struct_pack(a := {q.report_rank('severity')}, b := path, c := start_line)) as first from s group by 1, 2)
    select repo, title, n, cast(row_number() over (partition by repo order by n desc, first.a, title, first) as int) as position from c""")
def standard_titles(spark, sf):
    return scans.run_standard(views.code_files(spark, sf), by_profile=False)["titles"]


@query("standard_metrics", f"""{_STD} select repo, count(distinct path) as files_analyzed, count(*) as total, round(cast(count(*) as double) / count(distinct path), 6) as density, """ + ", ".join(
    f"count(*) filter (where impact = '{s}') as {s.lower()}" for s in dims.REPORT_DISPLAY_ORDER) + " from m group by 1")
def standard_metrics(spark, sf):
    return scans.scan(views.code_files(spark, sf), by_profile=False)["metrics"].withColumn("density", F.round("density", 6))


def _profiled():
    from riskloom.checks.manifests import _PROFILE, _RULE_VALUES
    head = (_PROFILE % ("", "joined")).replace("v_manifests", "vm")
    return f"""with vm as (select *, doc_id as o_orderkey, regexp_extract(path, '([^/]*)$', 1) as base from v_code), {head[5:]},
    u as (select distinct repo, r.rule_id from (select repo, unnest(rulesets) as ruleset from final) x join {_RULE_VALUES} r on r.ruleset = x.ruleset),
    kept as (select * from v_code where not {q.any_contains('path', dims.SKIP_DIRECTORIES)} and {q.in_list(q.EXT, dims.ANALYSABLE_EXTENSIONS)} and size <= 1000000),
    pm as (select m.* from {_matches('kept', ALL_RULES)} m where exists (select 1 from u where u.repo = m.repo and u.rule_id = m.check_id))"""


@query("profiled_matches", _profiled() + " select * from pm")
def profiled_matches(spark, sf):
    code = views.code_files(spark, sf)
    wanted = filters.limit_targets(filters.filter_analysable(code))
    return scans.profiled(matching.match_rules(wanted), profile.build_profile(code))


_RUN_SIZE = 300    # so that some of the files are too large


@query("skipped_files", f"select repo, path, size, 'too large' as reason from v_code where size > {_RUN_SIZE}")
def skipped_files(spark, sf):
    return filters.skipped_files(views.code_files(spark, sf), _RUN_SIZE)


def _secret_hits(view):
    each = " union all ".join(
        f"select repo, path, line, {q.quote(name)} as detector, unnest(regexp_extract_all(text, {q.quote(regex)}, 1)) as value from ln" for name, regex, _ in SECRET_DETECTORS)
    return f"(with ln as materialized ({_lines(view)}) {each})"


@query("secrets_in_findings", f"""with s as (select repo, path, line, detector, value from {_secret_hits('v_code')}), r as (select distinct repo, path, start_line, end_line, check_id from {_matches('v_code', ALL_RULES)})
    select s.repo, s.path, s.line, s.detector, sha256(value) as value_hash, r.start_line, r.end_line, r.check_id from s join r on s.repo = r.repo and s.path = r.path and s.line between r.start_line and r.end_line""")
def secrets_in_findings(spark, sf):
    code = views.code_files(spark, sf)
    secrets = matching.detect_secrets(code).select("repo", "path", "line", "detector", "value_hash")
    return joins.secrets_in_findings(secrets, matching.match_rules(code))


@query("standard_run", _profiled().replace("size <= 1000000", f"size <= {_RUN_SIZE}") + f""", fx as (select distinct repo, path, start_line, end_line, check_id from pm),
    sx as (select distinct repo, path, line, detector, value from {_secret_hits('kept')}),
    ex as (select repo from v_code where not {q.any_contains('path', dims.SKIP_DIRECTORIES)} and {q.in_list(q.EXT, dims.ANALYSABLE_EXTENSIONS)} and size > {_RUN_SIZE})
    select 'run' as run_id, (select count(*) from fx) as findings, (select count(*) from sx) as secrets, cast(0 as bigint) as fixes, (select count(*) from ex) as errors,
    (select count(distinct repo) from (select repo from fx union all select repo from sx union all select repo from ex)) as repos""")
def standard_run(spark, sf):
    return scans.run_standard(views.code_files(spark, sf), max_bytes=_RUN_SIZE)["run"]


def rule_fixer():
    """A stand-in for a model: the fix names the rule, its confidence is the length of the rule's name."""
    def complete(prompts):
        rules = [re.search(r"\nRule: (.*)\n", p)[1] for p in prompts]
        return [json.dumps({"vulnerability": r, "severity": "s", "fix": f"safe({r})", "explanation": "e", "confidence": len(r) % 16 / 16}) for r in rules]
    return complete


@query("standard_fixes", _profiled() + f""", tried as (select distinct repo, path, start_line as line, 'safe(' || check_id || ')' as code, length(check_id) % 16 / 16 as c from pm),
    best as (select * from (select *, row_number() over (partition by repo, path, line order by c desc, code) as rn from tried where c >= 0.8) where rn = 1),
    al as (select repo, path, line, text from ({_lines('kept')})),
    done as (select al.repo, al.path, al.line, coalesce(best.code, al.text) as text, best.code is not null as fixed from al left join best on best.repo = al.repo and best.path = al.path and best.line = al.line)
    select repo, path, md5(string_agg(text, chr(10) order by line)) as content_md5, cast(count(*) filter (where fixed) as int) as n_fixes from done group by 1, 2 having bool_or(fixed)""")
def standard_fixes(spark, sf):
    changed = scans.run_standard(views.code_files(spark, sf), fixer=rule_fixer)["fixed_files"]
    return changed.select("repo", "path", F.md5("content").alias("content_md5"), "n_fixes")


def first_file_analyser():
    """A stand-in for a model: reports the first file of its list; one analyser never answers in JSON."""
    def complete(prompts):
        out = []
        for p in prompts:
            agent, file = re.search(r"analysis by (.*)\n", p)[1], re.search(r"Files:\n- (.*)\n", p)[1]
            found = {"type": "stub", "file": file, "line_start": 1, "line_end": 2, "severity": "HIGH", "confidence": 0.9, "description": agent}
            out.append("no idea" if agent == "code-xss-analyser" else json.dumps({"agent_id": agent, "vulnerabilities": [found], "patterns": []}))
        return out
    return complete


_FIRST_FILES = f"""with src as (select repo, path from v_code where {_SOURCE}), r as ({_routed(joins.agent_names())}),
    nr as (select *, (row_number() over (partition by repo, agent order by path) - 1) // 200 as part from r), ff as (select repo, agent, part, min(path) as path from nr group by all)"""


@query("orchestrated_agents", f"{_FIRST_FILES} select distinct repo, path, agent || '-stub' as check_id, cast(0.9 as double) as confidence, agent as message from ff where agent <> 'code-xss-analyser'")
def orchestrated_agents(spark, sf):
    found = scans.run_orchestrated(views.code_files(spark, sf), complete=first_file_analyser)["findings"]
    return found.where(F.col("check_id").endswith("-stub")).select("repo", "path", "check_id", "confidence", "message")


@query("orchestrated_errors", f"{_FIRST_FILES} select agent as agent_id, 'no JSON object' as error, count(*) as n from ff where agent = 'code-xss-analyser' group by 1")
def orchestrated_errors(spark, sf):
    errors = scans.run_orchestrated(views.code_files(spark, sf), complete=first_file_analyser)["errors"]
    return errors.groupBy("agent_id", "error").agg(F.count("*").alias("n"))
