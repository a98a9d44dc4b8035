"""Queries on reports, replies, prompts and reviewed findings."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from riskloom import dims
from riskloom.checks import sqltext as q
from riskloom.checks import views
from riskloom.checks.findings import _route_sql
from riskloom.checks.streams import work_folder
from riskloom.functions import text
from riskloom.operators import filters, fixes, joins, metrics, ranking
from riskloom.plans import review
from riskloom.sources import reports

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


# ------------------------------------------------------------------ reports
_BODY = "regexp_extract(raw, '(?s)(\\{.*\\})', 1)"
_REPORT_SHAPE = ('{"results": [{"check_id": "VARCHAR", "path": "VARCHAR", "start": {"line": "INTEGER"}, "end": {"line": "INTEGER"}, "extra": {"message": "VARCHAR", "lines": "VARCHAR", "metadata": {"impact": "VARCHAR"}}}], '
                 '"errors": [{"type": "VARCHAR", "level": "VARCHAR", "message": "VARCHAR", "code": "INTEGER", "path": "VARCHAR"}]}')
_DOCS = f"d as (select o_orderkey, {_BODY} as body, from_json(case when json_valid({_BODY}) then {_BODY} end, '{_REPORT_SHAPE}') as j from v_reports)"


@query("report_findings", f"""with {_DOCS}, r as (select o_orderkey, unnest(j.results) as r from d) select o_orderkey, r.path as path, r.start.line as start_line, r.end.line as end_line, r.check_id as check_id,
    r.extra.message as message, r.extra.lines as code, coalesce(r.extra.metadata.impact, '') as impact from r""")
def report_findings(spark, sf):
    return reports.parse_sast(views.reports(spark, sf), "raw", ("o_orderkey",))[0]


@query("report_errors", f"""with {_DOCS}, e as (select o_orderkey, unnest(j.errors) as e from d) select o_orderkey, e.type as type, e.level as level, e.message as message, e.code as code, e.path as path from e
    union all select o_orderkey, 'ParseError', 'error', body, null, null from d where body <> '' and not json_valid(body)""")
def report_errors(spark, sf):
    return reports.parse_sast(views.reports(spark, sf), "raw", ("o_orderkey",))[1]


@query("normalised_findings", f"""with {_DOCS}, r as (select o_orderkey, unnest(j.results) as r from d) select o_orderkey, r.check_id as type, {q.severity4("coalesce(r.extra.metadata.impact, '')")} as severity,
    cast(0.9 as double) as norm_confidence, trim(replace(r.extra.lines, chr(10), '')) as code_line from r""")
def normalised_findings(spark, sf):
    found = reports.parse_sast(views.reports(spark, sf), "raw", ("o_orderkey",))[0]
    return reports.to_vulnerabilities(found).select("o_orderkey", "type", "severity", "norm_confidence", "code_line")


_SERVICE_SHAPE = '{"findings": [{"rule_id": "VARCHAR", "path": "VARCHAR", "message": "VARCHAR", "severity": "VARCHAR", "start_line": "INTEGER", "code": "VARCHAR", "metadata": "MAP(VARCHAR, VARCHAR)"}], "errors": ["VARCHAR"]}'


@query("service_findings", f"""with f as (select o_orderkey, unnest(from_json(raw, '{_SERVICE_SHAPE}').findings) as f from v_services)
    select o_orderkey, f.rule_id as type, case f.severity when 'ERROR' then 'CRITICAL' when 'WARNING' then 'HIGH' when 'NOTE' then 'LOW' else 'MEDIUM' end as severity, cast(0.9 as double) as confidence,
    f.message as description, f.path as file, f.start_line as line, f.code as code, coalesce(f.metadata['cwe'], '') as cwe, coalesce(f.metadata['owasp'], '') as owasp from f""")
def service_findings(spark, sf):
    return reports.parse_service(views.services(spark, sf), "raw", ("o_orderkey",))[0]


@query("service_errors", "select o_orderkey, 'late' as message from v_services")
def service_errors(spark, sf):
    return reports.parse_service(views.services(spark, sf), "raw", ("o_orderkey",))[1]


_DET = "json_extract_string(raw, '$.DetectorName')"
_VER = "coalesce(cast(json_extract(raw, '$.Verified') as boolean), false)"


@query("reported_secrets", f"""with s as (select repo, raw, {_DET} as detector, {_VER} as verified, json_extract(raw, '$.SourceMetadata.Data.Filesystem') as fs, json_extract(raw, '$.SourceMetadata.Data.Git') as git
      from v_secret_lines where json_extract(raw, '$.SourceMetadata') is not null and coalesce({_DET}, '') <> '')
    select repo, coalesce(json_extract_string(coalesce(fs, git), '$.file'), '') as path, coalesce(cast(json_extract(coalesce(fs, git), '$.line') as int), 0) as line, detector, {q.secret_type('detector')} as secret_type,
    verified, coalesce(json_extract_string(raw, '$.Redacted'), '') as redacted, case when verified then '✅ Verified ' || {q.secret_type('detector')} || ' detected - This secret is valid and poses a security risk'
      else '⚠️ Potential ' || {q.secret_type('detector')} || ' detected - Verification needed to confirm if this is a valid secret' end as description from s""")
def reported_secrets(spark, sf):
    return reports.parse_secret_lines(views.secret_lines(spark, sf), "raw")


# ------------------------------------------------------------------ replies
@query("unwrapped_replies", """select conv_id, turn, md5(text) as text_md5, true as has_payload from conversations where role = 'assistant'""")
def unwrapped_replies(spark, sf):
    r = reports.extract_json(views.replies(spark, sf), "raw")
    return r.select("conv_id", "turn", F.md5(text.unwrap_reply(F.col("payload"))).alias("text_md5"),
                    text.json_payload(F.col("raw")).isNotNull().alias("has_payload"))


_AF = ["type", "file", "line_start", "line_end", "severity", "confidence", "description", "vulnerable_code", "secure_fix", "fix_explanation"]


@query("agent_findings", f"select repo, agent, o_orderkey, {', '.join(_AF)} from v_agent_findings")
def agent_findings(spark, sf):
    return _agent_findings(spark, sf).select("repo", "agent", "o_orderkey", *_AF)


def _agent_findings(spark, sf):
    return reports.parse_agent_replies(views.agent_replies(spark, sf), ("repo", "agent", "o_orderkey"))


@query("reply_errors", """select repo, agent, o_orderkey, case when regexp_extract(doc, '(?s)(\\{.*\\})', 1) = '' then 'no JSON object' else 'broken JSON' end as reason
    from v_agent_replies where not json_valid(regexp_extract(doc, '(?s)(\\{.*\\})', 1))""")
def reply_errors(spark, sf):
    return reports.reply_errors(views.agent_replies(spark, sf), ("repo", "agent", "o_orderkey"))


_TORN = "case when event_id % 50 = 0 then left(raw, length(raw) - 1) else raw end"    # as of a report that was cut off


@query("secret_errors", f"select repo, event_id, 'not JSON' as reason, raw as line from (select repo, event_id, {_TORN} as raw from v_secret_lines) where not json_valid(raw)")
def secret_errors(spark, sf):
    return reports.secret_errors(views.secret_lines(spark, sf).selectExpr("repo", "event_id", f"{_TORN} as raw"), "raw", ("repo", "event_id"))


@query("agent_patterns", """select repo, agent, o_orderkey, 'no validation' as pattern, 'a:1,b:2' as instances, 'add it' as recommendation from v_agent_replies where json_valid(regexp_extract(doc, '(?s)(\\{.*\\})', 1))""")
def agent_patterns(spark, sf):
    p = reports.agent_patterns(views.agent_replies(spark, sf), ("repo", "agent", "o_orderkey"))
    return p.withColumn("instances", F.array_join("instances", ","))


@query("converted_findings", """select repo, agent, agent || '-' || type as check_id, file as path, line_start as start_line, cast(1 as int) as start_col, line_end as end_line, cast(100 as int) as end_col, description as message,
    vulnerable_code as code, severity as impact, true as is_legitimate, confidence, fix_explanation as reasoning, description as context_analysis, secure_fix as recommended_action, '' as false_positive_reason, false as is_filtered from v_agent_findings""")
def converted_findings(spark, sf):
    return review.to_findings(_agent_findings(spark, sf))


_ENH = f"""select repo, o_orderkey, agent || '-' || type as check_id, file as path, line_start as start_line, line_end as end_line, severity as impact, confidence, description as message, vulnerable_code as code, secure_fix, fix_explanation from v_agent_findings"""


@query("enhanced_findings", f"""with f as ({_ENH}), k as (select * from (select *, row_number() over (partition by repo, path, start_line, check_id order by end_line, impact, confidence, message, code, secure_fix, fix_explanation) as rn from f) where rn = 1)
    select repo, format('VULN-{{:04d}}', row_number() over (partition by repo order by {q.rank_of('impact', dims.AGENT_SCALE)} desc, path, start_line, check_id)) as vuln_id, {q.agent_type('check_id')} as type, {q.cwe_of('check_id')} as cwe_id,
    impact as severity, printf('%.2f', confidence) as confidence, path as file, case when starts_with(code, 'def ') then split_part(code, ' ', 2) else 'unknown' end as function, message as sink,
    {q.case_map(q.agent_type('check_id'), dims.EXPLOIT_BY_TYPE, dims.DEFAULT_EXPLOIT)} as exploit_example, secure_fix as secure_code, fix_explanation from k""")
def enhanced_findings(spark, sf):
    e = review.enhance(_numbered(spark, sf))
    return e.select("repo", "vuln_id", "type", "cwe_id", "severity", "confidence", F.col("location.file").alias("file"),
                    F.col("location.function").alias("function"), F.col("data_flow.sink").alias("sink"), "exploit_example", "secure_code", "fix_explanation")


def _numbered(spark, sf):
    from riskloom.operators import dedup
    found = review.to_findings(_agent_findings(spark, sf))
    kept = dedup.dedup_agent(found.drop("agent"), ["end_line", "impact", "confidence", "message", "code", "recommended_action", "reasoning"])
    return ranking.number_findings(kept, [-ranking.agent_rank(F.col("impact")), "path", "start_line", "check_id"])


@query("secret_totals", f"""with f as ({_ENH}), r as (select repo, count(*) filter (where {q.any_contains('lower(check_id)', dims.SECRET_FINDING_WORDS)} or {q.any_contains('lower(message)', dims.SECRET_FINDING_WORDS)}) as raw_secrets from f group by 1),
    t as (select repo, count(*) filter (where {q.any_contains('lower(type)', dims.SECRET_TYPE_WORDS)}) as typed_secrets from v_agent_findings group by 1)
    select repo, coalesce(raw_secrets, 0) as raw_secrets, coalesce(typed_secrets, 0) as typed_secrets, coalesce(raw_secrets, 0) + coalesce(typed_secrets, 0) as total_secrets from r full join t using (repo)""")
def secret_totals(spark, sf):
    found = _agent_findings(spark, sf)
    return metrics.secret_totals(review.to_findings(found), found)


@query("model_cost", """select role as agent, count(*) as calls, cast(sum(length(text)) as bigint) as input_tokens, cast(sum(length(text) // 4) as bigint) as output_tokens,
    round((cast(sum(length(text)) as double) * 3.0 + cast(sum(length(text) // 4) as double) * 15.0) / 1e6, 6) as cost,
    round((cast(sum(length(text)) as double) * 3.0 + cast(sum(length(text) // 4) as double) * 15.0) / 1e6 / count(*), 6) as cost_per_call from conversations group by 1""")
def model_cost(spark, sf):
    rows = views.table(spark, sf, "conversations").selectExpr(
        "role as agent", "length(text) as input_tokens", "cast(floor(length(text) / 4) as bigint) as output_tokens")
    return metrics.cost(rows, 3.0, 15.0).withColumns({"cost": F.round("cost", 6), "cost_per_call": F.round("cost_per_call", 6)})


_ROUTED = "x as (" + " union all ".join(f"select repo, path, {q.quote(a)} as agent, {_route_sql(a)} as rel from v_files" for a in joins.agent_names()) + \
    "), routed as (select repo, path, agent from (select *, bool_or(rel) over (partition by repo, agent) as any_rel from x) where rel or not any_rel)"
_WHO = "(case cast(user_id % 4 as int) when 0 then 'code-injection-analyser' when 1 then 'code-xss-analyser' when 2 then 'code-path-analyser' else 'code-crypto-analyser' end)"


@query("agent_summary", f"""with {_ROUTED}, l as (select {_WHO} as agent, event_type as status, round(value, 6) as progress, event_id % 100 as files_processed, row_number() over (partition by {_WHO} order by ts desc, event_id desc) as rn from events),
    f as (select agent, count(*) as findings from v_agent_findings group by 1), a as (select agent, count(*) as files_assigned from routed group by 1)
    select a.agent, files_assigned, coalesce(files_processed, 0) as files_processed, coalesce(findings, 0) as findings, coalesce(status, 'pending') as status, coalesce(progress, 0.0) as progress
    from a left join l on a.agent = l.agent and rn = 1 left join f on a.agent = f.agent""")
def agent_summary(spark, sf):
    progress = views.table(spark, sf, "events").selectExpr(
        f"{_WHO} as agent", "event_type as status", "round(value, 6) as progress", "event_id % 100 as files_processed", "ts", "event_id")
    return metrics.agent_summary(joins.route_files(views.files(spark, sf), joins.agent_names()), progress, _agent_findings(spark, sf))


# ------------------------------------------------------------------ context and prompts
_ENTRY = " || ".join(f"case when count(*) filter (where lower(base) = {q.quote(n)}) > 0 then ', {n} (' || count(*) filter (where lower(base) = {q.quote(n)}) || ')' else '' end" for n in dims.ENTRY_POINT_NAMES)


def _words(words):
    return " || ".join(f"case when bool_or(contains(lower(name), {q.quote(w)})) then ', {w}' else '' end" for w in words)


def _context_sql():
    from riskloom.checks.files import SQL as files_sql
    from riskloom.checks.manifests import _CLASS, _DEPS
    return f"""{_DEPS}, arch as ({files_sql['architecture'].strip()}), en as (select repo, substr({_ENTRY}, 3) as entry_points from v_manifests group by 1),
    st as (select repo, min(case when {_CLASS['web']} then name end) as framework, substr({_words(dims.SECURITY_LIBRARY_WORDS)}, 3) as security_libraries, substr({_words(dims.DATABASE_WORDS)}, 3) as databases from deps group by 1)
    select a.repo, a.language, a.architecture, en.entry_points, coalesce(framework, '') as framework, coalesce(security_libraries, '') as security_libraries, coalesce(databases, '') as databases
    from arch a join en using (repo) left join st using (repo)"""


@query("repository_context", _context_sql())
def repository_context(spark, sf):
    return review.repo_context(views.manifests(spark, sf))


_CORE = q.case_map(q.EXT, dims.CORE_LANGUAGE_BY_EXTENSION)
_CTX = f"""ctx as (select repo, 'Language: ' || coalesce((list(language order by n desc, language) filter (where language is not null))[1], 'Unknown') || chr(10) || 'Architecture: Unknown' || chr(10) || 'Entry points: ' || chr(10)
      || 'Framework: ' || chr(10) || 'Security libraries: ' || chr(10) || 'Databases: ' || chr(10) || 'Known mitigations:' as ctx from (select repo, {_CORE} as language, count(*) as n from v_files group by 1, 2) group by 1)"""
_LS = "string_split(f.content, chr(10))"
_PAD = "case when length(cast(i as varchar)) < 4 then lpad(cast(i as varchar), 4, ' ') else cast(i as varchar) end"
_RICH = f"""{_CTX}, j as (select x.*, {_LS} as ls, len({_LS}) as n from v_file_findings x join v_files f on x.repo = f.repo and x.path = f.path), rich as (
    select j.*, ctx.ctx, array_to_string(ls[start_line:end_line], chr(10)) as vulnerable_code,
    array_to_string(list_transform(range(greatest(0, start_line - 10) + 1, least(n, end_line + 10) + 1), lambda i: case when i between start_line and end_line then '>>> ' else '    ' end || {_PAD} || ': ' || ls[i]), chr(10)) as marked,
    array_to_string(ls[greatest(1, start_line - 5):least(n, end_line + 5)], chr(10)) as around from j join ctx on j.repo = ctx.repo where end_line <= n)"""


def _sql_form(form: str, columns) -> str:
    """A format string as SQL concatenation."""
    pieces = form.replace("%d", "%s").split("%s")
    nl = lambda t: " || ".join(q.quote(p) for p in [t]).replace("\n", "' || chr(10) || '")
    return " || ".join([nl(pieces[0])] + [f"cast({c} as varchar) || {nl(p)}" for c, p in zip(columns, pieces[1:])])


_VPROMPT = _sql_form(review._VALIDATION_FORM, ["ctx", "check_id", "path", "start_line", "end_line", "impact", "message", "vulnerable_code", "marked"])
_FPROMPT = _sql_form(review._FIX_FORM, ["path", "check_id", "message", "impact", "start_line", "end_line", "vulnerable_code", "around"])
_KEYS = "repo, path, start_line, end_line, check_id"


@query("validation_prompts", f"with {_RICH} select {_KEYS}, md5({_VPROMPT}) as prompt_md5 from rich")
def validation_prompts(spark, sf):
    f = views.files(spark, sf)
    p = review.validation_prompts(views.file_findings(spark, sf), f, review.repo_context(f))
    return p.select(*review.FINDING_KEYS, F.md5("prompt").alias("prompt_md5"))


@query("fix_prompts", f"with {_RICH} select {_KEYS}, md5({_FPROMPT}) as prompt_md5 from rich")
def fix_prompts(spark, sf):
    p = review.fix_prompts(views.file_findings(spark, sf), views.files(spark, sf))
    return p.select(*review.FINDING_KEYS, F.md5("prompt").alias("prompt_md5"))


@query("agent_prompts", f"""with {_CTX}, {_ROUTED}, n as (select *, (row_number() over (partition by repo, agent order by path) - 1) // 20 + 1 as part from routed),
    l as (select repo, agent, part, count(*) as n_files, string_agg('- ' || path, chr(10) order by path) as files from n group by 1, 2, 3)
    select l.repo, agent, cast(part as int) as part, cast(n_files as int) as n_files, md5('Security analysis by ' || agent || chr(10) || 'Focus: ' || {q.case_map('agent', dims.AGENT_FOCUS, dims.DEFAULT_AGENT_FOCUS)} || chr(10) || chr(10) || ctx
      || chr(10) || chr(10) || 'Files:' || chr(10) || files || chr(10) || chr(10) || {q.case_map('agent', dims.AGENT_INSTRUCTIONS, dims.DEFAULT_AGENT_INSTRUCTIONS)} || chr(10) || chr(10)
      || 'Answer with one JSON object: agent_id, analysis_type, files_analyzed, vulnerabilities, patterns.') as prompt_md5 from l join ctx on l.repo = ctx.repo""")
def agent_prompts(spark, sf):
    f = views.files(spark, sf)
    p = review.agent_prompts(joins.route_files(f, joins.agent_names()), review.repo_context(f), size=20)
    return p.select("repo", "agent", "part", "n_files", F.md5("prompt").alias("prompt_md5"))


_COMMENTS = "select distinct 'src' || substr(repo, 2) as repo, comment_id, body from v_comments where role = 'user'"


@query("reply_prompts", f"""with n as (select *, row_number() over (partition by repo order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as n from v_fixes),
    t as (select repo, (n - 1) // 50 + 1 as part, 'Applied fixes:' || chr(10) || string_agg(n || '. ' || vulnerability || ' in ' || path || ' (lines ' || start_line || '-' || end_line || '): ' || description, chr(10) order by n) as summary from n group by all),
    c as ({_COMMENTS})
    select c.repo, c.comment_id, cast(coalesce(part, 1) as int) as part, md5('You help developers with automated security fixes.' || chr(10) || chr(10) || coalesce(summary, 'No fixes were applied.') || chr(10) || chr(10) || 'Comment:' || chr(10) || body || chr(10) || chr(10)
      || 'Answer the question briefly, with technical detail where it helps, and name the next step.') as prompt_md5 from c left join t on c.repo = t.repo""")
def reply_prompts(spark, sf):
    comments = (views.comments(spark, sf).where("role = 'user'")
                .select(F.concat(F.lit("src"), F.substring("repo", 2, 20)).alias("repo"), "comment_id", "body").distinct())
    p = review.reply_prompts(comments, views.fixes(spark, sf), views.ORDER)
    return p.select("repo", "comment_id", "part", F.md5("prompt").alias("prompt_md5"))


# ------------------------------------------------------------------ model calls, with a stand-in that answers from the prompt's hash
def stub_validator():
    def answer(digit):
        body = json.dumps({"is_legitimate": digit >= 4, "confidence": 0.5 if 4 <= digit < 8 else 0.9, "reasoning": "r", "context_analysis": "c",
                           "recommended_action": "a"})
        return "I cannot tell." if digit in (8, 9) else f"Here it is:\n{body}\nDone."

    answers = [answer(digit) for digit in range(16)]

    def complete(prompts):
        replies = [answers[hashlib.md5(prompt.encode()).digest()[0] >> 4] for prompt in prompts]
        return [review.Reply(reply, len(prompt), len(reply)) for prompt, reply in zip(prompts, replies)]
    return complete


def stub_fixer():
    def complete(prompts):
        out = []
        for prompt in prompts:
            digit = int(hashlib.md5(prompt.encode()).hexdigest()[0], 16)
            body = json.dumps({"vulnerability": "v", "severity": "s", "fix": f"safe({digit})", "explanation": "e", "confidence": digit / 16})
            out.append("Use a safe call." if digit == 15 else body)
        return out
    return complete


_HEX = "(instr('0123456789abcdef', left(md5(%s), 1)) - 1)"
_FIRST = "o as (select *, row_number() over (partition by repo, path, start_line, end_line, check_id order by l_orderkey, l_linenumber, l_partkey, l_suppkey, message, confidence) as rn from v_file_findings)"
_STABLE = _RICH.replace("from v_file_findings x join", "from (select * from o where rn = 1) x join")


def _one_per_key(spark, sf):
    """The first finding of each place and rule, and all findings, which name the same files."""
    found = views.file_findings(spark, sf)
    return ranking.keep_first(found, review.FINDING_KEYS, [*views.ORDER, "message", "confidence"]), found


@query("model_usage", f"""with {_FIRST}, {_STABLE}, p as (select {_VPROMPT} as prompt from rich) select count(*) as calls, cast(sum(length(prompt)) as bigint) as input_tokens, count(*) filter (where {_HEX % 'prompt'} in (8, 9)) as unparsed from p""")
def model_usage(spark, sf):
    f, (first, found) = views.files(spark, sf), _one_per_key(spark, sf)
    prompts = review.validation_prompts(first, f, review.repo_context(f), found)
    responses = review.infer(prompts, stub_validator)
    return responses.agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"),
                         F.count_if(F.col("reply") == "I cannot tell.").alias("unparsed"))


@query("kept_replies", f"""with {_FIRST}, {_STABLE}, p as (select {_VPROMPT} as prompt from rich)
    select count(*) as prompts, cast(sum(length(prompt)) as bigint) as input_tokens, count(*) filter (where {_HEX % 'prompt'} in (8, 9)) as unparsed,
    count(distinct prompt) as kept, 0::bigint as asked_again from p""")
def kept_replies(spark, sf):
    """All prompts by a store of replies, then once more: the second time the model isn't asked."""
    f, folder = views.files(spark, sf), work_folder(spark, "replies")
    distinct, found = _one_per_key(spark, sf)
    prompts = review.validation_prompts(distinct, f, review.repo_context(f), found)
    first = review.infer_stored(prompts, stub_validator, folder)
    again = review.infer_stored(prompts, no_client, folder)
    zero = F.lit(0).cast("bigint")
    rows = first.select(F.lit(1).alias("prompts"), "input_tokens", (F.col("reply") == "I cannot tell.").cast("int").alias("unparsed"),
                        zero.alias("kept"), zero.alias("asked_again")) \
        .union(review.stored_replies(spark, folder).select(zero, zero, zero, F.lit(1), zero)) \
        .union(again.select(zero, zero, zero, zero, F.col("error").isNotNull().cast("int")))
    return rows.agg(*[F.sum(c).alias(c) for c in rows.columns])


def no_client():
    raise RuntimeError("the store should have answered")


_REVIEWED = _FIRST.replace("order by l_orderkey, l_linenumber, l_partkey, l_suppkey, message, confidence", "order by impact, message, confidence, l_orderkey, l_linenumber, l_partkey, l_suppkey")


@query("validated_stage", f"""with {_REVIEWED}, {_STABLE}, p as (select {_KEYS}, {_HEX % ('(' + _VPROMPT + ')')} as d from rich)
    select {', '.join('o.' + k for k in _KEYS.split(', '))}, l_orderkey, l_linenumber, l_partkey, l_suppkey, case when p.d in (8, 9) or p.d is null then null else p.d >= 4 end as is_legitimate, case when p.d in (8, 9) or p.d is null then null when p.d between 4 and 7 then 0.5::double else 0.9::double end as validation_confidence
    from o left join p using ({_KEYS}) where p.d is null or p.d >= 8""")
def validated_stage(spark, sf):
    """Findings that repeat a place and rule are asked about once and judged alike."""
    f = views.files(spark, sf)
    kept = review.validate_stage(views.file_findings(spark, sf), f, review.repo_context(f), stub_validator)
    return kept.select(*review.FINDING_KEYS, *views.ORDER, "is_legitimate", "validation_confidence")


@query("parsed_fixes", f"""with {_FIRST}, {_STABLE}, p as (select {_KEYS}, impact, {_HEX % ('(' + _FPROMPT + ')')} as d from rich)
    select {_KEYS}, case when d = 15 then check_id else 'v' end as vulnerability, case when d = 15 then impact else 's' end as severity, case when d = 15 then {q.quote(dims.MANUAL_FIX_TEXT)} else 'safe(' || d || ')' end as fixed_code,
    case when d = 15 then 'Use a safe call.' else 'e' end as description, case when d = 15 then 0.6::double else round(d / 16, 6) end as confidence, d = 15 as manual, case when d < 15 and d / 16 >= 0.8 then 'accepted' else 'skipped' end as gate
    from p where d >= 8""")
def parsed_fixes(spark, sf):
    first, found = _one_per_key(spark, sf)
    prompts = review.fix_prompts(first, views.files(spark, sf), found)
    responses = review.infer(prompts, stub_fixer).join(prompts.drop("prompt"), "prompt_id")
    gated = filters.gate_fixes(review.parse_fixes(responses), 0.8)
    return gated.select(*review.FINDING_KEYS, "vulnerability", "severity", "fixed_code", "description",
                        F.round("confidence", 6).alias("confidence"), "manual", "gate")
