"""Queries on findings, secrets, validations and fixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import dims
from riskloom.checks import sqltext as q
from riskloom.checks import views
from riskloom.functions import findings as ff
from riskloom.functions import severity
from riskloom.operators import content, dedup, filters, fixes, joins, metrics, ranking, related

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


_ID = "repo, path, start_line, end_line, check_id, impact, l_orderkey, l_linenumber, l_partkey, l_suppkey"
_COLS = [c.strip() for c in _ID.split(",")]
_SEQ = "l_orderkey, l_linenumber, l_partkey, l_suppkey"

# ------------------------------------------------------------------ severity filters
for _level in ("WARNING", "error", "CRITICAL", "odd"):
    @query(f"scanner_severity_{_level.lower()}", f"select {_ID} from v_findings where "
           f"{q.rank_of(q.scanner_severity('impact'), dims.SCANNER_SCALE)} >= {dims.SCANNER_SCALE.get(_level.upper(), 1)}")
    def _scanner(spark, sf, level=_level):
        return filters.filter_scanner_severity(views.findings(spark, sf), level).select(*_COLS)

for _level in ("HIGH", "odd"):
    @query(f"four_level_severity_{_level.lower()}", f"select {_ID} from v_findings" + (
        f" where {q.rank_of('impact', dims.FOUR_LEVEL_SCALE)} >= 3" if _level == "HIGH" else ""))
    def _four(spark, sf, level=_level):
        return filters.filter_severity4(views.findings(spark, sf), level, "impact").select(*_COLS)

for _level in ("MEDIUM", "HIGH", "odd"):
    @query(f"report_severity_{_level.lower()}", f"select {_ID} from v_findings where "
           f"{q.rank_of(q.report_severity('impact'), dims.REPORT_SCALE)} >= {dims.REPORT_SCALE.get(_level, 1)}")
    def _report(spark, sf, level=_level):
        return filters.filter_report_severity(views.findings(spark, sf), level).select(*_COLS)


@query("report_eligible", f"select {_ID} from v_findings where upper(impact) in ('HIGH', 'MEDIUM', 'LOW')")
def report_eligible(spark, sf):
    return filters.report_eligible(views.findings(spark, sf)).select(*_COLS)


@query("report_eligible_with_critical", f"select {_ID} from v_findings where upper(impact) in ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')")
def report_eligible_with_critical(spark, sf):
    return filters.report_eligible(views.findings(spark, sf), ("CRITICAL", "HIGH", "MEDIUM", "LOW")).select(*_COLS)


_AGENT = "regexp_extract(check_id, '^(code-[a-z]+-analyser)', 1)"


@query("agent_confidence", f"select {_ID}, round(confidence, 6) as confidence from v_findings where confidence >= "
       f"{q.case_map(_AGENT, dims.AGENT_CONFIDENCE, 0.0)}")
def agent_confidence(spark, sf):
    kept = filters.filter_agent_confidence(views.findings(spark, sf))
    return kept.select(*_COLS, F.round("confidence", 6).alias("confidence"))


# ------------------------------------------------------------------ validation
_FF = "f.repo, f.path, f.start_line, f.end_line, f.check_id, f.l_orderkey, f.l_linenumber, f.l_partkey, f.l_suppkey"
_FFC = [c.strip()[2:] for c in _FF.split(",")]
_MARKED = f"""select {_FF}, v.is_legitimate, round(v.validation_confidence, 6) as validation_confidence,
    coalesce(not v.is_legitimate or v.validation_confidence < 0.7, false) as is_filtered
    from v_file_findings f left join v_validations v on f.repo = v.repo and f.path = v.path"""


def _validated(spark, sf):
    return joins.with_validation(views.file_findings(spark, sf), views.validations(spark, sf))


@query("findings_with_validation", _MARKED)
def findings_with_validation(spark, sf):
    marked = filters.mark_filtered(_validated(spark, sf))
    return marked.select(*_FFC, "is_legitimate", F.round("validation_confidence", 6).alias("validation_confidence"), "is_filtered")


@query("validation_filter", f"with m as ({_MARKED}) select {_FF.replace('f.', '')} from m where not is_filtered")
def validation_filter(spark, sf):
    return dedup.original_findings(filters.apply_validation(_validated(spark, sf)), _FFC)


@query("validation_disabled", f"select {_FF} from v_file_findings f")
def validation_disabled(spark, sf):
    return dedup.original_findings(filters.apply_validation(_validated(spark, sf), enabled=False), _FFC)


@query("validation_summary", f"""with m as ({_MARKED}) select repo, count(*) as total, count(*) filter (where not is_filtered) as legitimate,
    count(*) filter (where is_filtered) as filtered, round(cast(count(*) filter (where is_filtered) as double) / count(*) * 100.0, 6) as false_positive_rate from m group by 1""")
def validation_summary(spark, sf):
    summary = metrics.validation_summary(filters.mark_filtered(_validated(spark, sf)))
    return summary.withColumn("false_positive_rate", F.round("false_positive_rate", 6))


# ------------------------------------------------------------------ scalar expressions
@query("severity_names", f"""select distinct impact, {q.scanner_severity('impact')} as scanner, {q.report_severity('impact')} as report,
    {q.severity4('impact')} as four, case upper(impact) when 'CRITICAL' then 'immediate' when 'HIGH' then 'this week' else 'this month' end as horizon,
    case {q.scanner_severity('impact')} when 'ERROR' then 'CRITICAL' when 'CRITICAL' then 'CRITICAL' when 'WARNING' then 'HIGH' when 'INFO' then 'MEDIUM' else 'MEDIUM' end as from_level
    from (select impact from v_findings union all select lower(impact) from v_findings)""")
def severity_names(spark, sf):
    f = views.findings(spark, sf).select("impact")
    i = F.col("impact")
    both = f.unionAll(f.select(F.lower(i).alias("impact")))
    return both.select("impact", severity.scanner_severity(i).alias("scanner"), severity.report_severity(i).alias("report"),
                       severity.severity4_from_impact(i).alias("four"), severity.horizon(i).alias("horizon"),
                       severity.severity4_from_level(severity.scanner_severity(i)).alias("from_level")).distinct()


@query("finding_names", f"""select distinct check_id, translate(regexp_extract(check_id, '([^.]*)$', 1), '-', ' ') as rule_type, {q.clean_title('check_id')} as title,
    {q.agent_type('check_id')} as agent_type, {q.cwe_of('check_id')} as cwe,
    {q.case_map(q.agent_type('check_id'), dims.EXPLOIT_BY_TYPE, dims.DEFAULT_EXPLOIT)} as exploit,
    {q.case_map(q.agent_type('check_id'), dims.SYSTEMIC_FIX_BY_TYPE, dims.DEFAULT_SYSTEMIC_FIX)} as systemic_fix,
    {q.any_contains('lower(check_id)', dims.SECRET_FINDING_WORDS)} as is_secret, {q.any_contains("lower(replace(check_id, 'api_key', 'api_key_exposure'))", dims.SECRET_TYPE_WORDS)} as is_secret_type,
    {q.case_map(_AGENT, dims.AGENT_FOCUS, dims.DEFAULT_AGENT_FOCUS)} as focus, {q.case_map(_AGENT, dims.AGENT_INSTRUCTIONS, dims.DEFAULT_AGENT_INSTRUCTIONS)} as instructions
    from (select check_id from v_findings union all select check_id from v_dotted)""")
def finding_names(spark, sf):
    c = F.col("check_id")
    both = views.findings(spark, sf).select("check_id").unionAll(views.dotted(spark, sf).select("check_id"))
    return both.select(
        "check_id", ff.rule_type(c).alias("rule_type"), ff.clean_title(c).alias("title"), ff.agent_type(c).alias("agent_type"),
        ff.cwe_of(c).alias("cwe"), ff.exploit_of(ff.agent_type(c)).alias("exploit"),
        ff.systemic_fix_of(ff.agent_type(c)).alias("systemic_fix"), ff.is_secret_finding(c, F.lit("")).alias("is_secret"),
        ff.is_secret_type(F.replace(c, F.lit("api_key"), F.lit("api_key_exposure"))).alias("is_secret_type"),
        ff.agent_focus(filters.agent_of(c)).alias("focus"), ff.agent_instructions(filters.agent_of(c)).alias("instructions")).distinct()


_CODE = "(chr(10) || '  ' || case l_linenumber % 3 when 0 then 'def run_' || l_orderkey || '(x):' when 1 then '  async function go (' else 'x = 1  ' end || chr(10) || 'y')"


@query("code_parts", f"""select distinct code, case l_linenumber % 3 when 0 then 'run_' || l_orderkey || '(x):' when 1 then 'go' else 'unknown' end as function,
    trim(string_split(code, chr(10))[2]) as first_line from (select l_linenumber, l_orderkey, {_CODE} as code from lineitem)""")
def code_parts(spark, sf):
    code = views.table(spark, sf, "lineitem").selectExpr(f"{_CODE} as code")
    return code.select("code", ff.function_name(F.col("code")).alias("function"),
                       ff.first_code_line(F.col("code")).alias("first_line")).distinct()


# ------------------------------------------------------------------ counts
@query("severity_counts", f"select repo, {q.scanner_severity('impact')} as severity, count(*) as n from v_findings group by 1, 2")
def severity_counts(spark, sf):
    return metrics.severity_counts(views.findings(spark, sf), severity.scanner_severity(F.col("impact")))


@query("severity_summary", f"""select repo, count(*) as total_findings, """ + ", ".join(
    f"count(*) filter (where {q.severity4('impact')} = '{s}') as {s.lower()}_count" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")) + " from v_findings group by 1")
def severity_summary(spark, sf):
    return metrics.severity_summary(views.findings(spark, sf), severity.severity4_from_impact(F.col("impact")))


@query("type_counts", "select repo, translate(regexp_extract(check_id, '([^.]*)$', 1), '-', ' ') as type, count(*) as n from v_dotted group by 1, 2")
def type_counts(spark, sf):
    return metrics.type_counts(views.dotted(spark, sf))


_SHOWN = f"""select *, {q.clean_title('check_id')} as title, {q.report_severity('impact')} as severity from v_dotted where upper(impact) in (%s)"""
_TITLES = f"""with s as ({_SHOWN}), f as (select *, row_number() over (partition by repo order by {q.report_rank('severity')}, title, path, start_line, {_SEQ}) as rn from s),
    c as (select repo, title, count(*) as n, min(rn) as first from f group by 1, 2)
    select repo, title, n, cast(row_number() over (partition by repo order by n desc, first) as int) as position from c"""


@query("report_titles", _TITLES % "'HIGH', 'MEDIUM', 'LOW'")
def report_titles(spark, sf):
    return metrics.report_metrics(views.dotted(spark, sf))[0]


@query("report_titles_with_critical", _TITLES % "'CRITICAL', 'HIGH', 'MEDIUM', 'LOW'")
def report_titles_with_critical(spark, sf):
    return metrics.report_metrics(views.dotted(spark, sf), ("CRITICAL", "HIGH", "MEDIUM", "LOW"))[0]


@query("report_severities", f"""with s as ({_SHOWN % "'HIGH', 'MEDIUM', 'LOW'"}) select repo, severity, count(*) as n from s group by 1, 2""")
def report_severities(spark, sf):
    return metrics.report_metrics(views.dotted(spark, sf))[1]


@query("display_severities", f"""with s as ({_SHOWN % "'HIGH', 'MEDIUM', 'LOW'"}), c as (select severity, count(*) as n from s group by 1)
    select severity, n, cast({q.report_rank('severity')} as int) as position from c where n > 0""")
def display_severities(spark, sf):
    counts = metrics.report_findings(views.dotted(spark, sf)).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return ranking.display_severities(counts)


@query("findings_by_file", f"""select repo, path, cast(1 as int) as part, string_agg(start_line || '-' || end_line || ':' || check_id, ',' order by {_SEQ}) as findings from v_findings group by 1, 2""")
def findings_by_file(spark, sf):
    lists = metrics.by_file(views.findings(spark, sf), views.ORDER, size=1_000_000)
    return lists.withColumn("findings", F.array_join("findings", ","))


@query("findings_by_file_parts", f"""with n as (select *, (row_number() over (partition by repo, path order by {_SEQ}) - 1) // 7 + 1 as part from v_findings)
    select repo, path, cast(part as int) as part, string_agg(start_line || '-' || end_line || ':' || check_id, ',' order by {_SEQ}) as findings from n group by 1, 2, 3""")
def findings_by_file_parts(spark, sf):
    lists = metrics.by_file(views.findings(spark, sf), views.ORDER, size=7)
    return lists.withColumn("findings", F.array_join("findings", ","))


@query("code_metrics", """select repo, count(distinct path) as files_analyzed, count(*) as total, round(cast(count(*) as double) / count(distinct path), 6) as density, """ + ", ".join(
    f"count(*) filter (where impact = '{s}') as {s.lower()}" for s in dims.REPORT_DISPLAY_ORDER) + " from v_findings group by 1")
def code_metrics(spark, sf):
    return metrics.code_metrics(views.findings(spark, sf)).withColumn("density", F.round("density", 6))


@query("systemic_patterns", f"""with c as (select repo, {q.agent_type('check_id')} as type, count(*) as n from v_findings group by 1, 2 having count(*) >= 2)
    select repo, type, n, format('PATTERN-{{:03d}}', row_number() over (partition by repo order by n desc, type)) as pattern_id,
    'Systemic ' || type || ' vulnerabilities found across ' || n || ' locations' as description,
    {q.case_map('type', dims.SYSTEMIC_FIX_BY_TYPE, dims.DEFAULT_SYSTEMIC_FIX)} as systemic_fix from c""")
def systemic_patterns(spark, sf):
    return metrics.systemic_patterns(views.findings(spark, sf))


@query("pattern_locations", f"""with n as (select *, {q.agent_type('check_id')} as type from v_findings),
    p as (select *, (row_number() over (partition by repo, type order by {_SEQ}) - 1) // 50 + 1 as part from n)
    select repo, type, cast(part as int) as part, string_agg(path || ':' || start_line, ',' order by {_SEQ}) as locations from p group by 1, 2, 3""")
def pattern_locations(spark, sf):
    return metrics.pattern_locations(views.findings(spark, sf), views.ORDER, 50).withColumn("locations", F.array_join("locations", ","))


@query("component_rollup", f"""select split_part(path, '/', 1) as component, {q.report_severity('impact')} as severity, count(*) as n, cast(grouping(split_part(path, '/', 1), {q.report_severity('impact')}) as int) as level
    from (select path, impact from v_file_findings) group by rollup (split_part(path, '/', 1), {q.report_severity('impact')})""")
def component_rollup(spark, sf):
    return metrics.component_rollup(views.file_findings(spark, sf))


@query("distinct_types", f"select repo, count(distinct {q.clean_title('check_id')}) as types from v_dotted group by 1")
def distinct_types(spark, sf):
    return metrics.distinct_types(views.dotted(spark, sf))


@query("distinct_types_approx", f"select repo, count(distinct {q.clean_title('check_id')}) as types, true as is_close from v_dotted group by 1")
def distinct_types_approx(spark, sf):
    """The estimate lies within a tenth (or one) of the exact count."""
    rows = views.dotted(spark, sf)
    guess = metrics.distinct_types(rows, approx=True).withColumnRenamed("types", "guess")
    return metrics.distinct_types(rows).join(guess, "repo").select(
        "repo", "types", (F.abs(F.col("guess") - F.col("types")) <= F.greatest(F.lit(1.0), F.col("types") * 0.1)).alias("is_close"))


@query("finding_density", f"""with c as (select repo, path, count(*) as n from v_file_findings group by 1, 2),
    w as (select *, row_number() over (partition by repo order by n desc, path) as rn from c),
    r as (select repo, cast(sum(n) as bigint) as findings, max(n) as worst_count, max(case when rn = 1 then path end) as worst_file from w group by 1),
    l as (select repo, cast(sum(case when {q.in_list(q.EXT, dims.CODE_EXTENSIONS)} then len(string_split(content, chr(10))) else 0 end) as bigint) as loc from v_files group by 1)
    select repo, findings, loc, case when loc > 0 then round(cast(findings as double) * 1000.0 / loc, 6) end as per_kloc, worst_file, worst_count from r join l using (repo)""")
def finding_density(spark, sf):
    d = metrics.density(views.file_findings(spark, sf), views.files(spark, sf))
    return d.withColumn("per_kloc", F.round(F.col("per_kloc").cast("double"), 6))


@query("run_summary", """with p as (select 'run' || l_linenumber as run_id, 'findings' as kind, l_suppkey as repo from lineitem
    union all select 'run' || l_linenumber, 'secrets', l_suppkey from lineitem where l_returnflag = 'R'
    union all select 'run' || l_linenumber, 'fixes', l_suppkey from lineitem where l_quantity > 40
    union all select 'run' || l_linenumber, 'errors', l_suppkey from lineitem where l_discount = 0 and l_linenumber > 2),
    k as (select run_id, kind, count(*) as n from p group by 1, 2), d as (select run_id, count(distinct repo) as repos from p group by 1)
    select run_id, cast(coalesce(sum(n) filter (where kind = 'findings'), 0) as bigint) as findings, cast(coalesce(sum(n) filter (where kind = 'secrets'), 0) as bigint) as secrets,
    cast(coalesce(sum(n) filter (where kind = 'fixes'), 0) as bigint) as fixes, cast(coalesce(sum(n) filter (where kind = 'errors'), 0) as bigint) as errors, any_value(repos) as repos from k join d using (run_id) group by 1""")
def run_summary(spark, sf):
    rows = views.table(spark, sf, "lineitem").selectExpr(
        "'run' || l_linenumber as run_id", "l_suppkey as repo", "l_returnflag", "l_quantity", "l_discount", "l_linenumber")
    return metrics.run_summary(rows, rows.where("l_returnflag = 'R'"), rows.where("l_quantity > 40"),
                               rows.where("l_discount = 0 and l_linenumber > 2"))


# ------------------------------------------------------------------ ranks and sorts
@query("top_files", """with c as (select repo, path, count(*) as n from v_findings group by 1, 2),
    r as (select *, cast(row_number() over (partition by repo order by n desc, path) as int) as rank from c)
    select repo, path, n, rank, path || ' (' || n || ' vulns)' as label from r where rank <= 5""")
def top_files(spark, sf):
    return ranking.top_files(views.findings(spark, sf))


@query("finding_numbers", f"""select repo, path, start_line, check_id, {_SEQ}, format('VULN-{{:04d}}', row_number() over (partition by repo order by {q.rank_of('impact', dims.AGENT_SCALE)} desc, path, start_line, check_id, {_SEQ})) as vuln_id from v_findings""")
def finding_numbers(spark, sf):
    order = [-ranking.agent_rank(F.col("impact")), "path", "start_line", "check_id", *views.ORDER]
    numbered = ranking.number_findings(views.findings(spark, sf), order)
    return numbered.select("repo", "path", "start_line", "check_id", *views.ORDER, "vuln_id")


for _gap, _name in ((0, "merged_ranges"), (1, "merged_adjacent_ranges")):
    @query(_name, f"""with b as (select *, max(end_line) over (partition by repo, path order by start_line, end_line, l_orderkey, l_linenumber, l_partkey rows between unbounded preceding and 1 preceding) as reach from v_findings),
        i as (select *, sum(case when reach is null or start_line > reach + {_gap} then 1 else 0 end) over (partition by repo, path order by start_line, end_line, l_orderkey, l_linenumber, l_partkey rows unbounded preceding) as island from b)
        select repo, path, min(start_line) as start_line, max(end_line) as end_line, count(*) as n_findings from i group by repo, path, island""")
    def _merged(spark, sf, gap=_gap):
        return ranking.merge_ranges(views.findings(spark, sf), gap)


@query("sorted_findings", f"""with s as ({_SHOWN % "'HIGH', 'MEDIUM', 'LOW'"}) select repo, severity, title, path, start_line, {_SEQ} from s""")
def sorted_findings(spark, sf):
    shown = ranking.sort_findings(metrics.report_findings(views.dotted(spark, sf)))
    return shown.select("repo", "severity", "title", "path", "start_line", *views.ORDER)


for _compat in (False, True):
    _scale = dims.AGENT_SCALE_COMPAT if _compat else dims.AGENT_SCALE
    @query("worst_findings" + ("_compat" if _compat else ""), f"""select {_ID} from v_findings order by {q.rank_of('impact', _scale)} desc, path, start_line, check_id, repo, {_SEQ} limit 500""")
    def _worst(spark, sf, compat=_compat):
        order = [ranking.agent_rank(F.col("impact"), compat).desc(), "path", "start_line", "check_id", "repo", *views.ORDER]
        return ranking.top_k(views.findings(spark, sf), order, 500).select(*_COLS)


# ------------------------------------------------------------------ dedup and set operations
_FIRST = "select {cols} from (select *, row_number() over (partition by {keys} order by {seq}) as rn from {src}) where rn = 1"


@query("dedup_scanner", _FIRST.format(cols=_ID, keys="repo, path, start_line, end_line, check_id", seq=_SEQ, src="v_findings"))
def dedup_scanner(spark, sf):
    return dedup.dedup_scanner(views.findings(spark, sf).select(*_COLS), views.ORDER)


@query("dedup_agent", _FIRST.format(cols=_ID, keys="repo, path, start_line, check_id", seq=_SEQ, src="v_findings"))
def dedup_agent(spark, sf):
    return dedup.dedup_agent(views.findings(spark, sf).select(*_COLS), views.ORDER)


_LINKED = f"""(select *, repo || '/blob/main/' || path || '#L' || start_line as link, {q.clean_title('check_id')} as title from v_dotted)"""


@query("dedup_report", _FIRST.format(cols=f"link, start_line, end_line, title, impact, {_SEQ}", keys="link, start_line, end_line, title", seq=_SEQ, src=_LINKED))
def dedup_report(spark, sf):
    linked = views.dotted(spark, sf).select(
        F.concat(F.col("repo").cast("string"), F.lit("/blob/main/"), "path", F.lit("#L"), F.col("start_line").cast("string")).alias("link"),
        "start_line", "end_line", ff.clean_title(F.col("check_id")).alias("title"), "impact", *views.ORDER)
    return dedup.dedup_report(linked, views.ORDER)


@query("collected_agents", _FIRST.format(cols=_ID, keys="repo, path, start_line, check_id", seq=_SEQ, src="v_findings"))
def collected_agents(spark, sf):
    f = views.findings(spark, sf).select(*_COLS)
    return dedup.collect_agents(f.where(filters.agent_of(F.col("check_id")).isin(joins.agent_names())), order=views.ORDER)


@query("merged_sources", f"""select repo, path, start_line, check_id, cast(null as varchar) as detector, 'scanner' as origin from v_findings where l_linenumber = 1
    union all select repo, path, start_line, null, 'token', 'secret' from v_findings where l_linenumber = 2
    union all select repo, path, start_line, check_id, null, 'agent' from v_findings where l_linenumber > 2""")
def merged_sources(spark, sf):
    f = views.findings(spark, sf)
    cols = ("repo", "path", "start_line")
    return dedup.merge_sources(
        f.where("l_linenumber = 1").select(*cols, "check_id"),
        f.where("l_linenumber = 2").select(*cols, F.lit("token").alias("detector")),
        f.where("l_linenumber > 2").select(*cols, "check_id"))


@query("cross_agent_merge", f"""select repo, path, start_line, {q.agent_type("check_id")} as type, string_agg(distinct {_AGENT}, ',' order by {_AGENT}) as agents, count(*) as n
    from v_findings group by 1, 2, 3, 4""")
def cross_agent_merge(spark, sf):
    merged = dedup.merge_cross_agent(views.findings(spark, sf))
    return merged.withColumn("agents", F.array_join("agents", ","))


def _related_sql(by):
    keys = ", ".join(("repo", "path", *by))
    rank = "case impact " + " ".join(f"when '{k}' then {v}" for k, v in dims.AGENT_SCALE.items()) + " else 0 end"
    return f"""with f as (select *, {_AGENT} as agent, {q.agent_type("check_id")} as type from v_findings),
    s as (select {keys}, start_line, max(end_line) as reach from f group by all),
    o as (select *, max(reach) over (partition by {keys} order by start_line rows between unbounded preceding and 1 preceding) as before from s),
    g as (select {keys}, start_line, max(case when before is null or start_line > before then start_line end) over (partition by {keys} order by start_line) as first from o)
    select {keys}, first as start_line, max(end_line) as end_line, string_agg(distinct agent, ',' order by agent) as agents, count(distinct type) as n_types,
    max({{'rank': {rank}, 'impact': impact}}).impact as impact, count(*) as n, count(distinct agent) > 1 as corroborated from f join g using ({keys}, start_line) group by {keys}, first"""


@query("related_findings", _related_sql(()))
def related_findings(spark, sf):
    found = related.related_findings(views.findings(spark, sf))
    return found.withColumn("agents", F.array_join("agents", ",")).withColumn("n_types", F.size("types").cast("bigint")).drop("types")


@query("related_by_impact", _related_sql(("impact",)).replace("'impact': impact}).impact as impact", "'impact': impact}).rank as worst"))
def related_by_impact(spark, sf):
    """Groups within an impact, in blocks so small that a file has several."""
    found = related.related_findings(views.findings(spark, sf).withColumn("kind", F.col("impact")), by=("kind",), block=7)
    worst = ranking.agent_rank(F.col("impact")).alias("worst")
    return found.select("repo", "path", F.col("kind").alias("impact"), "start_line", "end_line", F.array_join("agents", ",").alias("agents"),
                        F.size("types").cast("bigint").alias("n_types"), worst, "n", "corroborated")


# ------------------------------------------------------------------ joins
@query("findings_without_file", "select f.repo, f.path, f.start_line from v_findings f where f.path not in ('src/p1.py', 'src/p3.py')")
def findings_without_file(spark, sf):
    f = views.findings(spark, sf).select("repo", "path", "start_line")
    known = f.select("path").where(F.col("path").isin("src/p1.py", "src/p3.py"))
    return joins.unmatched(f, known, ["path"]).select("repo", "path", "start_line")


@query("files_without_findings", "select repo, path from v_files f where not exists (select 1 from v_file_findings x where x.repo = f.repo and x.path = f.path)")
def files_without_findings(spark, sf):
    return joins.unmatched(views.files(spark, sf).select("repo", "path"), views.file_findings(spark, sf), ["repo", "path"])


@query("files_with_findings", "select repo, path from v_files f where exists (select 1 from v_file_findings x where x.repo = f.repo and x.path = f.path)")
def files_with_findings(spark, sf):
    return joins.matched(views.files(spark, sf).select("repo", "path"), views.file_findings(spark, sf), ["repo", "path"])


@query("agents_without_analysis", """select 'agent_' || user_id as agent_id, 'analysis not found for agent agent_' || user_id as error
    from (select distinct user_id from events) where user_id % 7 not in (select o_custkey % 7 from orders where o_custkey % 7 < 5)""")
def agents_without_analysis(spark, sf):
    agents = views.table(spark, sf, "events").selectExpr("'agent_' || user_id as agent_id", "user_id % 7 as analysis_id").distinct()
    analyses = views.table(spark, sf, "orders").selectExpr("o_custkey % 7 as analysis_id").where("analysis_id < 5").distinct()
    return joins.assign_analysis(agents, analyses)[1]


@query("agents_with_analysis", """select 'agent_' || user_id as agent_id, user_id % 7 as analysis_id, 'focus ' || user_id % 7 as focus
    from (select distinct user_id from events) where user_id % 7 in (select o_custkey % 7 from orders where o_custkey % 7 < 5)""")
def agents_with_analysis(spark, sf):
    agents = views.table(spark, sf, "events").selectExpr("'agent_' || user_id as agent_id", "user_id % 7 as analysis_id").distinct()
    analyses = views.table(spark, sf, "orders").selectExpr(
        "o_custkey % 7 as analysis_id", "'focus ' || o_custkey % 7 as focus").where("analysis_id < 5").distinct()
    return joins.assign_analysis(agents, analyses)[0]


def _route_sql(agent):
    if agent not in dims.AGENT_RELEVANCE:
        return "true"
    extensions, words = dims.AGENT_RELEVANCE[agent]
    parts = [q.any_contains(f"lower({q.BASE})", words)] + ([q.in_list(q.EXT, extensions)] if extensions else [])
    return "(" + " or ".join(parts) + ")"


_ROUTES = "with p as (select 'd' || o_custkey || '_' || o_orderkey % 3 as repo, path, base from (select path, base, o_orderkey, substr(repo, 2) as o_custkey from v_manifests)), x as (" + " union all ".join(
    f"select repo, path, {q.quote(a)} as agent, {_route_sql(a)} as rel from p" for a in joins.agent_names()) + \
    "), y as (select *, bool_or(rel) over (partition by repo, agent) as any_rel from x) select repo, path, agent from y where rel or not any_rel"


def route_inputs(spark, sf):
    return views.manifests(spark, sf).select(
        F.concat(F.lit("d"), F.substring("repo", 2, 20), F.lit("_"), (F.col("o_orderkey") % 3).cast("string")).alias("repo"), "path")


@query("routed_files", _ROUTES)
def routed_files(spark, sf):
    return joins.route_files(route_inputs(spark, sf), joins.agent_names())


_LINES = "string_split(f.content, chr(10))"
_JOINED = f"select x.*, {_LINES} as ls, len({_LINES}) as n from v_file_findings x join v_files f on x.repo = f.repo and x.path = f.path"
_CTX_ID = ["repo", "path", "start_line", "end_line", "check_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_CTX = ", ".join(_CTX_ID)
_PAD = "case when length(cast(%s as varchar)) < 4 then lpad(cast(%s as varchar), 4, ' ') else cast(%s as varchar) end" % (("i",) * 3)
_SNIP = "md5(array_to_string(ls[start_line:end_line], chr(10)))"


@query("code_snippets", f"with j as ({_JOINED}) select {_CTX}, case when end_line <= n then {_SNIP} else md5('') end as code_md5 from j")
def code_snippets(spark, sf):
    s = content.snippets(views.file_findings(spark, sf), views.files(spark, sf))
    return s.select(*_CTX_ID, F.md5("snippet").alias("code_md5"))


@query("numbered_context", f"""with j as ({_JOINED}) select {_CTX}, case when end_line <= n then {_SNIP} else md5('') end as code_md5,
    md5(array_to_string(list_transform(range(greatest(1, start_line - 5), least(n, end_line + 5) + 1), lambda i: {_PAD} || ': ' || ls[i]), chr(10))) as context_md5 from j""")
def numbered_context(spark, sf):
    c = content.numbered_context(views.file_findings(spark, sf), views.files(spark, sf))
    return c.select(*_CTX_ID, F.md5("vulnerable_code").alias("code_md5"), F.md5("context").alias("context_md5"))


@query("marked_context", f"""with j as ({_JOINED}) select {_CTX}, {_SNIP} as code_md5,
    md5(array_to_string(list_transform(range(greatest(0, start_line - 10) + 1, least(n, end_line + 10) + 1),
      lambda i: case when i between start_line and end_line then '>>> ' else '    ' end || {_PAD} || ': ' || ls[i]), chr(10))) as context_md5 from j where end_line <= n""")
def marked_context(spark, sf):
    c = content.marked_context(views.file_findings(spark, sf), views.files(spark, sf))
    return c.select(*_CTX_ID, F.md5("vulnerable_code").alias("code_md5"), F.md5("context").alias("context_md5"))


@query("fix_context", f"""with j as ({_JOINED}) select {_CTX}, {_SNIP} as code_md5,
    md5(array_to_string(ls[greatest(1, start_line - 5):least(n, end_line + 5)], chr(10))) as context_md5 from j where end_line <= n""")
def fix_context(spark, sf):
    c = content.fix_context(views.file_findings(spark, sf), views.files(spark, sf))
    return c.select(*_CTX_ID, F.md5("vulnerable_code").alias("code_md5"), F.md5("context").alias("context_md5"))


# ------------------------------------------------------------------ fixes
@query("fix_gates", f"select {_SEQ}, round(confidence, 6) as confidence, case when confidence < 0.5 then 'rejected' when confidence < 0.8 then 'skipped' else 'accepted' end as gate from v_fixes")
def fix_gates(spark, sf):
    gated = filters.gate_fixes(views.fixes(spark, sf))
    return gated.select(*views.ORDER, F.round("confidence", 6).alias("confidence"), "gate")


_TRIED = """(case cast(l_orderkey % 6 as int) when 0 then '  ' || chr(10) when 1 then ' x = 1 ' when 2 then '// note' || chr(10) || '  # more' || chr(10)
    when 3 then '# note' || chr(10) || 'y = 2' when 4 then 'x = 1' else 'z(' || l_linenumber || ')' end)"""


@query("valid_fixes", f"select {_SEQ} from (select *, {_TRIED} as fixed_code from lineitem) where l_orderkey % 6 in (3, 5)")
def valid_fixes(spark, sf):
    rows = views.table(spark, sf, "lineitem").selectExpr("*", f"{_TRIED} as fixed_code", "'x = 1' as original_code")
    return filters.valid_fixes(rows).select(*views.ORDER)


# Fixes in order of confidence over the whole file; each is taken if it touches none taken before.
_JUDGED = f"""z as (select repo, path, len({_LINES.replace('f.', '')}) as n from v_files),
    c as (select x.*, z.n, case when z.n is null then 'missing' when x.end_line > z.n then 'invalid' else 'candidate' end as st from v_fixes x left join z on x.repo = z.repo and x.path = z.path),
    tried as (select repo, path, list(distinct {{'c': -confidence, 's': start_line, 'e': end_line, 'code': fixed_code}}) as l from c where st = 'candidate' group by 1, 2),
    taken as (select repo, path, list_reduce(list_transform(list_sort(l), lambda x: [x]), lambda acc, x: case when len(list_filter(acc, lambda t: t.s <= x[1].e and x[1].s <= t.e)) > 0 then acc else list_concat(acc, x) end) as l from tried),
    w as (select repo, path, unnest(l) as t from taken), a as (select repo, path, t.s as start_line, t.e as end_line, t.code as fixed_code, -t.c as confidence from w)"""


@query("fix_status", f"""with {_JUDGED}
    select c.repo, c.path, c.start_line, c.end_line, {_SEQ}, case when st <> 'candidate' then st when a.repo is not null then 'applied' else 'overlapped' end as status
    from c left join a on a.repo = c.repo and a.path = c.path and a.start_line = c.start_line and a.end_line = c.end_line and a.fixed_code = c.fixed_code and a.confidence = c.confidence""")
def fix_status(spark, sf):
    chosen = fixes.select_fixes(views.files(spark, sf), views.fixes(spark, sf))
    return chosen.select("repo", "path", "start_line", "end_line", *views.ORDER, "status")


@query("single_fix_files", f"""with z as (select f.*, x.start_line, x.end_line, x.fixed_code from v_files f join (
      select doc_id, cast(doc_id % 4 + 1 as int) as start_line, cast(doc_id % 4 + 1 + doc_id % 2 as int) as end_line, 'patched ' || doc_id || chr(10) || 'twice' as fixed_code from v_files) x using (doc_id)),
    w as (select repo, path, content, fixed_code, start_line, end_line, string_split(content, chr(10)) as ls from z)
    select repo, path, case when end_line <= len(ls) then md5(array_to_string(list_concat(list_concat(ls[1:start_line - 1], string_split(fixed_code, chr(10))), ls[end_line + 1:]), chr(10))) else md5(content) end as content_md5,
    cast(case when end_line <= len(ls) then 1 else 0 end as int) as n_fixes from w""")
def single_fix_files(spark, sf):
    f = views.files(spark, sf)
    one = f.selectExpr("repo", "path", "cast(doc_id % 4 + 1 as int) as start_line", "cast(doc_id % 4 + 1 + doc_id % 2 as int) as end_line",
                       "'patched ' || doc_id || chr(10) || 'twice' as fixed_code", "cast(0.9 as double) as confidence")
    return fixes.apply_fixes(f, one, untouched=True).select("repo", "path", F.md5("content").alias("content_md5"), "n_fixes")


@query("fixed_files", f"""with {_JUDGED},
    l as (select repo, path, unnest({_LINES.replace('f.', '')}) as text, generate_subscripts({_LINES.replace('f.', '')}, 1) as line from v_files),
    p as (select repo, path, line, text from l where not exists (select 1 from a where a.repo = l.repo and a.path = l.path and l.line between a.start_line and a.end_line)
      union all select repo, path, start_line, fixed_code from a), k as (select repo, path, count(*) as k from a group by 1, 2)
    select p.repo, p.path, md5(string_agg(p.text, chr(10) order by p.line)) as content_md5, cast(any_value(k.k) as int) as n_fixes from p join k on p.repo = k.repo and p.path = k.path group by 1, 2""")
def fixed_files(spark, sf):
    patched = fixes.apply_fixes(views.files(spark, sf), views.fixes(spark, sf))
    return patched.select("repo", "path", F.md5("content").alias("content_md5"), "n_fixes")


_NUMBERED = f"select *, row_number() over (partition by repo order by {_SEQ}) as n from v_fixes"


@query("change_summaries", f"""with x as ({_NUMBERED}), t as (select repo, count(*) as total from v_fixes group by 1)
    select x.repo, cast((x.n - 1) // 200 + 1 as int) as part, any_value(t.total) as n, '🔒 Security fixes (' || any_value(t.total) || ' vulnerabilities)' as title,
    md5('### Vulnerabilities Fixed:' || chr(10) || chr(10) || string_agg(x.n || '. **' || vulnerability || '** in `' || path || '` (lines ' || start_line || '-' || end_line || ')' || chr(10) || '   - ' || description, chr(10) || chr(10) order by x.n)) as body_md5
    from x join t on x.repo = t.repo group by 1, 2""")
def change_summaries(spark, sf):
    s = fixes.change_summary(views.fixes(spark, sf), views.ORDER, 200)
    return s.select("repo", "part", "n", "title", F.md5("body").alias("body_md5"))


@query("discussion_summaries", f"""with x as ({_NUMBERED}) select repo, cast((n - 1) // 200 + 1 as int) as part,
    md5('### Vulnerability Summary:' || chr(10) || chr(10) || string_agg(n || '. **' || vulnerability || '** in `' || path || '`', chr(10) order by n)) as body_md5 from x group by 1, 2""")
def discussion_summaries(spark, sf):
    s = fixes.discussion_summary(views.fixes(spark, sf), views.ORDER, 200)
    return s.select("repo", "part", F.md5("body").alias("body_md5"))
