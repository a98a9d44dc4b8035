"""Queries on dependencies, frameworks, profiles and rule sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import dims
from riskloom.checks import sqltext as q
from riskloom.checks import views
from riskloom.functions import paths
from riskloom.operators import dedup, joins, manifests, ranking
from riskloom.plans import profile
from riskloom.rule_catalog import ALL_RULES, rules_frame, ruleset_of

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


_MAPS = '{"dependencies": "MAP(VARCHAR, VARCHAR)", "devDependencies": "MAP(VARCHAR, VARCHAR)"}'
_NPM = f"""with p as (select repo, path, o_orderkey, from_json(content, '{_MAPS}') as j from v_manifests where base = 'package.json' and json_valid(content)),
    e as (select repo, path, o_orderkey, 1 as dev, unnest(map_entries(j.devDependencies)) as x from p union all select repo, path, o_orderkey, 0, unnest(map_entries(j.dependencies)) from p),
    n as (select repo, path, o_orderkey, x.key as name, x.value as version, row_number() over (partition by o_orderkey, x.key order by dev desc) as rn from e),
    npm as (select repo, path, o_orderkey, name, version from n where rn = 1)"""


@query("npm_dependencies", f"{_NPM} select repo, path, name, version from npm")
def npm_dependencies(spark, sf):
    return manifests.npm_deps(views.manifests(spark, sf))


def _values(pairs, names):
    return f"(select * from (values {', '.join('(' + ', '.join(map(q.quote, p)) + ')' for p in pairs)}) t({names}))"


_PATTERNS = {m: _values(list(t.items()), "pattern, framework") for m, t in dims.MANIFEST_PATTERNS.items()}


@query("npm_fallback", f"select repo, path, p.pattern from v_manifests, {_PATTERNS['package.json']} p where base = 'package.json' and not json_valid(content) and contains(content, '\"' || p.pattern || '\"')")
def npm_fallback(spark, sf):
    return manifests.npm_fallback(views.manifests(spark, sf))


_PIP = f"""with l as (select repo, path, trim(unnest(string_split(content, chr(10)))) as line from v_manifests where base = 'requirements.txt'),
    k as (select repo, path, trim(split_part(split_part(split_part(line, '==', 1), '>=', 1), '<=', 1)) as name from l where line <> '' and not starts_with(line, '#')),
    pip as (select repo, path, name, p.pattern, p.framework from k, {_PATTERNS['requirements.txt']} p where contains(lower(name), lower(p.pattern)))"""


@query("pip_packages", f"{_PIP} select repo, path, name, pattern, framework, case when {q.in_list('framework', dims.DATABASE_NAMES)} then 'database' else 'framework' end as category from pip")
def pip_packages(spark, sf):
    return manifests.pip_deps(views.manifests(spark, sf))


@query("maven_hits", f"""select repo, path, p.framework, case when {q.in_list('p.framework', dims.SECURITY_FRAMEWORK_NAMES)} then 'security' else 'framework' end as category
    from v_manifests, {_PATTERNS['pom.xml']} p where base = 'pom.xml' and contains(content, p.pattern)""")
def maven_hits(spark, sf):
    return manifests.maven_hits(views.manifests(spark, sf))


_OTHER = " union all ".join(f"select repo, path, p.framework from v_manifests, {_PATTERNS[m]} p where base = '{m}' and contains(lower(content), lower(p.pattern))"
                            for m in ("go.mod", "Gemfile", "composer.json"))


@query("manifest_hits", _OTHER)
def manifest_hits(spark, sf):
    return manifests.manifest_hits(views.manifests(spark, sf))


_GO = r"""go as (select repo, path, f[1] as name, f[2] as version from (select repo, path, line, string_split_regex(line, '\s+') as f from (
    select repo, path, trim(unnest(string_split(content, chr(10))), ' ' || chr(9) || chr(13)) as line from v_manifests where base = 'go.mod'))
    where (contains(line, 'require') or contains(line, 'github.com/')) and len(f) >= 2)"""


@query("go_modules", f"with {_GO} select * from go")
def go_modules(spark, sf):
    return manifests.go_deps(views.manifests(spark, sf))


def _deps(spark, sf):
    m = views.manifests(spark, sf)
    return manifests.npm_deps(m).unionByName(manifests.go_deps(m))


_DEPS = f"{_NPM}, {_GO}, deps as (select repo, path, name, version from npm union all select repo, path, name, version from go)"
_CLASS = {c: q.any_contains("lower(name)", w) for c, w in (("security", dims.SECURITY_LIBRARY_WORDS), ("database", dims.DATABASE_WORDS),
                                                          ("web", dims.WEB_FRAMEWORK_WORDS), ("build", dims.BUILD_TOOL_WORDS))}


@query("dependency_classes", f"{_DEPS} select repo, path, name, version, " + ", ".join(f"{e} as is_{c}" for c, e in _CLASS.items()) + " from deps")
def dependency_classes(spark, sf):
    return manifests.classify_deps(_deps(spark, sf))


_STACK = f"""{_DEPS}, stack as (select distinct repo, 'library' as class, name as item from deps union select distinct repo, 'security', name || '@' || version from deps where {_CLASS['security']}
    union select distinct repo, 'database', name from deps where {_CLASS['database']} union select distinct repo, 'web', name from deps where {_CLASS['web']}
    union select distinct repo, 'build', name from deps where {_CLASS['build']})"""


@query("dependency_stack", f"{_STACK} select * from stack")
def dependency_stack(spark, sf):
    return manifests.dependency_stack(_deps(spark, sf))


@query("known_mitigations", f"""{_STACK}, fw as (select repo, min(name) as framework from deps where {_CLASS['web']} group by 1)
    select repo, case lower(framework) when 'express' then 'Express Helmet' else 'Gin CORS' end as pattern, case lower(framework) when 'express' then 'Security headers middleware' else 'CORS middleware for Gin' end as description,
    cast(case lower(framework) when 'express' then 0.8 else 0.7 end as double) as confidence from fw where lower(framework) in ('express', 'gin')
    union all select repo, 'Security Headers', 'Helmet provides security headers', cast(0.9 as double) from stack where class = 'security' and contains(item, 'helmet')""")
def known_mitigations(spark, sf):
    d = _deps(spark, sf)
    return manifests.security_patterns(manifests.dependency_stack(d), manifests.stack_framework(d))


@query("dependency_patterns", f"{_NPM} select repo, path, name, version, p.pattern, p.framework from npm, {_PATTERNS['package.json']} p where contains(name, p.pattern)")
def dependency_patterns(spark, sf):
    deps = manifests.npm_deps(views.manifests(spark, sf))
    return manifests.match_deps(deps, manifests.patterns_frame(spark, "package.json"))


_PATH_VALUES = _values([(fw, p) for fw, ps in dims.FRAMEWORK_PATH_PATTERNS.items() for p in ps], "framework, pattern")
_PATHS = f"select m.repo, m.path, p.framework from v_manifests m, {_PATH_VALUES} p where contains(m.path, p.pattern) or m.base = p.pattern"


@query("framework_paths", _PATHS)
def framework_paths(spark, sf):
    return manifests.match_paths(views.manifests(spark, sf))


_HITS = f"""{_NPM}, {_PIP[5:]}, hits as (
    select repo, path, framework, 'framework' as category, false as manifest from ({_PATHS})
    union all select n.repo, n.path, p.framework, case when {q.in_list('p.framework', dims.BUILD_TOOL_NAMES)} then 'build' else 'framework' end, true from npm n, {_PATTERNS['package.json']} p where contains(n.name, p.pattern)
    union all select repo, path, p.framework, case when {q.in_list('p.framework', dims.BUILD_TOOL_NAMES)} then 'build' else 'framework' end, true from v_manifests, {_PATTERNS['package.json']} p
      where base = 'package.json' and not json_valid(content) and contains(content, '"' || p.pattern || '"')
    union all select repo, path, framework, case when {q.in_list('framework', dims.DATABASE_NAMES)} then 'database' else 'framework' end, true from pip
    union all select repo, path, p.framework, case when {q.in_list('p.framework', dims.SECURITY_FRAMEWORK_NAMES)} then 'security' else 'framework' end, true
      from v_manifests, {_PATTERNS['pom.xml']} p where base = 'pom.xml' and contains(content, p.pattern)
    union all select repo, path, framework, 'framework', true from ({_OTHER})),
    detected as (select repo, framework, category, count(*) as n, count(*) filter (where manifest) as manifest_hits,
      regexp_extract(min(path), '([^/]*)$', 1) as indicator from hits group by 1, 2, 3)"""


@query("frameworks", f"{_HITS} select * from detected")
def frameworks(spark, sf):
    return manifests.detect_frameworks(views.manifests(spark, sf))


_RANKED = f"""{_HITS}, ranked as (select *, cast(row_number() over (partition by repo order by n desc, manifest_hits desc, framework) as int) as rank from detected where category = 'framework')"""


@query("ranked_frameworks", f"{_RANKED} select *, case when rank = 1 then 'primary' else 'secondary' end as role from ranked where rank <= 4")
def ranked_frameworks(spark, sf):
    return ranking.rank_frameworks(manifests.detect_frameworks(views.manifests(spark, sf)))


# ------------------------------------------------------------------ rule sets
_LANG_SETS = _values([(n, i, r) for n, rs in dims.LANGUAGE_RULESETS.items() for i, r in enumerate(rs)], "name, position, ruleset")


@query("language_rulesets", f"""select x.path, s.name, cast(s.position as int) as position, s.ruleset from (select path, {q.case_map(q.EXT, dims.LANGUAGE_BY_EXTENSION)} as name from v_files) x join {_LANG_SETS} s on x.name = s.name""")
def language_rulesets(spark, sf):
    names = views.files(spark, sf).select("path", paths.lang_of(F.col("path")).alias("name"))
    return joins.rulesets_for(names, dims.LANGUAGE_RULESETS)


@query("preset_rulesets", "select distinct c_name, case c_nationkey % 4 when 0 then 'p/default' when 1 then 'p/security-audit p/secrets p/owasp-top-ten' when 2 then 'p/security-audit p/owasp-top-ten p/cwe-top-25' else 'auto' end as rulesets from customer")
def preset_rulesets(spark, sf):
    preset = F.expr("case c_nationkey % 4 when 0 then 'basic' when 1 then 'comprehensive' when 2 then 'security-focused' else 'mine' end")
    return views.table(spark, sf, "customer").select("c_name", profile.preset_rulesets(preset).alias("rulesets"))


def _distinct_ordered(lists):
    """Ordered concatenation of lists, each value at its first place."""
    return f"list_filter({lists}, lambda x, i: list_position({lists}, x) = i)"


def _map_list(expr, table):
    whens = " ".join(f"when {q.quote(k)} then [{', '.join(map(q.quote, v))}]" for k, v in table.items())
    return f"(case {expr} {whens} else [] end)"


_SHARE = f"""share as (select repo, language, bytes, cast(bytes as double) / sum(bytes) over (partition by repo) * 100.0 as pct from
    (select repo, {q.case_map(q.EXT, dims.LANGUAGE_BY_EXTENSION)} as language, 1000 * count(*) as bytes from v_manifests group by 1, 2) where language is not null),
    lr as (select *, row_number() over (partition by repo order by pct desc, language) as rk from share),
    lp as (select repo, max(case when rk = 1 then language end) as primary_language, max(case when rk = 2 and pct >= 10 then language end) as secondary_language,
      list(language order by rk) filter (where rk = 1 or pct >= 10) as languages from lr group by 1)"""
_PROFILE = f"""{_RANKED}, {_SHARE}, fp as (select repo, max(case when rank = 1 then framework end) as primary_framework, list(framework order by rank) filter (where rank between 2 and 4) as secondary from ranked group by 1),
    cats as (select repo, list(distinct framework order by framework) filter (where category = 'build') as build_tools, list(distinct framework order by framework) filter (where category = 'database') as databases,
      list(distinct framework order by framework) filter (where category = 'security') as security from detected group by 1),
    joined as (select repo, primary_language, secondary_language, coalesce(languages, []) as languages, coalesce(primary_framework, 'None') as primary_framework, coalesce(secondary, []) as secondary,
      coalesce(build_tools, []) as build_tools, coalesce(databases, []) as databases, coalesce(security, []) as security
      from lp full join (select * from cats left join fp using (repo)) using (repo)),
    %s
    sets as (select *, {_distinct_ordered(f"flatten(list_transform(languages, lambda l: {_map_list('l', dims.LANGUAGE_RULESETS)}))")} as base,
      {_distinct_ordered(f"flatten(list_transform(list_concat(case when primary_framework <> 'None' then [primary_framework] else [] end, secondary), lambda f: {_map_list('f', dims.FRAMEWORK_RULESETS)}))")} as fws,
      list_concat(list_concat(list_concat(['p/secrets', 'p/security-audit'], case when list_has_any(list_prepend(primary_framework, secondary), [{', '.join(map(q.quote, dims.WEB_FRAMEWORKS))}]) then ['p/owasp-top-ten', 'p/xss'] else [] end),
        case when list_has_any(list_prepend(primary_framework, secondary), [{', '.join(map(q.quote, dims.API_FRAMEWORKS))}]) then ['p/jwt', 'p/owasp-top-ten'] else [] end),
        {_map_list("coalesce(primary_language, '')", dims.LANGUAGE_SECURITY_RULESETS)}) as sec from %s),
    final as (select *, {_distinct_ordered('list_concat(list_concat(base, fws), sec)')} as rulesets from sets)"""
_OUT = """select repo, primary_language, secondary_language, array_to_string(languages, ',') as languages, primary_framework, array_to_string(secondary, ',') as secondary_frameworks,
    array_to_string(build_tools, ',') as build_tools, array_to_string(databases, ',') as databases, array_to_string(security, ',') as security, array_to_string(rulesets, ',') as rulesets,
    lower(replace(coalesce(primary_language, ''), ' ', '-')) || case when primary_framework = 'None' then '' else '-' || lower(replace(primary_framework, ' ', '-')) end as profile_key"""


def _flat(df):
    lists = ("languages", "secondary_frameworks", "build_tools", "databases", "security", "rulesets")
    return df.select("repo", "primary_language", "secondary_language", "primary_framework", "profile_key",
                     *[F.array_join(c, ",").alias(c) for c in lists], "source", "confidence")


@query("profiles", (_PROFILE % ("", "joined")) + f" {_OUT}, 'file-analysis' as source, cast(0.7 as double) as confidence from final")
def profiles(spark, sf):
    return _flat(profile.build_profile(views.manifests(spark, sf)))


_FORCED = """forced as (select repo, case when substr(repo, 2)::bigint % 3 = 0 then 'Go' else primary_language end as primary_language, case when substr(repo, 2)::bigint % 3 = 0 then null else secondary_language end as secondary_language,
    case when substr(repo, 2)::bigint % 3 = 0 then ['Go'] else languages end as languages, case when substr(repo, 2)::bigint % 6 = 0 then 'Gin' else primary_framework end as primary_framework,
    case when substr(repo, 2)::bigint % 6 = 0 then [] else secondary end as secondary, build_tools, databases, security from joined),"""


@query("overridden_profiles", (_PROFILE % (_FORCED, "forced")) + ", extra as (select * replace (case when substr(repo, 2)::bigint % 3 = 0 then list_concat(rulesets, ['p/extra', 'p/secrets']) else rulesets end as rulesets) from final) " +
       _OUT + ", case when substr(repo, 2)::bigint % 6 = 0 then 'user-override' else 'file-analysis' end as source, cast(case when substr(repo, 2)::bigint % 6 = 0 then 0.5 else 0.7 end as double) as confidence from extra")
def overridden_profiles(spark, sf):
    base = profile.build_profile(views.manifests(spark, sf))
    overrides = views.table(spark, sf, "customer").where("c_custkey % 3 = 0").selectExpr(
        "'r' || cast(c_custkey as varchar(20)) as repo", "'Go' as force_language",
        "case when c_custkey % 6 = 0 then 'Gin' end as force_framework", "' p/extra, p/secrets ' as extra_rulesets")
    return _flat(profile.apply_overrides(base, overrides))


_RULE_VALUES = _values([(r.rule_id, r.agent, r.impact, ruleset_of(r)) for r in ALL_RULES], "rule_id, agent, impact, ruleset")


@query("active_rules", (_PROFILE % ("", "joined")) + f", u as (select distinct repo, unnest(rulesets) as ruleset from final) select u.repo, u.ruleset, r.rule_id, r.agent, r.impact from u join {_RULE_VALUES} r on u.ruleset = r.ruleset")
def active_rules(spark, sf):
    return profile.active_rules(profile.build_profile(views.manifests(spark, sf)), rules_frame(spark))


@query("security_rulesets", (_PROFILE % ("", "joined")) + f" select repo, array_to_string({_distinct_ordered('sec')}, ',') as security_rulesets from final")
def security_rulesets(spark, sf):
    p = profile.build_profile(views.manifests(spark, sf))
    return p.select("repo", F.array_join("security_rulesets", ",").alias("security_rulesets"))


@query("ruleset_changes", (_PROFILE % ("", "joined")) + """, d as (select repo, list_distinct(rulesets) as a, ['p/secrets', 'p/go', 'p/custom'] as b from final) select repo,
    array_to_string(list_sort(list_filter(b, lambda x: not list_contains(a, x))), ',') as added, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(b, x))), ',') as removed,
    array_to_string(list_sort(list_filter(a, lambda x: list_contains(b, x))), ',') as kept from d""")
def ruleset_changes(spark, sf):
    p = profile.build_profile(views.manifests(spark, sf))
    fixed = F.array(F.lit("p/secrets"), F.lit("p/go"), F.lit("p/custom"))
    d = p.select("repo", dedup.diff_rulesets(F.col("rulesets"), fixed).alias("d"))
    return d.select("repo", *[F.array_join(F.sort_array(f"d.{c}"), ",").alias(c) for c in ("added", "removed", "kept")])


@query("statistics_profiles", (_PROFILE % ("", "joined")).replace("1000 * count(*) as bytes", "cast(sum(size) as bigint) as bytes") +
       f" {_OUT}, 'mixed' as source, cast(0.85 as double) as confidence from final")
def statistics_profiles(spark, sf):
    m = views.manifests(spark, sf)
    stats = m.select("repo", paths.lang_of(F.col("path")).alias("language"), F.col("size").alias("bytes")).where("language is not null")
    return _flat(profile.build_profile(m, stats))
