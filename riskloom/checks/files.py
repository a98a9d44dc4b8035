"""Queries on files, paths, lines and languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import dims
from riskloom.checks import views
from riskloom.checks.sqltext import BASE, EXT, any_contains, case_map, in_list, quote
from riskloom.functions import paths
from riskloom.operators import content, filters, metrics, ranking
from riskloom.sources import files as sources

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def with_docs(spark, sf):
    """Files where every seventh document is a read-me."""
    path = F.when(F.col("doc_id") % 7 == 0, F.format_string("docs/%d/ReadMe.md", "doc_id")).otherwise(F.col("path"))
    return views.files(spark, sf).withColumn("path", path)


@query("file_inventory", """
    with folders as (select distinct repo, array_to_string(parts[1:n], '/') as path
      from (select repo, string_split(path, '/') as parts, unnest(generate_series(1, len(string_split(path, '/')) - 1)) as n from v_files))
    select repo, path, type, size, sha256(content) as sha from v_files
    union all select repo, path, 'dir', cast(0 as bigint), null from folders""")
def file_inventory(spark, sf):
    return sources.inventory(views.files(spark, sf))


@query("target_list", r"""
    with t as (select page_id, trim(raw) as url from v_urls),
    p as (select page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(url,
        '^(git@github\.com:|https://github\.com/|http://github\.com/)', ''), '\.git$', ''), '/$', ''), '/') as parts
      from t where url <> '' and not starts_with(url, '#'))
    select url, case when contains(url, 'github.com') and len(parts) >= 2 then parts[1] end as owner,
      case when contains(url, 'github.com') and len(parts) >= 2 then parts[2] end as name,
      contains(url, 'github.com') and len(parts) >= 2 as valid from p""")
def target_list(spark, sf):
    return sources.parse_targets(views.urls(spark, sf), "raw")


_SIZES = f"select repo, {case_map(EXT, dims.LANGUAGE_BY_EXTENSION)} as language, cast(sum(size) as bigint) as bytes from v_files group by 1, 2"


def language_maps(spark, sf):
    """One map of language sizes per repository, as a hosting service reports it."""
    sums = (views.files(spark, sf).groupBy("repo", paths.lang_of(F.col("path")).alias("language"))
            .agg(F.sum("size").alias("bytes")).where("language is not null"))
    return sums.groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("language", "bytes"))).alias("languages"))


@query("language_sizes", f"""
    select repo, language, bytes, cast(sum(bytes) over (partition by repo) as bigint) as total
    from ({_SIZES}) where language is not null""")
def language_sizes(spark, sf):
    return sources.scan_language_stats(language_maps(spark, sf))


@query("doc_insights", """
    select repo, 'docs/' || doc_id || '/ReadMe.md' as source, content, cast(0.8 as double) as relevance from v_files where doc_id % 7 = 0""")
def doc_insights(spark, sf):
    return sources.doc_insights(with_docs(spark, sf))


_SKIP = any_contains("path", dims.SKIP_DIRECTORIES)
_SKIP_SEGMENT = any_contains("'/' || path", [f"/{d}" for d in dims.SKIP_DIRECTORIES])
_WANTED = (f"({in_list(EXT, dims.ANALYSABLE_EXTENSIONS)} or ({EXT} = '' and "
           f"{in_list(f'lower({BASE})', dims.EXTENSIONLESS_CONFIG_NAMES)})) and not {in_list(EXT, dims.SKIP_EXTENSIONS)}")


@query("analysable_files", f"select repo, path from v_files where not {_SKIP} and {_WANTED}")
def analysable_files(spark, sf):
    return filters.filter_analysable(views.files(spark, sf)).select("repo", "path")


@query("analysable_files_by_segment", f"select repo, path from v_files where not {_SKIP_SEGMENT} and {_WANTED}")
def analysable_files_by_segment(spark, sf):
    return filters.filter_analysable(views.files(spark, sf), segment_match=True).select("repo", "path")


@query("file_kinds", f"""
    select path, {case_map(EXT, dims.LANGUAGE_BY_EXTENSION)} as language, {case_map(EXT, dims.HIGHLIGHT_BY_EXTENSION, "text")} as highlight,
      {case_map(EXT, dims.CORE_LANGUAGE_BY_EXTENSION)} as core, case when {EXT} = '' then 'file' else {EXT}[2:] end as file_type,
      {in_list(EXT, dims.SOURCE_EXTENSIONS)} as is_source, {in_list(EXT, dims.CODE_EXTENSIONS)} as is_code
    from (select path from v_files union all select path from v_manifests)""")
def file_kinds(spark, sf):
    both = views.files(spark, sf).select("path").unionAll(views.manifests(spark, sf).select("path"))
    p = F.col("path")
    return both.select("path", paths.lang_of(p).alias("language"), paths.highlight_lang(p).alias("highlight"),
                       paths.core_lang(p).alias("core"), paths.file_type(p).alias("file_type"),
                       paths.is_source(p).alias("is_source"), paths.is_code(p).alias("is_code"))


@query("source_files", f"select repo, path from v_manifests where {in_list(EXT, dims.SOURCE_EXTENSIONS)}")
def source_files(spark, sf):
    return filters.source_files(views.manifests(spark, sf)).select("repo", "path")


@query("key_files", f"select repo, path, content from v_manifests where {in_list('base', dims.KEY_FILE_NAMES)} and size < 130")
def key_files(spark, sf):
    return filters.key_files(views.manifests(spark, sf), max_size=130).select("repo", "path", "content")


def _relevance_sql(agent):
    if agent not in dims.AGENT_RELEVANCE:
        return "true"
    extensions, words = dims.AGENT_RELEVANCE[agent]
    parts = [any_contains(f"lower({BASE})", words)] + ([in_list(EXT, extensions)] if extensions else [])
    return "(" + " or ".join(parts) + ")"


@query("agent_relevance", "select repo, path, " + ", ".join(
    f"{_relevance_sql(a)} as is_{a.split('-')[1]}" for a in dims.AGENT_TYPES) + " from v_files")
def agent_relevance(spark, sf):
    return views.files(spark, sf).select(
        "repo", "path", *[filters.is_relevant(F.col("path"), a).alias("is_" + a.split("-")[1]) for a in dims.AGENT_TYPES])


@query("agent_scopes", " union all ".join(
    f"select repo, path, {quote(a)} as agent from v_files where regexp_matches('/' || path, {quote(filters.glob_pattern(dims.AGENT_INCLUDE_GLOBS[a]))})"
    f" and not regexp_matches('/' || path, {quote(filters.glob_pattern(dims.AGENT_EXCLUDE_GLOBS[a]))})" for a in dims.AGENT_TYPES))
def agent_scopes(spark, sf):
    return filters.scope_files(views.files(spark, sf).select("repo", "path"))


@query("security_files", f"select repo, path from v_files where {any_contains('lower(path)', dims.SECURITY_PATH_WORDS)}")
def security_files(spark, sf):
    return filters.security_files(views.files(spark, sf)).select("repo", "path")


@query("scan_limits", "select repo, path, size from v_files where size <= 2000 and not contains('/' || path, '/node_modules/') and starts_with(path, 'src/')")
def scan_limits(spark, sf):
    small = filters.limit_targets(views.files(spark, sf), 2000, ["*/node_modules/*"])
    return filters.scope_path(small, "src").select("repo", "path", "size")


_ENDS = lambda e, *suffixes: "(" + " or ".join(f"ends_with({e}, {quote(s)})" for s in suffixes) + ")"
_LB, _LP = f"lower({BASE})", "lower(path)"
_ROLES = f"""
    select repo, path, {in_list(_LB, dims.ENTRY_POINT_NAMES)} as named_entry,
      contains({_LB}, 'config') or {in_list(_LB, dims.CONFIG_FILE_NAMES)} or {_ENDS(_LB, '.conf', '.yaml', '.yml')} as named_config,
      contains(regexp_extract({_LP}, '^(.*)/[^/]*$', 1), 'test') as named_test,
      contains({_LB}, 'readme') or contains({_LB}, 'doc') or {_ENDS(_LB, '.md')} as named_doc,
      {any_contains(_LP, ('main.', 'index.', 'app.', 'server.'))} as loose_entry,
      contains({_LP}, 'config') or {_ENDS(_LP, '.conf', '.yaml', '.yml')} or ({_ENDS(_LP, '.json')} and (contains({_LP}, 'package') or contains({_LP}, 'config'))) as loose_config,
      contains({_LP}, 'test') or contains({_LP}, 'spec') as loose_test,
      {_ENDS(_LP, '.md', '.rst')} or ({_ENDS(_LP, '.txt')} and contains({_LP}, 'readme')) as loose_doc
    from (select repo, path from v_files union all select repo, path from v_manifests)"""


def _all_paths(spark, sf):
    return views.files(spark, sf).select("repo", "path").unionAll(views.manifests(spark, sf).select("repo", "path"))


@query("path_roles", _ROLES)
def path_roles(spark, sf):
    return filters.path_roles(_all_paths(spark, sf))


@query("project_structure", f"""
    with roles as ({_ROLES}), tagged as (
      select repo, path, 'entry' as role from roles where loose_entry union all select repo, path, 'config' from roles where loose_config
      union all select repo, path, 'test' from roles where loose_test union all select repo, path, 'doc' from roles where loose_doc)
    select repo, role, cast(1 as int) as part, string_agg(path, ',' order by path) as paths from tagged group by 1, 2""")
def project_structure(spark, sf):
    return metrics.project_structure(_all_paths(spark, sf)).withColumn("paths", F.array_join("paths", ","))


@query("project_structure_by_name", f"""
    with roles as ({_ROLES}), tagged as (
      select repo, path, 'entry' as role from roles where named_entry union all select repo, path, 'config' from roles where named_config
      union all select repo, path, 'test' from roles where named_test union all select repo, path, 'doc' from roles where named_doc),
    n as (select *, (row_number() over (partition by repo, role order by path) - 1) // 3 + 1 as part from tagged)
    select repo, role, cast(part as int) as part, string_agg(path, ',' order by path) as paths from n group by 1, 2, 3""")
def project_structure_by_name(spark, sf):
    return metrics.project_structure(_all_paths(spark, sf), size=3, loose=False).withColumn("paths", F.array_join("paths", ","))


@query("test_directories", """select distinct repo, 'test' as path from v_files where starts_with(path, 'test/')""")
def test_directories(spark, sf):
    return sources.test_directories(views.files(spark, sf))


@query("key_contents", f"""select repo, path, type, cast(size as bigint) as size, case when {in_list('base', dims.KEY_FILE_NAMES)} and size < 10000 then content end as content from v_manifests""")
def key_contents(spark, sf):
    return sources.key_contents(views.manifests(spark, sf))


@query("build_files", f"""select repo, path from v_manifests where {any_contains('lower(path)', dims.BUILD_FILE_WORDS)} union all
    select repo, 'build.gradle' from v_files where doc_id % 9 = 0""")
def build_files(spark, sf):
    extra = views.files(spark, sf).where("doc_id % 9 = 0").select("repo", F.lit("build.gradle").alias("path"))
    return metrics.build_files(views.manifests(spark, sf).select("repo", "path").unionAll(extra))


@query("technology_stack", f"""
    select repo, coalesce(arg_max({case_map('lower(path)', dims.ROOT_MANIFEST_STACKS)}, path)
        filter (where {case_map('lower(path)', dims.ROOT_MANIFEST_STACKS)} is not null), 'unknown') as framework,
      count(*) filter (where {any_contains('lower(path)', dims.BUILD_FILE_WORDS)}) as build_files from v_manifests group by 1""")
def technology_stack(spark, sf):
    return metrics.technology_stack(views.manifests(spark, sf))


_CORE = case_map(EXT, dims.CORE_LANGUAGE_BY_EXTENSION)
_DOMINANT = f"""select repo, coalesce((list(language order by n desc, language) filter (where language is not null))[1], 'Unknown') as language
    from (select repo, {_CORE} as language, count(*) as n from %s group by 1, 2) group by 1"""


@query("dominant_language", _DOMINANT % "v_manifests")
def dominant_language(spark, sf):
    return metrics.dominant_language(views.manifests(spark, sf))


@query("architecture", f"""
    with d as ({_DOMINANT % 'v_manifests'}), m as (select repo, max(path = 'cmd' or starts_with(path, 'cmd/')) as cmd, max(path = 'main.go') as main,
      max(path = 'package.json') as npm from v_manifests group by 1)
    select repo, language, case when language = 'Go' and cmd then 'CLI Application' when language = 'Go' and main then 'Monolith'
      when language in ('JavaScript', 'TypeScript') and npm then 'Node.js Application' else 'Unknown' end as architecture from d join m using (repo)""")
def architecture(spark, sf):
    return metrics.architecture(views.manifests(spark, sf))


@query("codebase_context", f"""
    with d as ({_DOMINANT % 'v_files'})
    select repo, count(*) as total_files, 50 * count(*) filter (where {in_list(EXT, dims.CODE_EXTENSIONS)}) as total_loc,
      count(*) filter (where {any_contains('lower(path)', dims.SECURITY_PATH_WORDS)}) as security_files,
      count(*) filter (where {any_contains('lower(path)', ('main.', 'index.', 'app.', 'server.'))}) as entry_points, any_value(language) as language
    from v_files join d using (repo) group by 1""")
def codebase_context(spark, sf):
    return metrics.codebase_context(views.files(spark, sf))


_SHARE = f"""select repo, language, bytes, round(cast(bytes as double) / sum(bytes) over (partition by repo) * 100.0, 6) as pct
    from ({_SIZES}) where language is not null"""


def _stats(spark, sf):
    return (views.files(spark, sf).select("repo", paths.lang_of(F.col("path")).alias("language"), F.col("size").alias("bytes"))
            .where("language is not null"))


@query("language_share", _SHARE)
def language_share(spark, sf):
    return metrics.language_share(_stats(spark, sf)).withColumn("pct", F.round("pct", 6))


@query("language_share_by_files", f"""
    select repo, language, bytes, round(cast(bytes as double) / sum(bytes) over (partition by repo) * 100.0, 6) as pct
    from (select repo, {case_map(EXT, dims.LANGUAGE_BY_EXTENSION)} as language, 1000 * count(*) as bytes from v_manifests group by 1, 2) where language is not null""")
def language_share_by_files(spark, sf):
    return metrics.language_share_by_files(views.manifests(spark, sf)).withColumn("pct", F.round("pct", 6))


@query("ranked_languages", f"""
    with r as (select *, cast(row_number() over (partition by repo order by pct desc, language) as int) as rank from ({_SHARE}))
    select repo, language, bytes, pct, rank, case when rank = 1 then 'primary' when rank = 2 and pct >= 20 then 'secondary'
      when pct >= 20 then 'significant' else 'minor' end as role from r""")
def ranked_languages(spark, sf):
    rounded = metrics.language_share(_stats(spark, sf)).withColumn("pct", F.round("pct", 6))
    return ranking.rank_languages(rounded, 20.0)


@query("size_share", """
    select repo, path, size, cast(sum(size) over (partition by repo) as bigint) as total,
      round(cast(size as double) / sum(size) over (partition by repo) * 100.0, 6) as pct from v_files""")
def size_share(spark, sf):
    shared = ranking.with_share(views.files(spark, sf).select("repo", "path", "size"), "size", ["repo"])
    return shared.withColumn("pct", F.round("pct", 6))


@query("line_table", r"""
    select repo, path, cast(line as int) as line, md5(text) as text_md5 from (
      select repo, path, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) as line from v_files)""")
def line_table(spark, sf):
    return content.lines(views.files(spark, sf)).select("repo", "path", "line", F.md5("text").alias("text_md5"))


@query("lines_of_code", f"""
    select repo, 50 * count(*) filter (where {in_list(EXT, dims.CODE_EXTENSIONS)}) as estimated_loc,
      cast(sum(case when {in_list(EXT, dims.CODE_EXTENSIONS)} then len(string_split(content, chr(10))) else 0 end) as bigint) as loc from v_files group by 1""")
def lines_of_code(spark, sf):
    return content.loc(views.files(spark, sf))


@query("function_count", r"""
    select repo, cast(sum(len(regexp_extract_all(content, '(?m)(?:^|[ \t])(?:function|def|func|fn) +[A-Za-z_]'))) as bigint) as functions
    from (select repo, replace(content, 'de ', 'def ') as content from v_files) group by 1""")
def function_count(spark, sf):
    words = views.files(spark, sf).withColumn("content", F.replace("content", F.lit("de "), F.lit("def ")))
    return content.function_count(words)


_START, _END = "cast(doc_id % 5 + 1 as int)", "cast(doc_id % 5 + 1 + doc_id % 2 as int)"


@query("deep_links", f"""
    select path, 'https://github.com/acme/' || repo || '/blob/main/' || path || '#L' || {_START} ||
      case when doc_id % 2 = 0 then '' else '-L' || {_END} end as link, path as relative from v_files""")
def deep_links(spark, sf):
    f = views.files(spark, sf).withColumn("long", F.concat(F.lit("/tmp/temp-42/"), "repo", F.lit("/"), "path"))
    start, end = F.expr(_START), F.expr(_END)
    target = F.concat(F.lit("https://github.com/acme/"), "repo", F.when(F.col("doc_id") % 3 == 0, "/").otherwise(".git"))
    prefixed = F.concat(F.lit("/work/x/"), "path")
    return f.select("path", paths.deep_link(target, F.col("long"), start, end).alias("link"),
                    paths.relative_path(prefixed, "/work/x").alias("relative"))


@query("profile_keys", """
    select distinct p_name, lower(replace(trim(' ' || p_type || ' '), ' ', '-')) || case when p_partkey % 3 = 0 then '' else '-' || lower(replace(p_name, ' ', '-')) end as profile_key from part""")
def profile_keys(spark, sf):
    fw = F.when(F.col("p_partkey") % 3 == 0, "None").otherwise(F.col("p_name"))
    language = paths.norm_language(F.concat(F.lit(" "), "p_type", F.lit(" ")))
    return views.table(spark, sf, "part").select(
        "p_name", paths.profile_key(language, fw).alias("profile_key")).distinct()


@query("files_on_disk", """with d as (select source as repo, 'folder=d' || doc_id as folder, encode(text || chr(10)) as bytes from documents)
    select repo, folder, 'file' as type, octet_length(bytes)::bigint as size, sha256(bytes) as sha from d union all select repo, folder, 'dir', 0::bigint, null from d""")
def files_on_disk(spark, sf):
    """The documents as one file each, found again by a scan of the folder they were written to."""
    from riskloom.checks.streams import work_folder
    out = work_folder(spark, "files")
    name = F.format_string("folder=%s/part-%d.txt", F.coalesce(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("none")), "row")
    docs = views.table(spark, sf, "documents").withColumn("row", F.monotonically_increasing_id()).select(
        F.coalesce(F.concat(F.lit("repo="), F.url_encode("source")), F.lit("repo")).alias("repo"), name.alias("path"),
        F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("content"))
    sources.write_files(sources.spread(docs), out)
    found = sources.inventory(sources.scan_files(spark, out).where(F.col("path").endswith(".txt")))
    repo = F.when(F.col("repo").startswith("repo="), F.url_decode(F.substring("repo", 6, 1 << 30)))
    return found.select(repo.alias("repo"), F.regexp_extract("path", "^([^/]+)", 1).alias("folder"), "type", "size", "sha")
