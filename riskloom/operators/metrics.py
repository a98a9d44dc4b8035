"""Aggregates for reports. All are combined on the map side; lists come in bounded parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import dims
from riskloom.functions import findings as ff
from riskloom.functions import paths, severity
from riskloom.operators.content import loc
from riskloom.operators.filters import path_roles
from riskloom.operators.ranking import type_order
from riskloom.operators.skew import chunked_lists


def language_share(stats: DataFrame) -> DataFrame:
    """(repo, language, bytes, pct) from (repo, language, bytes). Windows hold one row per language."""
    sums = (stats.groupBy("repo", paths.norm_language(F.col("language")).alias("language"))
            .agg(F.sum("bytes").alias("bytes")))
    total = F.sum("bytes").over(Window.partitionBy("repo"))
    return (sums.withColumn("_total", total).where(F.col("_total") > 0)
            .select("repo", "language", "bytes", (F.col("bytes") / F.col("_total") * 100.0).alias("pct")))


def language_share_by_files(files: DataFrame, bytes_per_file: int = 1000) -> DataFrame:
    """Language share by number of files, with the conventional size per file."""
    counted = (files.where(F.col("type") == "file").select("repo", paths.lang_of(F.col("path")).alias("language"))
               .where(F.col("language").isNotNull()).groupBy("repo", "language")
               .agg((F.count("*") * bytes_per_file).alias("bytes")))
    return language_share(counted)


def dominant_language(files: DataFrame) -> DataFrame:
    """Most frequent core language of each repository, `Unknown` if it has none."""
    counts = files.groupBy("repo", paths.core_lang(F.col("path")).alias("language")).agg(F.count("*").alias("n"))
    known = F.col("language").isNotNull()
    best = F.min_by(F.col("language"), F.when(known, F.struct(-F.col("n"), F.col("language"))))
    return counts.groupBy("repo").agg(F.coalesce(best, F.lit("Unknown")).alias("language"))


def architecture(files: DataFrame) -> DataFrame:
    """Architecture label from the dominant language and marker files at the root."""
    path = F.col("path")
    marks = files.groupBy("repo").agg(
        F.max((path == "cmd") | path.startswith("cmd/")).alias("cmd"), F.max(path == "main.go").alias("main"),
        F.max(path == "package.json").alias("npm"))
    lang = F.col("language")
    label = (F.when((lang == "Go") & F.col("cmd"), "CLI Application").when((lang == "Go") & F.col("main"), "Monolith")
             .when(lang.isin("JavaScript", "TypeScript") & F.col("npm"), "Node.js Application").otherwise("Unknown"))
    return marks.join(dominant_language(files), "repo").select("repo", "language", label.alias("architecture"))


def severity_counts(findings: DataFrame, level: Column) -> DataFrame:
    return findings.groupBy("repo", level.alias("severity")).agg(F.count("*").alias("n"))


def severity_summary(findings: DataFrame, level: Column) -> DataFrame:
    """Total and one count per level of the four-level scale."""
    return findings.groupBy("repo").agg(
        F.count("*").alias("total_findings"),
        *[F.count_if(level == name).alias(f"{name.lower()}_count") for name in ("CRITICAL", "HIGH", "MEDIUM", "LOW")])


def type_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo", ff.rule_type(F.col("check_id")).alias("type")).agg(F.count("*").alias("n"))


def report_findings(findings: DataFrame, impacts=("HIGH", "MEDIUM", "LOW")) -> DataFrame:
    """Findings as the report shows them: eligible impacts only, with title and report severity."""
    return (findings.where(F.upper(F.col("impact")).isin(*impacts))
            .withColumn("title", ff.clean_title(F.col("check_id")))
            .withColumn("severity", severity.report_severity(F.col("impact"))))


def report_metrics(findings: DataFrame, impacts=("HIGH", "MEDIUM", "LOW")) -> tuple[DataFrame, DataFrame]:
    """Title counts in display order, and severity counts."""
    shown = report_findings(findings, impacts)
    return type_order(shown), severity_counts(shown, F.col("severity"))


def secret_counts(secrets: DataFrame) -> DataFrame:
    """Secret types of a repository by count, then by first file."""
    counts = (secrets.groupBy("repo", ff.secret_type(F.col("detector")).alias("secret_type"))
              .agg(F.count("*").alias("n"), F.min(F.struct("path", "line")).alias("_first")))
    by_count = Window.partitionBy("repo").orderBy(F.desc("n"), "_first", "secret_type")
    return counts.withColumn("position", F.row_number().over(by_count)).drop("_first")


def by_file(findings: DataFrame, order, size: int = 1000) -> DataFrame:
    """Findings of each file as ordered lists of `start-end:rule`, in parts of at most `size`."""
    item = F.format_string("%d-%d:%s", "start_line", "end_line", "check_id")
    return chunked_lists(findings, ["repo", "path"], order, item, "findings", size)


def code_metrics(findings: DataFrame) -> DataFrame:
    """Distinct files, findings, findings per file and counts per impact of each repository."""
    per_file = findings.groupBy("repo", "path").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("impact") == s).alias(s.lower()) for s in dims.REPORT_DISPLAY_ORDER])
    return per_file.groupBy("repo").agg(
        F.count("*").alias("files_analyzed"), F.sum("n").alias("total"),
        (F.sum("n") / F.count("*")).alias("density"),
        *[F.sum(s.lower()).alias(s.lower()) for s in dims.REPORT_DISPLAY_ORDER])


def systemic_patterns(findings: DataFrame, min_n: int = 2) -> DataFrame:
    """Finding types with at least `min_n` instances in a repository, numbered by count."""
    kind = ff.agent_type(F.col("check_id"))
    by_count = Window.partitionBy("repo").orderBy(F.desc("n"), "type")   # one row per type
    return (findings.groupBy("repo", kind.alias("type")).agg(F.count("*").alias("n")).where(F.col("n") >= min_n)
            .withColumn("pattern_id", ff.format_id("PATTERN", 3, F.row_number().over(by_count)))
            .withColumn("description", F.format_string(
                "Systemic %s vulnerabilities found across %d locations", "type", "n"))
            .withColumn("systemic_fix", ff.systemic_fix_of(F.col("type"))))


def pattern_locations(findings: DataFrame, order, size: int = 1000) -> DataFrame:
    """`path:line` of every instance of a type, in parts of at most `size`."""
    typed = findings.withColumn("type", ff.agent_type(F.col("check_id")))
    place = F.format_string("%s:%d", "path", "start_line")
    return chunked_lists(typed, ["repo", "type"], order, place, "locations", size)


def validation_summary(marked: DataFrame) -> DataFrame:
    return marked.groupBy("repo").agg(
        F.count("*").alias("total"), F.count_if(~F.col("is_filtered")).alias("legitimate"),
        F.count_if("is_filtered").alias("filtered"),
        (F.count_if("is_filtered") / F.count("*") * 100.0).alias("false_positive_rate"))


def secret_totals(raw: DataFrame, enhanced: DataFrame) -> DataFrame:
    """Secret-like rows among the analysers' findings, among the synthesised ones, and their sum."""
    counts = lambda df, test, name: df.groupBy("repo").agg(F.count_if(test).alias(name))
    left = counts(raw, ff.is_secret_finding(F.col("check_id"), F.col("message")), "raw_secrets")
    right = counts(enhanced, ff.is_secret_type(F.col("type")), "typed_secrets")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (left.join(right, "repo", "full")
            .select("repo", zero("raw_secrets").alias("raw_secrets"), zero("typed_secrets").alias("typed_secrets"),
                    (zero("raw_secrets") + zero("typed_secrets")).alias("total_secrets")))


def cost(responses: DataFrame, price_in: float, price_out: float, by=("agent",)) -> DataFrame:
    """Tokens and cost; prices are per million tokens."""
    tokens_in, tokens_out = F.sum("input_tokens"), F.sum("output_tokens")
    spent = (tokens_in * F.lit(price_in) + tokens_out * F.lit(price_out)) / 1e6
    return responses.groupBy(*by).agg(
        F.count("*").alias("calls"), tokens_in.alias("input_tokens"), tokens_out.alias("output_tokens"),
        spent.alias("cost"), (spent / F.count("*")).alias("cost_per_call"))


def agent_summary(routes: DataFrame, progress: DataFrame, findings: DataFrame) -> DataFrame:
    """Per analyser: files assigned and processed, findings, last status and progress."""
    assigned = routes.groupBy("agent").agg(F.count("*").alias("files_assigned"))
    latest = progress.groupBy("agent").agg(
        F.max_by(F.struct("status", "progress", "files_processed"), F.struct("ts", "event_id")).alias("_last"))
    found = findings.groupBy("agent").agg(F.count("*").alias("findings"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (assigned.join(latest, "agent", "left").join(found, "agent", "left")
            .select("agent", "files_assigned", zero("_last.files_processed").alias("files_processed"),
                    zero("findings").alias("findings"),
                    F.coalesce(F.col("_last.status"), F.lit("pending")).alias("status"),
                    F.coalesce(F.col("_last.progress"), F.lit(0.0)).alias("progress")))


def project_structure(files: DataFrame, size: int = 1000, loose: bool = True) -> DataFrame:
    """Sorted paths per (repo, role): entry, config, test, doc, in parts of at most `size`.

    `loose` takes the substring flags, otherwise the exact names.
    """
    kind = "loose" if loose else "named"
    roles = F.array_compact(F.array(*[F.when(F.col(f"{kind}_{r}"), F.lit(r)) for r in ("entry", "config", "test", "doc")]))
    tagged = path_roles(files).select("repo", "path", F.explode(roles).alias("role"))
    return chunked_lists(tagged, ["repo", "role"], ["path"], F.col("path"), "paths", size)


def technology_stack(files: DataFrame) -> DataFrame:
    """Stack of each repository by its last root manifest in path order, and its number of build files."""
    low = F.lower(F.col("path"))
    stack = dims.lookup(low, dims.ROOT_MANIFEST_STACKS)
    framework = F.max_by(stack, F.when(stack.isNotNull(), F.col("path")))
    return files.groupBy("repo").agg(F.coalesce(framework, F.lit("unknown")).alias("framework"),
                                     F.count_if(dims.contains_any(low, dims.BUILD_FILE_WORDS)).alias("build_files"))


def build_files(files: DataFrame) -> DataFrame:
    return files.where(dims.contains_any(F.lower(F.col("path")), dims.BUILD_FILE_WORDS)).select("repo", "path")


def codebase_context(files: DataFrame, lines_per_file: int = 50) -> DataFrame:
    path = F.col("path")
    counts = files.groupBy("repo").agg(
        F.count("*").alias("total_files"), (F.count_if(paths.is_code(path)) * lines_per_file).alias("total_loc"),
        F.count_if(F.lower(path).rlike("|".join(dims.SECURITY_PATH_WORDS))).alias("security_files"),
        F.count_if(dims.contains_any(F.lower(path), ("main.", "index.", "app.", "server."))).alias("entry_points"))
    return counts.join(dominant_language(files), "repo")


def density(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings per 1000 lines of code, and the file with the most findings."""
    per_file = findings.groupBy("repo", "path").agg(F.count("*").alias("n"))
    per_repo = per_file.groupBy("repo").agg(
        F.sum("n").alias("findings"), F.min_by(F.col("path"), F.struct(-F.col("n"), F.col("path"))).alias("worst_file"),
        F.max("n").alias("worst_count"))
    per_kloc = F.when(F.col("loc") > 0, F.col("findings") * 1000.0 / F.col("loc"))
    return per_repo.join(loc(files), "repo").select("repo", "findings", "loc", per_kloc.alias("per_kloc"),
                                                    "worst_file", "worst_count")


def component_rollup(findings: DataFrame, depth: int = 1) -> DataFrame:
    """Findings by top folder and severity, with subtotals: `level` 0 detail, 1 component, 3 all."""
    return (findings.select(paths.top_component(F.col("path"), depth).alias("component"),
                            severity.report_severity(F.col("impact")).alias("severity"))
            .rollup("component", "severity")
            .agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level")))


def distinct_types(findings: DataFrame, approx: bool = False) -> DataFrame:
    kind = ff.clean_title(F.col("check_id"))
    count = F.approx_count_distinct(kind) if approx else F.count_distinct(kind)
    return findings.groupBy("repo").agg(count.alias("types"))


def run_summary(findings: DataFrame, secrets: DataFrame, fixes: DataFrame, errors: DataFrame) -> DataFrame:
    """One row per run with the totals of all targets; `repos` counts the targets that have a row of any kind."""
    parts = {"findings": findings, "secrets": secrets, "fixes": fixes, "errors": errors}
    kinds = [df.select("run_id", "repo", *[F.lit(int(k == name)).alias(k) for k in parts]) for name, df in parts.items()]
    per_repo = reduce(DataFrame.unionByName, kinds).groupBy("run_id", "repo").agg(*[F.sum(k).alias(k) for k in parts])
    return per_repo.groupBy("run_id").agg(*[F.sum(k).alias(k) for k in parts], F.count("repo").alias("repos"))
