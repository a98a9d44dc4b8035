"""Row filters on files, findings and fixes. All are plain predicates that reach the scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import dims
from riskloom.functions import findings as ff
from riskloom.functions import paths, severity


def analysable(path: Column, segment_match: bool = False) -> Column:
    """Skipped folders, then skipped extensions, then wanted extensions, then known names without extension.

    A folder is matched anywhere in the path (`robin/x.py` contains `bin/`); `segment_match`
    asks for whole path segments instead.
    """
    hay = F.concat(F.lit("/"), path) if segment_match else path
    words = [f"/{d}" for d in dims.SKIP_DIRECTORIES] if segment_match else dims.SKIP_DIRECTORIES
    ext = paths.extension(path)
    named = (ext == "") & F.lower(paths.base_name(path)).isin(*dims.EXTENSIONLESS_CONFIG_NAMES)
    return (~dims.contains_any(hay, words) & ~ext.isin(*dims.SKIP_EXTENSIONS)
            & (ext.isin(*dims.ANALYSABLE_EXTENSIONS) | named))


def filter_analysable(files: DataFrame, segment_match: bool = False) -> DataFrame:
    return files.where((F.col("type") == "file") & analysable(F.col("path"), segment_match))


def source_files(files: DataFrame) -> DataFrame:
    return files.where(paths.is_source(F.col("path")))


def is_key_file(path: Column, size: Column, max_size: int = 10_000) -> Column:
    """Manifests and marker files small enough to be read whole."""
    return paths.base_name(path).isin(*dims.KEY_FILE_NAMES) & (size < max_size)


def key_files(files: DataFrame, max_size: int = 10_000) -> DataFrame:
    return files.where(is_key_file(F.col("path"), F.col("size"), max_size))


def is_relevant(path: Column, agent: str) -> Column:
    """Whether an analyser looks at a file; analysers without a list look at everything."""
    return is_relevant_name(F.lower(paths.base_name(path)), paths.extension(path), agent)


def is_relevant_name(base: Column, ext: Column, agent: str) -> Column:
    """The same on a lower-cased base name and an extension."""
    if agent not in dims.AGENT_RELEVANCE:
        return F.lit(True)
    extensions, words = dims.AGENT_RELEVANCE[agent]
    hit = dims.contains_any(base, words)
    return hit | ext.isin(*extensions) if extensions else hit


def glob_pattern(globs) -> str:
    """One anchored regular expression for a list of globs, to be matched on `/` + path."""
    parts = []
    for glob in globs:
        body = re.escape(glob).replace(r"\*", ".*").replace(r"\?", ".")
        parts.append(body if "/" in glob else f".*/{body}")
    return "^(?:" + "|".join(parts) + ")$"


def in_scope(path: Column, include, exclude=()) -> Column:
    rooted = F.concat(F.lit("/"), path)
    hit = rooted.rlike(glob_pattern(include)) if include else F.lit(True)
    return hit & ~rooted.rlike(glob_pattern(exclude)) if exclude else hit


def scope_files(files: DataFrame, include: dict | None = None, exclude: dict | None = None) -> DataFrame:
    """Files of each analyser by its include and exclude globs: one row per (file, agent)."""
    include = dims.AGENT_INCLUDE_GLOBS if include is None else include
    exclude = dims.AGENT_EXCLUDE_GLOBS if exclude is None else exclude
    agents = F.array(*[F.when(in_scope(F.col("path"), globs, exclude.get(agent, ())), F.lit(agent))
                       for agent, globs in include.items()])
    return files.select("*", F.explode(F.array_compact(agents)).alias("agent"))


def security_files(files: DataFrame) -> DataFrame:
    return files.where(F.lower(F.col("path")).rlike("|".join(dims.SECURITY_PATH_WORDS)))


def filter_scanner_severity(findings: DataFrame, minimum: str) -> DataFrame:
    """Scanner scale; an unknown minimum keeps everything."""
    floor = dims.SCANNER_SCALE.get(minimum.upper(), 1)
    return findings.where(severity.rank(severity.scanner_severity(F.col("impact")), dims.SCANNER_SCALE) >= floor)


def filter_severity4(findings: DataFrame, minimum: str, column: str = "severity") -> DataFrame:
    """Four-level scale; an unknown minimum keeps everything, an unknown row severity ranks 0."""
    floor = dims.FOUR_LEVEL_SCALE.get(minimum.upper())
    if floor is None:
        return findings
    return findings.where(severity.rank(F.col(column), dims.FOUR_LEVEL_SCALE) >= floor)


def filter_report_severity(findings: DataFrame, minimum: str, column: str = "impact") -> DataFrame:
    """Report scale. CRITICAL rows count as HIGH, so a CRITICAL minimum keeps nothing."""
    floor = dims.REPORT_SCALE.get(minimum.upper(), 1)
    return findings.where(severity.rank(severity.report_severity(F.col(column)), dims.REPORT_SCALE) >= floor)


def report_eligible(findings: DataFrame, impacts=("HIGH", "MEDIUM", "LOW")) -> DataFrame:
    return findings.where(F.upper(F.col("impact")).isin(*impacts))


def mark_filtered(validated: DataFrame, threshold: float = 0.7) -> DataFrame:
    """`is_filtered`: judged not legitimate, or below the threshold; never without a validation."""
    rejected = ~F.col("is_legitimate") | (F.col("validation_confidence") < threshold)
    return validated.withColumn("is_filtered", F.coalesce(rejected, F.lit(False)))


def apply_validation(validated: DataFrame, threshold: float = 0.7, enabled: bool = True) -> DataFrame:
    marked = mark_filtered(validated, threshold)
    return marked.where(~F.col("is_filtered")) if enabled else marked


def agent_of(check_id: Column) -> Column:
    """Analyser named at the start of a rule id."""
    return F.regexp_extract(check_id, r"^(code-[a-z]+-analyser)", 1)


def filter_agent_confidence(findings: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Each analyser has its own minimum confidence; rules of no known analyser pass."""
    floor = dims.lookup(agent_of(F.col("check_id")), thresholds or dims.AGENT_CONFIDENCE, 0.0)
    return findings.where(F.col("confidence") >= floor)


def gate_fixes(fixes: DataFrame, minimum: float = 0.8, floor: float = 0.5) -> DataFrame:
    """`gate` says why a fix is kept or not: rejected, skipped or accepted."""
    c = F.col("confidence")
    return fixes.withColumn(
        "gate", F.when(c < floor, "rejected").when(c < minimum, "skipped").otherwise("accepted"))


def valid_fixes(fixes: DataFrame) -> DataFrame:
    return fixes.where(ff.is_valid_fix(F.col("original_code"), F.col("fixed_code")))


def skipped_files(files: DataFrame, max_bytes: int = 1_000_000, excludes=()) -> DataFrame:
    """(repo, path, size, reason) of the files that `limit_targets` leaves out."""
    reason = F.when(F.col("size") > max_bytes, F.lit("too large"))
    if excludes:
        reason = reason.when(F.concat(F.lit("/"), F.col("path")).rlike(glob_pattern(excludes)), "excluded")
    return files.select("repo", "path", "size", reason.alias("reason")).where(F.col("reason").isNotNull())


def limit_targets(files: DataFrame, max_bytes: int = 1_000_000, excludes=()) -> DataFrame:
    """Files small enough to scan and outside the excluded globs."""
    keep = F.col("size") <= max_bytes
    if excludes:
        keep = keep & ~F.concat(F.lit("/"), F.col("path")).rlike(glob_pattern(excludes))
    return files.where(keep)


def scope_path(files: DataFrame, prefix: str) -> DataFrame:
    prefix = prefix.strip("/")
    if not prefix:
        return files
    path = F.col("path")
    return files.where((path == prefix) | path.startswith(prefix + "/"))


def path_roles(files: DataFrame) -> DataFrame:
    """Entry point, config, test and documentation flags by exact names and by substrings."""
    base = F.lower(paths.base_name(F.col("path")))
    low = F.lower(F.col("path"))
    ends = lambda c, *suffixes: c.rlike("(?:" + "|".join(re.escape(s) for s in suffixes) + ")$")
    return files.select(
        "*",
        base.isin(*dims.ENTRY_POINT_NAMES).alias("named_entry"),
        (base.contains("config") | base.isin(*dims.CONFIG_FILE_NAMES)
         | ends(base, ".conf", ".yaml", ".yml")).alias("named_config"),
        F.regexp_extract(low, r"^(.*)/[^/]*$", 1).contains("test").alias("named_test"),
        (base.contains("readme") | base.contains("doc") | ends(base, ".md")).alias("named_doc"),
        dims.contains_any(low, ("main.", "index.", "app.", "server.")).alias("loose_entry"),
        (low.contains("config") | ends(low, ".conf", ".yaml", ".yml")
         | (ends(low, ".json") & (low.contains("package") | low.contains("config")))).alias("loose_config"),
        (low.contains("test") | low.contains("spec")).alias("loose_test"),
        (ends(low, ".md", ".rst") | (ends(low, ".txt") & low.contains("readme"))).alias("loose_doc"),
    )
