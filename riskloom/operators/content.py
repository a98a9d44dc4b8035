"""Lines, snippets and code context. Files are joined to findings on (repo, path)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import paths, text

FILE_KEYS = ("repo", "path")
_FILE, _LINES, _NUMBERED, _START, _END = "_file", "_lines", "_numbered", "start_line", "end_line"


def lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    rest = [c for c in files.columns if c != "content"]
    return (files.select(*rest, F.posexplode(text.code_lines(F.col("content"))).alias("pos", "text"))
            .withColumn("line", F.col("pos") + 1).drop("pos"))


def files_of(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, content) of the files that have findings; the paths of the findings decide before contents are used."""
    return files.select(*FILE_KEYS, "content").join(findings.select(*FILE_KEYS).distinct(), list(FILE_KEYS), "left_semi")


def with_content(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with the content of their file; a finding whose file is missing is skipped."""
    return findings.join(files.select(*FILE_KEYS, "content"), list(FILE_KEYS))


def _with_lines(findings: DataFrame, files: DataFrame, numbered: bool = False, places: DataFrame | None = None) -> DataFrame:
    """Findings with `_lines`: only files that have findings are split, once per file and not once per finding.

    With `numbered`, `_numbered` holds the lines behind their numbers, made as often. A hash of the file's key comes first in the
    joins, so that their sorts compare numbers and not paths that begin alike. `findings` are read twice, once for their files;
    `places`, rows that name at least these files, spare the second reading if they come cheaper.
    """
    keyed = lambda df: df.withColumn(_FILE, F.xxhash64(*FILE_KEYS))
    wanted = keyed((findings if places is None else places).select(*FILE_KEYS)).distinct()
    split = keyed(files.select(*FILE_KEYS, "content")).join(wanted, [_FILE, *FILE_KEYS], "left_semi") \
        .select(_FILE, *FILE_KEYS, text.code_lines(F.col("content")).alias(_LINES))
    if numbered:
        split = split.withColumn(_NUMBERED, text.numbered(F.col(_LINES)))
    return keyed(findings).join(split, [_FILE, *FILE_KEYS]).drop(_FILE)


def snippets(findings: DataFrame, files: DataFrame) -> DataFrame:
    place = (F.col(_LINES), F.col(_START), F.col(_END))
    return _with_lines(findings, files).withColumn("snippet", text.snippet(*place)).drop(_LINES)


def numbered_context(findings: DataFrame, files: DataFrame, n: int = 5) -> DataFrame:
    place = (F.col(_LINES), F.col(_START), F.col(_END))
    return (_with_lines(findings, files)
            .withColumns({"vulnerable_code": text.snippet(*place), "context": text.numbered_context(*place, n)}).drop(_LINES))


def marked_context(findings: DataFrame, files: DataFrame, n: int = 10, places: DataFrame | None = None) -> DataFrame:
    """Context with marks on the lines of the finding; findings outside their file are dropped. `places` as in `_with_lines`."""
    place = (F.col(_LINES), F.col(_START), F.col(_END))
    marked = text.marked_context(F.col(_NUMBERED), F.col(_START), F.col(_END), n)
    return (_with_lines(findings, files, True, places).where(text.valid_range(*place))
            .withColumns({"vulnerable_code": text.snippet(*place), "context": marked}).drop(_LINES, _NUMBERED))


def fix_context(findings: DataFrame, files: DataFrame, n: int = 5, places: DataFrame | None = None) -> DataFrame:
    """Exact lines and plain context for a fix request; findings outside their file are dropped. `places` as in `_with_lines`."""
    place = (F.col(_LINES), F.col(_START), F.col(_END))
    return (_with_lines(findings, files, places=places).where(text.valid_range(*place))
            .withColumns({"vulnerable_code": text.snippet(*place), "context": text.plain_context(*place, n)}).drop(_LINES))


def loc(files: DataFrame, lines_per_file: int = 50) -> DataFrame:
    """Estimated and counted lines of code per repository."""
    code = paths.is_code(F.col("path"))
    return files.groupBy("repo").agg(
        (F.count_if(code) * lines_per_file).alias("estimated_loc"),
        F.sum(F.when(code, F.regexp_count(F.col("content"), F.lit("\n")) + 1).otherwise(0)).alias("loc"))


def function_count(files: DataFrame) -> DataFrame:
    """Function definitions per repository, counted by their keyword."""
    found = F.regexp_count(F.col("content"), F.lit(r"(?m)(?:^|[ \t])(?:function|def|func|fn) +[A-Za-z_]"))
    return files.groupBy("repo").agg(F.sum(found).cast("bigint").alias("functions"))
