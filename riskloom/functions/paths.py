"""Path, language and URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import dims


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; empty when the base name has none."""
    return F.regexp_extract(F.lower(path), r"(\.[^./]*)$", 1)


def lang_of(path: Column) -> Column:
    """Language of a source file by extension; null when unknown."""
    return dims.lookup(extension(path), dims.LANGUAGE_BY_EXTENSION)


def highlight_lang(path: Column) -> Column:
    return dims.lookup(extension(path), dims.HIGHLIGHT_BY_EXTENSION, "text")


def core_lang(path: Column) -> Column:
    """Language out of the short list used for the dominant language of a repository."""
    return dims.lookup(extension(path), dims.CORE_LANGUAGE_BY_EXTENSION)


def file_type(path: Column) -> Column:
    """Extension without its dot, or `file`."""
    ext = extension(path)
    return F.when(ext == "", F.lit("file")).otherwise(F.regexp_replace(ext, r"^\.", ""))


def is_source(path: Column) -> Column:
    return extension(path).isin(*dims.SOURCE_EXTENSIONS)


def is_code(path: Column) -> Column:
    return extension(path).isin(*dims.CODE_EXTENSIONS)


def relative_path(path: Column, prefix: str) -> Column:
    """Path below `prefix`, without a leading slash."""
    cut = F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)
    return F.regexp_replace(cut, r"^/", "")


def top_component(path: Column, depth: int = 1) -> Column:
    """First `depth` directories of the path; `.` for files at the root."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    head = F.slice(dirs, 1, depth)
    return F.when(F.size(head) == 0, F.lit(".")).otherwise(F.array_join(head, "/"))


def norm_language(name: Column) -> Column:
    return F.trim(name)


def profile_key(language: Column, framework: Column) -> Column:
    """`language[-framework]`, lower case, blanks as dashes; no framework part for `None` or empty."""
    part = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("-")))
    has_framework = framework.isNotNull() & ~framework.isin("None", "")
    return F.when(has_framework, F.concat_ws("-", part(language), part(framework))).otherwise(part(language))


def deep_link(target: Column, path: Column, start: Column, end: Column) -> Column:
    """Link to the lines of a file in the hosted repository, without the scan's temporary folder."""
    base = F.regexp_replace(F.regexp_replace(target, r"/$", ""), r"\.git$", "")
    inside = F.regexp_extract(path, r"^(?:[^/]*/)*?temp-[^/]*/[^/]*/(.*)$", 1)
    in_temp = path.contains("/temp-") & path.rlike(r"^(?:[^/]*/)*?temp-[^/]*/[^/]*/")
    clean = F.when(in_temp, inside).otherwise(path)
    lines = F.when(start == end, F.format_string("#L%d", start)).otherwise(F.format_string("#L%d-L%d", start, end))
    return F.concat(base, F.lit("/blob/main/"), clean, lines)


def parse_repo_url(url: Column) -> Column:
    """Struct `owner, name, valid` of a hosted repository URL (https, http and git@ forms)."""
    known = url.contains("github.com")
    rest = F.regexp_replace(url, r"^(?:git@github\.com:|https://github\.com/|http://github\.com/)", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"\.git$", ""), r"/$", "")
    parts = F.split(rest, "/")
    valid = known & (F.size(parts) >= 2)
    return F.struct(
        F.when(valid, F.get(parts, F.lit(0))).alias("owner"),
        F.when(valid, F.get(parts, F.lit(1))).alias("name"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )
