"""Line matching: rules, secrets, code points, pages, payloads and traversal.

A catalog is folded into the plan as one constant list, so nothing is joined. A file is
first tested as a whole: by language, then by cheap text search, then by expression. Only
the (file, rule) pairs that hit are split into lines and searched line by line; as the
lines of a pair follow each other, its expression is compiled once per pair.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import dims
from riskloom.functions import findings as ff
from riskloom.functions import paths, text
from riskloom.rule_catalog import ALL_RULES, CODE_POINTS, HTML_CHECKS, SECRET_DETECTORS, rules_from_frame


def _catalog(entries: list[dict]) -> Column:
    """The catalog as one constant list of structs; Spark folds it while planning."""
    texts = [k for k in entries[0] if k not in ("needles", "languages")]
    schema = ", ".join([f"{k}: string" for k in texts] + ["anywhere: string", "needles: array<string>", "languages: array<string>"])
    rows = [{"languages": [], **e, "anywhere": "(?m)" + e["regex"]} for e in entries]
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")


def _found(line: Column, regex: Column) -> Column:
    return F.regexp_instr(line, regex) > 0


def _hit_lines(files: DataFrame, entries: list[dict], gate=None) -> DataFrame:
    """(file columns, `_c` catalog entry, `line`, `text`) for all lines of files that contain the entry anywhere.

    `(?m)` makes the whole-file test hold whenever a single line matches. `gate` is a cheap extra
    test on the entry.
    """
    def anywhere(entry):
        needles = entry["needles"]
        test = (F.size(needles) == 0) | F.exists(needles, lambda n: F.col("_low").contains(n))
        test = test & _found(F.col("content"), entry["anywhere"])
        return gate(entry) & test if gate is not None else test

    rest = [c for c in files.columns if c != "content"]
    low = files.withColumn("_low", F.lower("content"))
    hits = low.select(*rest, "content", F.explode(F.filter(_catalog(entries), anywhere)).alias("_c"))
    return (hits.select(*rest, "_c", F.posexplode(text.code_lines(F.col("content"))).alias("_pos", "text"))
            .select(*rest, "_c", (F.col("_pos") + 1).alias("line"), "text"))


def match_rules(files: DataFrame, rules=ALL_RULES, agents_column: str | None = None) -> DataFrame:
    """Findings of a rule catalog (a sequence of rules or a rules table) over all files.

    `agents_column` names an array of the analysers that look at a file; only their rules run on it.
    """
    if isinstance(rules, DataFrame):
        rules = rules_from_frame(rules)
    entries = [dict(regex=r.regex, not_regex=r.not_regex, needles=r.needles, languages=r.languages, check_id=r.rule_id,
                    agent=r.agent, impact=r.impact, cwe=r.cwe) for r in rules]

    def gate(entry):
        ok = (F.size(entry["languages"]) == 0) | F.array_contains(
            entry["languages"], F.coalesce(F.col("_language"), F.lit("")))
        return ok & F.array_contains(F.col(agents_column), entry["agent"]) if agents_column else ok

    wanted = ["repo", "path", "content"] + ([agents_column] if agents_column else [])
    at = _hit_lines(files.select(*wanted, paths.lang_of(F.col("path")).alias("_language")), entries, gate)
    line = F.col("text")
    holds = _found(line, F.col("_c.regex")) & (F.col("_c.not_regex").isNull() | ~_found(line, F.col("_c.not_regex")))
    return at.where(holds).select("repo", "path", F.col("line").alias("start_line"), F.col("line").alias("end_line"),
                                  "_c.check_id", "_c.agent", "_c.impact", "_c.cwe", line.alias("code"))


def detect_secrets(files: DataFrame, detectors=SECRET_DETECTORS, min_entropy: float = 0.0) -> DataFrame:
    """Hard-coded secrets: every match of every detector, redacted, with its entropy. Never verified."""
    entries = [dict(regex=regex, needles=needles, detector=name) for name, regex, needles in detectors]
    at = _hit_lines(files.select("repo", "path", "content"), entries)
    secrets = at.select("repo", "path", "line", "_c.detector",
                        F.explode(F.regexp_extract_all("text", "_c.regex", F.lit(1))).alias("value"))
    return (secrets.select("repo", "path", "line", "detector", ff.redact(F.col("value")).alias("redacted"),
                           F.sha2(F.col("value"), 256).alias("value_hash"),
                           ff.shannon_entropy(F.col("value")).alias("entropy"), F.lit(False).alias("verified"))
            .where(F.col("entropy") >= min_entropy))


def match_magic(files: DataFrame, column: str = "data") -> DataFrame:
    """Serialised payloads by the first bytes of a binary column."""
    head = F.hex(F.substring(F.col(column), 1, 4))
    kind = F.when(head.startswith(dims.MAGIC_SIGNATURES[0][0]), dims.MAGIC_SIGNATURES[0][1])
    for signature, name in dims.MAGIC_SIGNATURES[1:]:
        kind = kind.when(head.startswith(signature), name)
    return (files.select(*[c for c in files.columns if c != column], kind.alias("format"))
            .where(F.col("format").isNotNull()))


def code_points(files: DataFrame, catalog=CODE_POINTS) -> DataFrame:
    """Input sources, dangerous sinks and security controls by line."""
    entries = [dict(regex=regex, needles=needles, kind=kind, type=name) for kind, name, regex, needles in catalog]
    at = _hit_lines(files.select("repo", "path", "content"), entries)
    return (at.where(_found(F.col("text"), F.col("_c.regex")))
            .select("repo", "path", "line", "_c.kind", "_c.type",
                    F.regexp_substr("text", "_c.regex").alias("symbol")))


def _point_lines(points: DataFrame) -> DataFrame:
    """One row per line with points, so the windows below see at most the lines of one file."""
    kind = F.col("kind")
    return points.groupBy("repo", "path", "line").agg(
        F.max(kind == "source").alias("is_source"), F.max(kind == "control").alias("is_control"),
        F.collect_set(F.when(kind == "sink", F.col("type"))).alias("sinks"))


def nearest_source(points: DataFrame, n: int) -> DataFrame:
    """Lines with a sink and the nearest source at most `n` lines above (or on) them."""
    near = Window.partitionBy("repo", "path").orderBy("line").rangeBetween(-n, Window.currentRow)
    return (_point_lines(points)
            .withColumn("source_line", F.max(F.when(F.col("is_source"), F.col("line"))).over(near))
            .where(F.size("sinks") > 0).select("repo", "path", "line", "source_line"))


def taint_pairs(points: DataFrame, n: int = 20) -> DataFrame:
    """Source to sink rows: nearest source within `n` lines, `controlled` when a control lies between."""
    near = Window.partitionBy("repo", "path").orderBy("line").rangeBetween(-n, Window.currentRow)
    paired = (_point_lines(points)
              .withColumn("source_line", F.max(F.when(F.col("is_source"), F.col("line"))).over(near))
              .withColumn("control_line", F.max(F.when(F.col("is_control"), F.col("line"))).over(near)))
    return (paired.where(F.col("source_line").isNotNull() & (F.size("sinks") > 0))
            .select("repo", "path", "source_line", F.col("line").alias("sink_line"),
                    F.explode("sinks").alias("sink_type"),
                    F.coalesce(F.col("control_line") >= F.col("source_line"), F.lit(False)).alias("controlled")))


def html_checks(pages: DataFrame, checks=HTML_CHECKS) -> DataFrame:
    """Exposure checks on whole pages, present patterns and missing ones alike."""
    html = F.col("html")
    tests = F.array(*[F.when(html.rlike(p) if present else ~html.rlike(p),
                             F.struct(F.lit(name).alias("check_id"), F.lit(impact).alias("impact")))
                      for name, impact, p, present in checks])
    rest = [c for c in pages.columns if c != "html"]
    return pages.select(*rest, F.explode(F.array_compact(tests)).alias("_c")).select(*rest, "_c.*")


def decoded_path(value: Column) -> Column:
    """Undo URL encoding twice, overlong slashes and full-width slashes."""
    overlong = lambda c: F.regexp_replace(c, r"(?i)%c0%af", "/")
    once = F.coalesce(F.try_url_decode(overlong(value)), value)
    twice = F.coalesce(F.try_url_decode(overlong(once)), once)
    return F.translate(twice, "／＼", "/\\")


def traversal_hits(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value climbs out of its folder, before or after decoding."""
    climbs = r"\.\.[/\\]"
    return (df.withColumn("decoded", decoded_path(F.col(column)))
            .where(F.col("decoded").rlike(climbs))
            .withColumn("encoded", ~F.col(column).rlike(climbs)))


def crypto_grade(findings: DataFrame, column: str = "algorithm") -> DataFrame:
    """Strength of the named algorithm; unknown names are kept as `unknown`."""
    return findings.withColumn("grade", dims.lookup(F.lower(F.col(column)), dims.CRYPTO_GRADES, "unknown"))
