"""Applying proposed fixes to files, and the text that describes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.operators.content import files_of
from riskloom.operators.skew import number_rows, numbered_lists

_KEYS = ["repo", "path"]
_RANGE = ["start_line", "end_line"]


def _sized(files: DataFrame, fixes: DataFrame, how: str) -> DataFrame:
    """Fixes with `_valid`: their range lies inside the file. Null when there is no such file."""
    sizes = files_of(fixes, files).select(*_KEYS, F.size(text.code_lines(F.col("content"))).alias("_lines"))
    valid = (F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line")) & (F.col("end_line") <= F.col("_lines"))
    return fixes.join(sizes, _KEYS, how).withColumn("_valid", valid).drop("_lines")


def _order() -> Column:
    """The most confident fix comes first, then the first in the file."""
    return F.struct((-F.col("confidence")).alias("c"), F.col("start_line").alias("s"), F.col("end_line").alias("e"),
                    F.col("fixed_code").alias("code"))


def _chosen(valid: DataFrame) -> DataFrame:
    """(repo, path, chain, `_chosen`): the fixes to apply, in order of confidence, for each chain of overlapping ranges.

    Fixes are taken by confidence as long as they touch none that is taken already. A chain is reduced to one fix per
    range first; fixes of different chains never meet.
    """
    ranges = valid.groupBy(*_KEYS, *_RANGE).agg(F.min(_order()).alias("_best"))
    placed = Window.partitionBy(*_KEYS).orderBy(*_RANGE)     # the distinct ranges of one file
    reach = F.max("end_line").over(placed.rowsBetween(Window.unboundedPreceding, -1))
    opens = (reach.isNull() | (F.col("start_line") > reach)).cast("int")
    chains = ranges.withColumn("_opens", opens).withColumn("chain", F.sum("_opens").over(placed))
    tried = F.sort_array(F.collect_list("_best"))

    def take(taken, fix):
        touches = F.exists(taken, lambda t: (t["s"] <= fix["e"]) & (fix["s"] <= t["e"]))
        return F.when(touches, taken).otherwise(F.concat(taken, F.array(fix)))

    per_chain = chains.groupBy(*_KEYS, "chain").agg(tried.alias("_tried"))
    none = F.filter("_tried", lambda _: F.lit(False))
    return per_chain.select(*_KEYS, "chain", F.aggregate("_tried", none, take).alias("_chosen"))


def select_fixes(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """Every fix with its `status`: applied, overlapped, invalid (outside the file) or missing (no file).

    `fixes` needs repo, path, start_line, end_line, fixed_code, confidence.
    """
    checked = _sized(files, fixes, "left")
    best = _chosen(checked.where("_valid")).select(*_KEYS, F.explode("_chosen").alias("_best")) \
        .select(*_KEYS, F.col("_best.s").alias("start_line"), F.col("_best.e").alias("end_line"), "_best")
    judged = checked.join(best, _KEYS + _RANGE, "left")
    status = (F.when(F.col("_valid").isNull(), "missing").when(~F.col("_valid"), "invalid")
              .when(_order() == F.col("_best"), "applied").otherwise("overlapped"))
    return judged.select(*fixes.columns, status.alias("status"))


def apply_fixes(files: DataFrame, fixes: DataFrame, untouched: bool = False) -> DataFrame:
    """The files that fixes change, with the fixes spliced in and their number; with `untouched`, all other files too.

    Files without a fix are left out before contents are shuffled, so a writer can leave them alone.
    """
    slim = fixes.select(*_KEYS, "start_line", "end_line", "fixed_code", "confidence")
    taken = F.flatten(F.collect_list("_chosen"))
    per_file = _chosen(_sized(files, slim, "inner").where("_valid")).groupBy(*_KEYS).agg(
        F.sort_array(F.transform(taken, lambda t: F.struct(
            t["s"].alias("start_line"), t["e"].alias("end_line"), t["code"].alias("fixed_code")))).alias("_fixes"))
    joined = files.join(per_file, _KEYS, "left" if untouched else "inner")
    lines, fixes_ = text.code_lines(F.col("content")), F.col("_fixes")

    def piece(fix, i):
        after = F.when(i == 0, 0).otherwise(F.get(fixes_, i - 1)["end_line"])
        return F.concat(F.slice(lines, after + 1, fix["start_line"] - after - 1), F.split(fix["fixed_code"], "\n"))

    last = F.element_at(fixes_, -1)["end_line"]
    tail = F.slice(lines, last + 1, F.size(lines) - last)
    spliced = F.array_join(F.concat(F.flatten(F.transform(fixes_, piece)), tail), "\n")
    return joined.select(
        *[F.when(fixes_.isNull(), F.col("content")).otherwise(spliced).alias("content") if c == "content" else F.col(c)
          for c in files.columns],
        F.coalesce(F.size(fixes_), F.lit(0)).alias("n_fixes"))


def change_summary(fixes: DataFrame, order, size: int = 500) -> DataFrame:
    """Title and numbered list of fixes per repository, in parts that fit a change request."""
    numbered = number_rows(fixes, ["repo"], order, "_n")
    item = F.format_string("%d. **%s** in `%s` (lines %d-%d)\n   - %s", "_n", "vulnerability", "path", "start_line",
                           "end_line", "description")
    parts = numbered_lists(numbered, ["repo"], "_n", item, "_items", size)
    totals = fixes.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    return parts.join(totals, "repo").select(
        "repo", "part", "n", F.format_string("🔒 Security fixes (%d vulnerabilities)", "n").alias("title"),
        F.concat(F.lit("### Vulnerabilities Fixed:\n\n"), F.array_join("_items", "\n\n")).alias("body"))


def discussion_summary(fixes: DataFrame, order, size: int = 500) -> DataFrame:
    """Short numbered list of fixes per repository for a discussion, in parts."""
    numbered = number_rows(fixes, ["repo"], order, "_n")
    item = F.format_string("%d. **%s** in `%s`", "_n", "vulnerability", "path")
    return (numbered_lists(numbered, ["repo"], "_n", item, "_items", size)
            .select("repo", "part", F.concat(F.lit("### Vulnerability Summary:\n\n"),
                                             F.array_join("_items", "\n")).alias("body")))
