"""Ranks, numbering, range merging and sorted output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from riskloom import dims
from riskloom.functions import findings as ff
from riskloom.functions import severity
from riskloom.operators.skew import number_rows, row_salt


def rank_languages(share: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Languages of a repository by share, with their role: primary, secondary, significant or minor.

    The window holds one row per language of a repository, so it stays small.
    """
    by_share = Window.partitionBy("repo").orderBy(F.desc("pct"), "language")
    significant = F.col("pct") >= threshold
    role = (F.when(F.col("rank") == 1, "primary").when((F.col("rank") == 2) & significant, "secondary")
            .when(significant, "significant").otherwise("minor"))
    return share.withColumn("rank", F.row_number().over(by_share)).withColumn("role", role)


def rank_frameworks(hits: DataFrame, k: int = 3) -> DataFrame:
    """Primary framework and at most `k` others per repository. One row per known framework at most."""
    by_hits = Window.partitionBy("repo").orderBy(F.desc("n"), F.desc("manifest_hits"), "framework")
    return (hits.where(F.col("category") == "framework")
            .withColumn("rank", F.row_number().over(by_hits))
            .where(F.col("rank") <= k + 1)
            .withColumn("role", F.when(F.col("rank") == 1, "primary").otherwise("secondary")))


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """The first row of each key. An aggregate, not a window: copies are dropped before the shuffle.

    Rows that `order` leaves equal are told apart by their other columns. Each value is held once: those that `order` names come
    first in the struct that is compared, and the others follow. Columns that can't be compared are carried beside it.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if all(_comparable(df.schema[c].dataType) for c in rest):
        leading = [o if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order)]
        named = {o for o in leading if isinstance(o, str)}
        first = F.min(F.struct(*leading, *[c for c in rest if c not in named]))
    else:
        first = F.min_by(F.struct(*rest), F.struct(*order))
    values = [F.col(f"_first.{c}").alias(c) for c in rest]
    return df.groupBy(*keys).agg(first.alias("_first")).select(*keys, *values).select(*df.columns)


def _comparable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _comparable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_comparable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (MapType, VariantType))


def number_findings(findings: DataFrame, order, prefix: str = "VULN", width: int = 4) -> DataFrame:
    """Sequential ids per repository over a total ascending order."""
    numbered = number_rows(findings, ["repo"], order, "_n")
    return numbered.withColumn("vuln_id", ff.format_id(prefix, width, F.col("_n"))).drop("_n")


def top_files(findings: DataFrame, k: int = 5) -> DataFrame:
    """Files with the most findings per repository, as `path (n vulns)`."""
    counts = findings.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n"))
    by_count = Window.partitionBy("repo").orderBy(F.desc("n"), "path")   # Spark limits each map task to k rows
    return (counts.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= k)
            .withColumn("label", F.format_string("%s (%d vulns)", "path", "n")))


def type_order(findings: DataFrame, title: str = "title") -> DataFrame:
    """Titles of a repository by count, then by their first place among the sorted findings."""
    place = F.struct(report_rank(F.col("severity")), F.col(title), F.col("path"), F.col("start_line"))
    counts = findings.groupBy("repo", title).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("_first"))
    by_count = Window.partitionBy("repo").orderBy(F.desc("n"), "_first")
    return counts.withColumn("position", F.row_number().over(by_count)).drop("_first")


def islands(ranges: DataFrame, gap: int, *more: Column) -> DataFrame:
    """(repo, path, start_line) -> `island`, the first line of the merged range it belongs to.

    Ranges are first reduced to one row per start line (with `more` aggregates), so a window holds
    at most the lines of one file.
    """
    by_start = ranges.groupBy("repo", "path", "start_line").agg(
        F.max("end_line").alias("end_line"), F.count(F.lit(1)).alias("n"), *more)
    ordered = Window.partitionBy("repo", "path").orderBy("start_line")
    reach = F.max("end_line").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = reach.isNull() | (F.col("start_line") > reach + gap)
    return (by_start.withColumn("_opens", opens)
            .withColumn("island", F.max(F.when(F.col("_opens"), F.col("start_line"))).over(ordered)).drop("_opens"))


def merge_ranges(findings: DataFrame, gap: int = 0) -> DataFrame:
    """Overlapping ranges of one file as one range; `gap` 1 also joins adjacent ones, more joins near ones."""
    return (islands(findings, gap).groupBy("repo", "path", "island")
            .agg(F.max("end_line").alias("end_line"), F.sum("n").alias("n_findings"))
            .withColumnRenamed("island", "start_line"))


def with_share(df: DataFrame, value: str, by) -> DataFrame:
    """Each row's share (percent) of its key's total. The totals are aggregated first, then joined."""
    totals = df.groupBy(*by).agg(F.sum(value).alias("total"))
    return df.join(totals, list(by)).withColumn("pct", F.col(value).cast("double") / F.col("total") * 100.0)


def report_rank(level: Column) -> Column:
    """Sort position of a report severity, worst first; unknown levels come before all."""
    order = {name: i for i, name in enumerate(dims.REPORT_DISPLAY_ORDER, start=1)}
    return severity.rank(F.upper(level), order)


def _sorted(df: DataFrame, *order) -> DataFrame:
    """Global sort. The tie column lets the range split divide a long run of equal rows."""
    return df.withColumn("_tie", row_salt(df, 1 << 20)).orderBy(*order, "_tie").drop("_tie")


def sort_findings(findings: DataFrame) -> DataFrame:
    return _sorted(findings, report_rank(F.col("severity")), "title", "path", "start_line")


def agent_rank(level: Column, compat: bool = False) -> Column:
    """Severity rank of analyser findings; `compat` ranks CRITICAL below LOW, as unknown."""
    return severity.rank(level, dims.AGENT_SCALE_COMPAT if compat else dims.AGENT_SCALE)


def sort_agent_findings(findings: DataFrame, compat: bool = False) -> DataFrame:
    return _sorted(findings, agent_rank(F.col("impact"), compat).desc(), "path", "start_line", "check_id")


def sort_secrets(secrets: DataFrame) -> DataFrame:
    return _sorted(secrets, F.desc("verified"), "secret_type", "path", "line")


def top_k(df: DataFrame, by, k: int) -> DataFrame:
    """The first `k` rows over a total order."""
    return df.orderBy(*by).limit(k)


def display_severities(counts: DataFrame) -> DataFrame:
    """Counts in the fixed display order, absent levels left out."""
    order = {name: i for i, name in enumerate(dims.REPORT_DISPLAY_ORDER, start=1)}
    return (counts.where(F.col("n") > 0).withColumn("position", dims.lookup(F.col("severity"), order))
            .where(F.col("position").isNotNull()))
