"""Joins between files, findings, validations, analysers and repository context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import dims
from riskloom.functions import paths
from riskloom.operators.filters import is_relevant_name

_LINE_BUCKET = 64


def with_validation(findings: DataFrame, validations: DataFrame, keys=("repo", "path")) -> DataFrame:
    """Findings with their validation, null when there is none. `validations` has one row per key."""
    right = validations.withColumnRenamed("confidence", "validation_confidence")
    return findings.join(right, list(keys), "left")


def assign_analysis(agents: DataFrame, analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Analysers with their analysis, and error rows for those without one.

    Both tables hold one row per analyser of a run, a handful by design.
    """
    ok = agents.join(analyses, "analysis_id")
    errors = (agents.join(analyses, "analysis_id", "left_anti")
              .select("agent_id", F.format_string("analysis not found for agent %s", F.col("agent_id")).alias("error")))
    return ok, errors


def route_arrays(files: DataFrame, agents) -> DataFrame:
    """Files with `agents`, the analysers that look at them. Give paths only: all columns take part in the join.

    An analyser without any relevant file in a repository gets all files of that repository.
    The check for that is one boolean per analyser and repository, combined on the map side.
    """
    agents = list(agents)
    names = files.withColumns({"_base": F.lower(paths.base_name(F.col("path"))), "_ext": paths.extension(F.col("path"))})
    tests = [is_relevant_name(F.col("_base"), F.col("_ext"), a) for a in agents]
    routed = (names.withColumn("_relevant", F.array_compact(F.array(*[F.when(t, F.lit(a)) for t, a in zip(tests, agents)])))
              .drop("_base", "_ext"))
    idle = (names.groupBy("repo").agg(*[F.max(t).alias(f"_a{i}") for i, t in enumerate(tests)])
            .select("repo", F.array_compact(F.array(*[F.when(~F.col(f"_a{i}"), F.lit(a))
                                                      for i, a in enumerate(agents)])).alias("_idle"))
            .where(F.size("_idle") > 0))
    joined = routed.join(idle, "repo", "left")
    none = F.array().cast("array<string>")
    return joined.select(*files.columns, F.concat("_relevant", F.coalesce("_idle", none)).alias("agents"))


def route_files(files: DataFrame, agents) -> DataFrame:
    """(repo, path, agent): which analyser looks at which file."""
    return (route_arrays(files.select("repo", "path"), agents)
            .select("repo", "path", F.explode("agents").alias("agent")))


def rulesets_frame(spark: SparkSession, table: dict) -> DataFrame:
    """A language or framework table as rows (name, position, ruleset)."""
    rows = [(name, i, r) for name, sets in table.items() for i, r in enumerate(sets)]
    return spark.createDataFrame(rows, "name string, position int, ruleset string")


def rulesets_for(names: DataFrame, table: dict) -> DataFrame:
    """Rule sets of each name in column `name`. The table is a constant of a few dozen rows."""
    return names.join(F.broadcast(rulesets_frame(names.sparkSession, table)), "name")


def unmatched(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_anti")


def matched(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_semi")


def secrets_in_findings(secrets: DataFrame, findings: DataFrame) -> DataFrame:
    """Secrets with the distinct finding ranges of the same file that cover their line.

    Ranges are cut into buckets of lines, so a file with many findings is spread over many
    keys and a secret is only compared with ranges near it.
    """
    bucket = lambda c: F.floor(c / _LINE_BUCKET).cast("int")
    ranges = (findings.select("repo", "path", "start_line", "end_line", "check_id").distinct()
              .withColumn("_b", F.explode(F.sequence(bucket(F.col("start_line")), bucket(F.col("end_line")))))
              .where(F.col("start_line") <= F.col("end_line")))
    left = secrets.withColumn("_b", bucket(F.col("line")))
    joined = ranges.join(left, ["repo", "path", "_b"])
    return joined.where(F.col("line").between(F.col("start_line"), F.col("end_line"))).drop("_b")


def with_context(findings: DataFrame, context: DataFrame) -> DataFrame:
    """Findings with the one context row of their repository."""
    return findings.join(context, "repo")


def agent_names(scheduled: bool = True) -> list[str]:
    return [a for _, a in dims.DECOMPOSED_ANALYSES] if scheduled else list(dims.AGENT_TYPES)
