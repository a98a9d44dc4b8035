"""Deduplication, unions and list operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import findings as ff
from riskloom.operators.filters import agent_of
from riskloom.operators.ranking import keep_first, sort_agent_findings


def dedup_scanner(findings: DataFrame, order) -> DataFrame:
    return keep_first(findings, ["repo", "path", "start_line", "end_line", "check_id"], order)


def dedup_agent(findings: DataFrame, order) -> DataFrame:
    return keep_first(findings, ["repo", "path", "start_line", "check_id"], order)


def dedup_report(findings: DataFrame, order) -> DataFrame:
    return keep_first(findings, ["link", "start_line", "end_line", "title"], order)


def dedup_secrets(secrets: DataFrame, order=None) -> DataFrame:
    """One row per place, detector and value. Without an order, the other columns decide, so reruns keep the same row."""
    keys = [c for c in ("repo", "path", "line", "detector", "redacted", "value_hash") if c in secrets.columns]
    order = order or [c for c in secrets.columns if c not in keys]
    return keep_first(secrets, keys, order) if len(keys) < len(secrets.columns) else secrets.distinct()


def collect_agents(*frames: DataFrame, order, compat: bool = False) -> DataFrame:
    """Findings of all analysers in one sorted table, each (path, line, rule) once."""
    return sort_agent_findings(dedup_agent(reduce(DataFrame.unionByName, frames), order), compat)


def merge_sources(scanner: DataFrame, secrets: DataFrame, agents: DataFrame) -> DataFrame:
    """Scanner findings, secrets and analyser findings in one table, with their origin."""
    tagged = [frame.withColumn("origin", F.lit(name))
              for name, frame in (("scanner", scanner), ("secret", secrets), ("agent", agents))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def combine_rulesets(*columns: Column) -> Column:
    """Ordered concatenation of arrays, each value once."""
    return F.array_distinct(F.concat(*columns))


def merge_cross_agent(findings: DataFrame) -> DataFrame:
    """The same place and type found by several analysers, as one row with the sorted set of analysers."""
    return (findings.withColumn("agent", agent_of(F.col("check_id"))).withColumn("type", ff.agent_type(F.col("check_id")))
            .groupBy("repo", "path", "start_line", "type")
            .agg(F.array_sort(F.collect_set("agent")).alias("agents"), F.count(F.lit(1)).alias("n")))


def diff_rulesets(a: Column, b: Column) -> Column:
    """Struct `added, removed, kept` between two rule set lists."""
    return F.struct(F.array_except(b, a).alias("added"), F.array_except(a, b).alias("removed"),
                    F.array_intersect(a, b).alias("kept"))


def original_findings(validated: DataFrame, columns) -> DataFrame:
    return validated.select(*columns)
