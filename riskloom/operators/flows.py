"""Data flow through variables: from a source of input, over assignments, to a dangerous sink.

A file's assignments are definitions, one per line. A use of a variable means the latest definition above it, so uses become edges
between definitions by an as-of window over (file, variable). A definition on a source's line is tainted; one on a control's line
(validation, encoding, a prepared statement) is clean, and what goes into it goes no further. A definition that doesn't use the tainted
value replaces it. Tainted definitions are found by a frontier that is joined with the edges until nothing new is reached, so a flow may
be of any length. A definition is settled in the first round that reaches it, so each is stored once.

Flow is by lines from top to bottom, without branches and without calls; (repo, path) names a file. Text in quotes is no use of a
variable. A null content has no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.content import lines
from riskloom.session import cut_lineage

IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
ASSIGNMENT = rf"^[ \t]*(?:[A-Za-z_][A-Za-z0-9_.<>\[\]]*[ \t]+){{0,3}}({IDENTIFIER})[ \t]*([+.]?=|:=)[ \t]*([^=].*)$"
QUOTED = "\"[^\"]*\"|'[^']*'"
FILE = ["repo", "path"]


def _used(code: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(code, QUOTED, " "), F.lit(f"({IDENTIFIER})"), F.lit(1)))


def code_uses(files: DataFrame, points: DataFrame) -> DataFrame:
    """repo, path, line, var (defined here, or null), uses, is_source, is_control, sinks: the lines that define a variable or hold a sink."""
    kind = F.col("kind")
    marks = points.groupBy(*FILE, "line").agg(
        F.max(kind == "source").alias("is_source"), F.max(kind == "control").alias("is_control"),
        F.sort_array(F.collect_set(F.when(kind == "sink", F.col("type")))).alias("sinks"))
    part = lambda i: F.regexp_extract("text", ASSIGNMENT, i)
    found = lines(files.select(*FILE, "content")).withColumn("var", F.when(part(1) != "", part(1))) \
        .withColumn("uses", F.when(F.col("var").isNull(), _used(F.col("text"))).when(part(2).isin("=", ":="), _used(part(3)))
                    .otherwise(F.array_union(_used(part(3)), F.array("var")))).drop("text")
    no = lambda name: F.coalesce(name, F.lit(False)).alias(name)
    return found.join(marks, [*FILE, "line"], "left").where(F.col("var").isNotNull() | (F.size("sinks") > 0)) \
        .select(*FILE, "line", "var", "uses", no("is_source"), no("is_control"), F.coalesce("sinks", F.array().cast("array<string>")).alias("sinks"))


def use_edges(code: DataFrame) -> DataFrame:
    """repo, path, line, def_line: each used variable's latest definition above the line. A line uses what stood before its own definition."""
    definitions = code.where("var is not null").select(*FILE, "var", "line", F.lit(1).alias("defines"))
    uses = code.where(~F.col("is_control")).select(*FILE, F.explode("uses").alias("var"), "line", F.lit(0).alias("defines"))
    above = Window.partitionBy(*FILE, "var").orderBy("line", "defines").rowsBetween(Window.unboundedPreceding, -1)
    at = F.last(F.when(F.col("defines") == 1, F.col("line")), ignorenulls=True).over(above)
    return definitions.union(uses).withColumn("def_line", at).where("defines = 0 and def_line is not null") \
        .select(*FILE, "line", "def_line").distinct()


def tainted_definitions(code: DataFrame, edges: DataFrame) -> DataFrame:
    """repo, path, line, source_line, hops: the definitions that input reaches, each by the fewest assignments and then the nearest source."""
    into = cut_lineage(code.where("var is not null").select(*FILE, "line").join(edges, [*FILE, "line"])
                       .select(*FILE, F.col("def_line").alias("from_line"), F.col("line").alias("to_line")))
    frontier = cut_lineage(code.where("var is not null and is_source and not is_control")
                           .select(*FILE, "line", F.col("line").alias("source_line"), F.lit(0).alias("hops")))
    reached = frontier
    while frontier.limit(1).count():
        step = frontier.join(into.withColumnRenamed("from_line", "line"), [*FILE, "line"]) \
            .groupBy(*FILE, "to_line").agg(F.max("source_line").alias("source_line"), (F.max("hops") + 1).alias("hops")) \
            .withColumnRenamed("to_line", "line")
        frontier = cut_lineage(step.join(reached.select(*FILE, "line"), [*FILE, "line"], "left_anti"))
        reached = reached.union(frontier)
    return reached


def variable_flows(files: DataFrame, points: DataFrame) -> DataFrame:
    """repo, path, source_line, sink_line, sink_type, steps: for each sink that input reaches, its nearest source and the assignments between."""
    code = cut_lineage(code_uses(files, points))
    edges = cut_lineage(use_edges(code))
    tainted = tainted_definitions(code, edges)
    sinks = code.where("size(sinks) > 0 and not is_control")
    direct = sinks.where("is_source").select(*FILE, F.col("line").alias("sink_line"), F.col("line").alias("source_line"), F.lit(0).alias("steps"), "sinks")
    through = sinks.select(*FILE, "line", "sinks").join(edges, [*FILE, "line"]) \
        .select(*FILE, F.col("line").alias("sink_line"), F.col("def_line").alias("line"), "sinks").join(tainted, [*FILE, "line"]) \
        .select(*FILE, "sink_line", "source_line", (F.col("hops") + 1).alias("steps"), "sinks")
    best = direct.unionByName(through).groupBy(*FILE, "sink_line", "sinks").agg(F.min(F.struct("steps", (-F.col("source_line")).alias("back"))).alias("b"))
    return best.select(*FILE, (-F.col("b.back")).alias("source_line"), "sink_line", F.explode("sinks").alias("sink_type"), "b.steps")
