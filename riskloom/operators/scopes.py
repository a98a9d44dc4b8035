"""The function around a line: findings meet the innermost function scope that is open where they stand.

Scopes are read from lines alone. In languages with braces a function opens with the first brace at or behind its head, if no
other head comes before, and ends with the first line after which no more braces are open than before its head. In Python it ends
before the next line with code that is indented no deeper than its head. Braces in strings and comments don't count.

Every fall of the depth (or indentation) is an event of each level it passes, so the end of a head is the next event of its own
level: a running value, no range join. The same holds for findings: the innermost scope at a line with n open scopes is the last
one that began as the n-th. Windows hold lines, heads and distinct finding lines of one file, which is one row to begin with;
findings themselves are joined to the answers of their lines, so a file with most of the findings is left to adaptive skew handling.

Nulls and odd input: a finding without a line, outside its file or outside any function has the name `unknown` and no lines. A
file without content has no scopes, a function that is never closed ends with its file. Repeated findings stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import paths
from riskloom.operators.content import FILE_KEYS, files_of, lines

HEAD = (r"^[ \t]*(?:(?:export|default|public|private|protected|internal|static|async|pub|final|abstract)[ \t]+)*"
        r"(?:function[ \t*]+|def[ \t]+|func[ \t]+(?:\([^)]*\)[ \t]*)?|fn[ \t]+)([A-Za-z_$][A-Za-z0-9_$]*)")
STRINGS = r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'"""
COMMENT = r"//.*$|^[ \t]*#.*$"
UNKNOWN = "unknown"
ENDS, STARTS, PLACES = range(3)      # what comes first on a line


def _by_line(*more: str) -> Window:
    return Window.partitionBy(*FILE_KEYS, *more)


def _dealt(files: DataFrame) -> DataFrame:
    """Files by their key in as many partitions as shuffles have, named so that none are put together by their bytes: contents that
    shuffle small unfold into many lines, and the windows over a file's lines stay where its content is. The keys are turned around, as
    Spark leaves out a repartition that equals the one of the join below, whose partitions are put together."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), *reversed(FILE_KEYS))


def _marked(files: DataFrame) -> DataFrame:
    """Lines with the name they are the head of, their indentation if they hold code, and the braces open before and after them."""
    bare = F.regexp_replace(F.regexp_replace("text", STRINGS, ""), COMMENT, "")
    step = F.regexp_count("bare", F.lit(r"\{")) - F.regexp_count("bare", F.lit(r"\}"))
    upto = _by_line().orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines(_dealt(files.select(*FILE_KEYS, "content"))).withColumn("bare", bare).select(
        *FILE_KEYS, "line", F.nullif(F.regexp_extract("text", HEAD, 1), F.lit("")).alias("name"),
        F.when(F.btrim("bare", F.lit(" \t\r")) != "", F.length(F.regexp_extract("text", r"^([ \t]*)", 1))).alias("indent"),
        F.coalesce(paths.lang_of(F.col("path")) == "Python", F.lit(False)).alias("indented"),
        F.contains("bare", F.lit("{")).alias("opens"), F.sum(step).over(upto).alias("depth"), step.alias("step")) \
        .withColumn("before", F.col("depth") - F.col("step"))


def scopes(files: DataFrame) -> DataFrame:
    """repo, path, name, start_line, end_line of every function."""
    earlier = _by_line().orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    from_here = _by_line().orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, 0)
    later = _by_line().orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    seen = _marked(files).withColumns({
        "above": F.last("indent", True).over(earlier),
        "body": F.last(F.when(F.col("opens"), F.struct("line", "depth")), True).over(from_here),
        "next_head": F.last(F.when(F.col("name").isNotNull(), F.col("line")), True).over(later),
        "last_line": F.first("line").over(from_here)})

    indented = F.col("indented")
    has_body = F.col("body").isNotNull() & (F.col("next_head").isNull() | (F.col("body.line") < F.col("next_head")))
    heads = seen.where(F.col("name").isNotNull() & (indented | has_body)).select(
        *FILE_KEYS, F.when(indented, F.col("indent")).otherwise(F.col("before")).alias("level"),
        F.when(indented, F.col("line")).otherwise(F.col("body.line")).alias("at"), F.lit(0).alias("kind"), "name",
        F.col("line").alias("start_line"), F.when(~indented & (F.col("body.depth") <= F.col("before")), F.col("body.line")).alias("end"), "last_line")
    falls = F.when(indented & (F.col("indent") <= F.col("above")), F.sequence("indent", "above")) \
        .when(~indented & (F.col("depth") < F.col("before")), F.sequence(F.col("depth"), F.col("before") - 1).cast("array<int>"))
    closes = seen.select(*FILE_KEYS, F.explode(falls).alias("level"), F.col("line").alias("at"), F.lit(1).alias("kind"),
                         F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("start_line"),
                         F.when(indented, F.col("line") - 1).otherwise(F.col("line")).alias("end"), F.lit(None).cast("int").alias("last_line"))
    # From the last line up, a head before the falls of its line: the fall that was seen last is the next one behind the head.
    ahead = _by_line("level").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    return heads.union(closes).withColumn("fall", F.last(F.when(F.col("kind") == 1, F.col("end")), True).over(ahead)) \
        .where("kind = 0").select(*FILE_KEYS, "name", "start_line", F.coalesce("end", "fall", "last_line").alias("end_line"))


def enclosing_functions(findings: DataFrame, files: DataFrame, line: str = "start_line") -> DataFrame:
    """findings with function, function_start and function_end: the innermost function around their line."""
    found = ("function", "function_start", "function_end")
    places = findings.where(F.col(line).isNotNull()).select(*FILE_KEYS, F.col(line).cast("int").alias("at")).distinct()
    spans = scopes(files_of(findings, files))
    scope = F.struct("name", "start_line", "end_line")

    def event(at: Column, kind: int, step: int, begun: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(kind).alias("kind"), F.lit(step).alias("step"), begun.alias("begun"))

    both = F.array(event(F.col("start_line"), STARTS, 1, scope), event(F.col("end_line") + 1, ENDS, -1, F.lit(None)))
    events = spans.select(*FILE_KEYS, F.explode(both).alias("e")).select(*FILE_KEYS, "e.*") \
        .union(places.select(*FILE_KEYS, "at", F.lit(PLACES), F.lit(0), F.lit(None)))
    running = _by_line().orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    same = _by_line("nest").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    answers = events.withColumn("nest", F.sum("step").over(running)).withColumn("scope", F.last("begun", True).over(same)) \
        .where((F.col("kind") == PLACES) & (F.col("nest") > 0)) \
        .select(*FILE_KEYS, F.col("at").alias(line), *[F.col(f"scope.{c}").alias(n) for c, n in zip(("name", "start_line", "end_line"), found)])
    return findings.drop(*found).join(answers, [*FILE_KEYS, line], "left").withColumn(found[0], F.coalesce(found[0], F.lit(UNKNOWN)))
