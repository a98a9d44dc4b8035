"""Related findings: those of one file whose line ranges overlap, directly or through others, whichever analysers reported them.

Overlap groups of ranges on a line are what a sweep over the start lines leaves connected: a group begins where a range starts behind
the reach of all before it. Findings are first reduced to one row per start line. A file's lines are cut in blocks, each swept in a
window of its own; what earlier blocks reach, and the group they end in, comes from one row per block. So no window holds more
than `BLOCK` rows or the blocks of one file, however many findings a file has. Rows are dealt out by their block once: the window, the
row per block and the join with it share that.

Nulls and odd input: an end that is null or above its start counts as the start. Findings without a line form one group per file.
Null repositories, paths and other keys are values of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import findings as ff
from riskloom.operators.filters import agent_of
from riskloom.operators.ranking import agent_rank

BLOCK = 4096
FILE = ("repo", "path")


def _reach():
    return F.max(F.when(F.col("start_line").isNotNull(), F.greatest("start_line", "end_line"))).alias("_reach")


def _grouped(starts: DataFrame, block: int) -> DataFrame:
    """`_file`, `_line`, group_line out of `_file` (the keys as a struct, in which nulls are equal), start_line and `_line`, a struct whose
    first field is the reach.

    Inside its block, a line begins a group if it lies behind the reach of those before it (`_first` is the last such line up to a
    row's). Of these, the ones behind the reach of all earlier blocks begin one in the file too; where `_first` doesn't, the row
    belongs to the last group that begins in an earlier block. A block's reach comes out of its largest `_line`, for which rows are
    needed whole: so they are made and moved once for the windows and the blocks, not once more without what blocks don't need.
    """
    rows = starts.withColumn("_block", F.struct("_file", F.floor(F.col("start_line") / block).alias("at"))) \
        .withColumn("_hash", F.xxhash64("_block")).drop("_file")
    inside = Window.partitionBy("_hash", "_block").orderBy("start_line")
    before, upto = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    here = F.max("_line._reach").over(before)
    swept = rows.withColumn("_first", F.when(here.isNull() | (F.col("start_line") > here), F.col("start_line"))) \
        .withColumn("_first", F.max("_first").over(upto))
    earlier = Window.partitionBy("_file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    behind = F.col("_carried").isNull() | (F.col("_first") > F.col("_carried"))
    blocks = swept.groupBy("_hash", "_block").agg(F.max("_line").alias("_top"), F.max("_first").alias("_first")) \
        .select(F.col("_block._file").alias("_file"), F.col("_block.at").alias("at"), F.col("_top._reach").alias("_reach"), "_first") \
        .withColumn("_carried", F.max("_reach").over(earlier)) \
        .withColumn("_open", F.max(F.when(behind, F.col("_first"))).over(earlier)) \
        .select(F.struct("_file", "at").alias("_block"), "_carried", "_open").withColumn("_hash", F.xxhash64("_block"))
    return swept.join(blocks.hint("merge"), ["_hash", "_block"]) \
        .select("_block._file", "start_line", "_line", F.when(behind, F.col("_first")).otherwise(F.col("_open")).alias("group_line"))


def _unpacked(keys: list[str]):
    return [F.col(f"_file.{k}").alias(k) for k in keys]


def overlap_groups(findings: DataFrame, by: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """repo, path, `by`, start_line, group_line: for every start line the first line of its group."""
    keys = [*FILE, *by]
    starts = findings.groupBy(F.struct(*keys).alias("_file"), "start_line").agg(_reach())
    return _grouped(starts.select("_file", "start_line", F.struct("_reach").alias("_line")), block).select(*_unpacked(keys), "start_line", "group_line")


def related_findings(findings: DataFrame, by: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """One row per group of related findings: its lines, sorted analysers and types, the worst impact, and how many findings it merges.

    `by` names further columns that must be equal, such as the type of a finding. Findings of a line are merged before they are put
    in a group, so a line with a third of all findings costs one row, with its analysers and types.
    """
    keys = [*FILE, *by]
    impact = F.struct(agent_rank(F.col("impact")).alias("rank"), "impact")
    lines = findings.groupBy(F.struct(*keys).alias("_file"), "start_line").agg(
        _reach(), F.collect_set(agent_of(F.col("check_id"))).alias("_agents"), F.collect_set(ff.agent_type(F.col("check_id"))).alias("_types"),
        F.max(F.when(F.col("impact").isNotNull(), impact)).alias("_worst"), F.count(F.lit(1)).alias("_n"))
    merged = lambda sets: F.array_sort(F.array_distinct(F.flatten(F.collect_set(sets))))
    packed = lines.select("_file", "start_line", F.struct("_reach", "_worst", "_n", "_agents", "_types").alias("_line"))
    return _grouped(packed, block).groupBy("_file", "group_line").agg(
        F.max("_line._reach").alias("end_line"), merged("_line._agents").alias("agents"), merged("_line._types").alias("types"),
        F.max("_line._worst")["impact"].alias("impact"), F.sum("_line._n").alias("n")) \
        .select(*_unpacked(keys), F.col("group_line").alias("start_line"), "end_line", "agents", "types", "impact", "n",
                (F.size("agents") > 1).alias("corroborated"))
