"""Line dedup by prefix doubling over line-ID sequences, in DataFrame functions only.

A document is the sequence of its lines that aren't blank, a line is named by a hash. Doubling gives every position the names of
the 1, 2, 4, ... lines from it; positions with the same name share that prefix, so they are an interval of the suffix array
whose longest common prefix is at least that long. Only intervals of two or more positions go on to the next doubling, so the
table shrinks to what is repeated. Names stand for ranks: the order of intervals decides nothing, and naming needs no sort
of a whole interval in one task.

The longest run from a position that also begins earlier in the corpus (by doc_id, then line) lies between two powers of two; it
is refined bit by bit, a run being named by the two overlapping powers that cover it. A run of at least `min_lines` lines or
`min_words` words is a copy: its lines, and the blank ones between them, are deleted from all but the first place.

Nulls and odd input: a null text stays null, an empty one has no lines. A null doc_id comes last in the order. Rows that repeat
doc_id and text are one document: none is a copy of the other. A document may repeat its own lines; the first place stays. An
empty table gives an empty result. Extra columns stay; those named like the results are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import guarded, key60
from riskloom.session import cut_lineage, setting

MIN_LINES = 3
MIN_WORDS = 50
WORDS = r"[^\x20\x09-\x0D]+"
LAST = (1 << 63) - 1
RESULT = ("n_lines", "n_removed", "longest_run")
PLACE = ["doc", "text_key", "pos"]


def _identity(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("text_key", key60(F.col("text")))


def _place() -> Column:
    return F.struct(*PLACE)


def lines(docs: DataFrame) -> DataFrame:
    """doc, text_key, pos (among lines that aren't blank), line_no, words, and two hashes of the line."""
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("line_no"), F.trim(line).alias("line")))
    kept = F.filter(numbered, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))
    return _identity(docs.select("doc_id", "text")).select("doc", "text_key", F.posexplode(kept).alias("pos", "x")) \
        .select(*PLACE, F.col("x.line_no").alias("line_no"), F.regexp_count("x.line", F.lit(WORDS)).alias("words"),
                F.xxhash64("x.line").alias("a"), F.hash("x.line").alias("b"))


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys stand in two rows or more, with `later`: not the first of them."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.min(_place()).alias("first")).where(F.col("rows") > 1)
    return rows.join(groups.drop("rows").hint("merge"), keys).withColumn("later", F.col("first") < _place()).drop("first")


def intervals(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The repeated lines, and for each power of two the positions (with name and later) whose run of that length is repeated."""
    repeated = _repeated(lines(docs), ["a", "b"]).dropDuplicates(PLACE).withColumn("name", F.xxhash64("a", "b"))
    repeated = cut_lineage(repeated.select(*PLACE, "line_no", "words", "name", "later"))
    levels, length = [repeated.select(*PLACE, "name", "later")], 1
    while True:
        behind = Window.partitionBy("doc", "text_key").orderBy("pos").rangeBetween(length, length)
        pairs = levels[-1].select(*PLACE, "name", F.first("name").over(behind).alias("next")).where("next is not null")
        longer = cut_lineage(_repeated(pairs, ["name", "next"]).select(
            *PLACE, F.xxhash64("name", "next", F.lit(length)).alias("name"), "later"))
        if not longer.limit(1).count():
            return repeated, levels
        levels.append(longer)
        length *= 2


def longest_runs(levels: list[DataFrame]) -> DataFrame:
    """doc, text_key, pos, length: the longest run from each position that begins at an earlier place too."""
    named = cut_lineage(reduce(DataFrame.union, [t.withColumn("level", F.lit(k)) for k, t in enumerate(levels)]))
    runs = cut_lineage(named.where("later").groupBy(*PLACE).agg(F.max(F.struct("level", "name")).alias("top"))
                       .select(*PLACE, "top.level", "top.name", F.expr("shiftleft(1, top.level)").alias("length")))
    tail = named.select("doc", "text_key", F.col("pos").alias("tail_pos"), "level", F.col("name").alias("tail"))
    for bit in range(len(levels) - 2, -1, -1):
        offset = F.expr("length - shiftleft(1, level)")
        longer = runs.where(F.col("level") > bit).withColumn("length", F.col("length") + (1 << bit))
        wanted = longer.withColumn("tail_pos", F.col("pos") + offset).join(tail.hint("merge"), ["doc", "text_key", "tail_pos", "level"]).drop("tail_pos")
        places = longer.select("level", "name", "length").distinct().join(named.drop("later").hint("merge"), ["level", "name"]) \
            .withColumn("tail_pos", F.col("pos") + offset).join(tail.hint("merge"), ["doc", "text_key", "tail_pos", "level"])
        firsts = places.groupBy("level", "name", "length", "tail").agg(F.min(_place()).alias("first"))
        grown = wanted.join(firsts.hint("merge"), ["level", "name", "length", "tail"]).where(F.col("first") < _place()) \
            .select(*PLACE, F.col("length").alias("grown"))
        runs = cut_lineage(runs.join(grown.hint("merge"), PLACE, "left").withColumn("length", F.coalesce("grown", "length")).drop("grown"))
    return runs.select(*PLACE, "length")


def copies(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, text_key, pos, length, words, first_line, last_line: the runs to delete."""
    # Sizes are guessed too large over so many joins, so each would get a runtime filter: its smaller side is computed once more, and the
    # filters are gathered in the driver, which they filled.
    with setting(docs.sparkSession, "spark.sql.optimizer.runtime.bloomFilter.enabled", "false"):
        repeated, levels = intervals(docs)
        runs = longest_runs(levels)
    so_far = F.sum("words").over(Window.partitionBy("doc", "text_key").orderBy("pos"))
    at = cut_lineage(repeated.select(*PLACE, "line_no", "words", so_far.alias("so_far")))
    start = at.select(*PLACE, F.col("line_no").alias("first_line"), (F.col("so_far") - F.col("words")).alias("before"))
    end = at.select("doc", "text_key", F.col("pos").alias("end"), F.col("line_no").alias("last_line"), F.col("so_far").alias("upto"))
    return runs.join(start, PLACE).withColumn("end", F.expr("pos + length - 1")).join(end, ["doc", "text_key", "end"]) \
        .withColumn("words", F.col("upto") - F.col("before")) \
        .where((F.col("length") >= min_lines) | (F.col("words") >= min_words)) \
        .select(*PLACE, "length", "words", "first_line", "last_line")


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the copies deleted from text, and n_lines, n_removed (lines before, lines deleted), longest_run (its longest copy)."""
    docs, back = guarded(docs.drop(*RESULT), "doc_id", "text")
    found = copies(docs, min_lines, min_words)
    # Overlapping runs of a document become one gap: a run opens one if it begins behind all that came before it.
    earlier = Window.partitionBy("doc", "text_key").orderBy("first_line", "last_line").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc", "text_key").orderBy("first_line", "last_line").rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("first_line") > F.coalesce(F.max("last_line").over(earlier), F.lit(-1))).cast("int")
    gaps = found.withColumn("opens", opens).withColumn("gap", F.sum("opens").over(upto)) \
        .groupBy("doc", "text_key", "gap").agg(F.min("first_line").alias("a"), (F.max("last_line") + 1).alias("b"), F.max("length").alias("length")) \
        .groupBy(F.col("doc").alias("gap_doc"), F.col("text_key").alias("gap_key")).agg(
            F.sort_array(F.collect_list(F.struct("a", "b"))).alias("gaps"), F.max("length").alias("longest_run"))
    joined = _identity(docs).join(gaps, (F.col("doc") == F.col("gap_doc")) & (F.col("text_key") == F.col("gap_key")), "left") \
        .withColumn("lines_", F.when(F.col("text") != "", F.split("text", "\n"))) \
        .withColumn("n_lines", F.when(F.col("text") != "", F.size("lines_")).otherwise(0)) \
        .withColumn("n_removed", F.coalesce(F.aggregate("gaps", F.lit(0), lambda n, g: n + g["b"] - g["a"]), F.lit(0))) \
        .withColumn("longest_run", F.coalesce("longest_run", F.lit(0)))
    kept = F.expr("""array_join(flatten(transform(sequence(0, size(gaps)), i -> slice(lines_,
        (case when i = 0 then 0 else gaps[i - 1].b end) + 1,
        (case when i = size(gaps) then n_lines else gaps[i].a end) - (case when i = 0 then 0 else gaps[i - 1].b end)))), '\n')""")
    return joined.withColumn("text", F.when(F.col("gaps").isNull(), F.col("text")).otherwise(kept)) \
        .select(*back, *RESULT)
