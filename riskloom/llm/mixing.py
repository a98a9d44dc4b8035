"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

A source's target is its weight's share of the budget, at most `most` times its own size; what is above that is shared
again by weight. A source is taken whole as often as the target holds it; of the rest, the documents whose hash is below a
threshold are taken once more. The threshold comes from a histogram of sizes by source and hash bucket: running sums find
the bucket that the budget ends in, and only that bucket is split by the next bits, until it holds one key. So thresholds
of a smaller and a larger budget are nested, nothing is sorted, and a rerun takes the same documents.

Nulls: a null or empty text has size 0 and is taken 0 times over; a null source is a source of its own, the last one. The hash is
of doc_id (null: the empty text) and text, so rows that share an id, or have none, are taken by their texts. Rows that repeat both
share a hash; if a source's budget ends among them, they are numbered and as many of them are taken as come nearest to it. An
empty table gives an empty result. Extra columns stay; `mix` replaces those named like its results, `mixed_documents` changes none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import KEY_BITS, checked_broadcast, guarded, key60, numbered
from riskloom.session import cut_lineage

WORDS = r"[^\x20\x09-\x0D]+"
LEVEL_BITS = 12
RESULT = ("size", "source_size", "target", "taken")


def with_sizes(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("bigint")) \
        .withColumn("mix_key", key60(F.col("doc_id"), F.col("text")))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per source: its size, weight and target.

    Sources in order of cap / weight: the capped ones come first, and the level (budget per weight) that the others share is
    the first one at or below the next source's cap.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("bigint")) \
        .withColumn("cap", F.col("source_size") * most).withColumn("fill", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy(F.lit(1))
    before = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - capped) / left)
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", F.col("source").isNull(), "source", "level"))).over(everything)
    target = F.least(F.col("cap").cast("double"), F.coalesce(level["level"] * F.col("weight"), F.col("cap").cast("double")))
    return per.withColumn("target", target).select("source", "source_size", "weight", "target")


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: the whole times it is taken, the key that the rest of its budget ends in, and what of it is left for that key."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    state = cut_lineage(targets.withColumn("whole", whole).select(
        "source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"),
        F.lit(0).cast("bigint").alias("prefix"), F.lit(False).alias("single")))
    for shift in range(KEY_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        open_ = checked_broadcast(state.where(~F.col("single") & (F.col("source_size") > 0))
                                  .select(F.col("source").alias("s"), "prefix"))
        here = sized.where(F.col("size") > 0).join(
            open_, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("mix_key", shift + LEVEL_BITS) == F.col("prefix")))
        buckets = here.groupBy("s", F.shiftright("mix_key", shift).alias("bucket")).agg(
            F.sum("size").alias("bucket_size"), (F.min("mix_key") == F.max("mix_key")).alias("one"), F.min("mix_key").alias("key"))
        upto = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rest = state.select(F.col("source").alias("source_"), "rest")
        edge = buckets.withColumn("upto", F.sum("bucket_size").over(upto)) \
            .join(checked_broadcast(rest), F.col("s").eqNullSafe(F.col("source_"))).where(F.col("upto") > F.col("rest")) \
            .groupBy("s").agg(F.min(F.struct("bucket", "upto", "bucket_size", "one", "key")).alias("e"))
        found = F.col("e").isNotNull()
        state = cut_lineage(state.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "whole",
            F.when(found, F.col("rest") - (F.col("e.upto") - F.col("e.bucket_size"))).otherwise(F.col("rest")).alias("rest"),
            F.when(found, F.when(F.col("e.one"), F.col("e.key")).otherwise(F.col("e.bucket"))).otherwise(F.col("prefix")).alias("prefix"),
            F.when(found, F.col("e.one")).otherwise(F.col("single")).alias("single")))
        if not state.where(~F.col("single") & (F.col("source_size") > 0)).limit(1).count():
            break
    return state.select("source", "source_size", "target", "whole", F.col("prefix").alias("edge"), "rest")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """docs with size, source_size, target and taken (words that the mix takes, repeats counted)."""
    docs, back = guarded(docs.drop(*RESULT), "doc_id", "source", "text")
    return _mixed(docs, weights, share, most).select(*back, *RESULT)


def _mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    narrow = cut_lineage(with_sizes(docs.select("doc_id", "source", "text")).select("source", "size", "mix_key"))
    limits = thresholds(narrow, source_targets(narrow, weights, share, most)).withColumnRenamed("source", "limit_source")
    limits = checked_broadcast(cut_lineage(limits))
    of_source, on_edge = F.col("source").eqNullSafe(F.col("limit_source")), F.col("mix_key") == F.col("edge")
    joined = with_sizes(docs).join(limits, of_source)
    repeated = narrow.where("size > 0").join(limits, of_source & on_edge).groupBy("source").agg(F.count("*").alias("rows")).where("rows > 1")
    if repeated.limit(1).count():
        at_edge = F.coalesce(on_edge & (F.col("size") > 0), F.lit(False))
        edge_key = key60(F.col("source").isNull(), F.col("source"), F.col("mix_key"))
        joined = joined.where(~at_edge).withColumn("copy_", F.lit(0).cast("bigint")).unionByName(
            numbered(joined.where(at_edge).withColumn("edge_key", edge_key), "edge_key").drop("edge_key"))
    else:
        joined = joined.withColumn("copy_", F.lit(0).cast("bigint"))
    more = (F.col("mix_key") < F.col("edge")) | (on_edge & ((2 * F.col("copy_") + 1) * F.col("size") < 2 * F.col("rest")))
    times = F.col("whole") + F.when(more & (F.col("source_size") > 0), 1).otherwise(0)
    return joined.withColumn("taken", F.col("size") * times)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs."""
    docs, back = guarded(docs, "doc_id", "source", "text")
    out = _mixed(docs, **options).where(F.col("taken") > 0)
    times = (F.col("taken") / F.col("size")).cast("int")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select(*back)
