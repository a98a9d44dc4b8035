"""Sharding by extendible hashing, in DataFrame functions only.

A document's key is 60 bits of a hash over its id and text. All documents start in one bucket; a bucket above the byte limit
splits on the next bit, the others stay. Ten bits are read per round: one sum per cell of the open buckets, then the sums of
the cells' prefixes give the depth at which each cell stops. The directory has a row per cell, with the bucket it points to.
Rounds end when no bucket is open, so only parts that are still too large are looked at again.

A bucket that holds a single key can't split. If that is because a row repeats, its copies are numbered, get keys of their own
by their numbers, and the directory is built anew; so only a single text longer than the limit makes a shard above it, marked
`oversize`. (SHARD_SQL keeps repeats together; the two differ only where copies of one row exceed the limit.) Nulls: a null text has 0 bytes, a null id or text hashes as empty. An empty table gives an empty
result. Extra columns stay; those named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import KEY_BITS, checked_broadcast, guarded, key60, numbered
from riskloom.session import cut_lineage

ROUND_BITS = 10
OUT = ("n_bytes", "shard_id", "depth", "shard_bytes", "shard_docs", "oversize")


def with_keys(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")) \
        .withColumn("shard_key", key60(F.col("doc_id"), F.col("text")))


def directory(keyed: DataFrame, limit: int) -> list[DataFrame]:
    """For each round a stored table (cell, shard_id, depth, shard_bytes, shard_docs, oversize) of the cells that settled."""
    rounds, open_ = [], None
    for bits in range(ROUND_BITS, KEY_BITS + 1, ROUND_BITS):
        above = bits - ROUND_BITS
        here = keyed
        if open_ is not None:
            here = keyed.join(checked_broadcast(open_), F.shiftright("shard_key", KEY_BITS - above) == F.col("open_cell"), "left_semi")
        cells = cut_lineage(here.groupBy(F.shiftright("shard_key", KEY_BITS - bits).alias("cell")).agg(
            F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"),
            F.min("shard_key").alias("low"), F.max("shard_key").alias("high")))
        first = above + (1 if above else 0)
        prefixes = cells.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(bits)))) \
            .withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
        buckets = prefixes.groupBy("depth", "prefix").agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), F.min("low").alias("low"), F.max("high").alias("high"))
        buckets = buckets.where((F.col("shard_bytes") <= limit) | (F.col("low") == F.col("high")) | (F.col("depth") == KEY_BITS))
        settled = prefixes.select("cell", "depth", "prefix").join(buckets, ["depth", "prefix"]).groupBy("cell").agg(
            F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("b"))
        bits_of = F.when(F.col("b.depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(b.prefix), b.depth, '0')"))
        settled = cut_lineage(settled.select("cell", bits_of.alias("shard_id"), "b.depth", "b.shard_bytes", "b.shard_docs")
                              .withColumn("oversize", F.col("shard_bytes") > limit))
        rounds.append(settled)
        open_ = cut_lineage(cells.join(settled, "cell", "left_anti").select(F.col("cell").alias("open_cell")))
        if not open_.limit(1).count():
            break
    return rounds


def _split_copies(keyed: DataFrame, narrow: DataFrame, limit: int) -> DataFrame:
    """keyed with a key for each copy of the rows whose copies together exceed the limit."""
    hot = cut_lineage(narrow.groupBy(F.col("shard_key").alias("hot_key")).agg(F.count("*").alias("rows"), F.sum("n_bytes").alias("bytes"))
                      .where((F.col("rows") > 1) & (F.col("bytes") > limit)).select("hot_key"))
    is_hot = F.col("shard_key") == F.col("hot_key")
    copies = numbered(keyed.join(checked_broadcast(hot), is_hot, "left_semi"), "shard_key")
    own = copies.withColumn("shard_key", key60(F.col("shard_key"), F.col("copy_"))).drop("copy_")
    return keyed.join(checked_broadcast(hot), is_hot, "left_anti").unionByName(own)


def shard(docs: DataFrame, limit: int) -> DataFrame:
    """docs with n_bytes, shard_id (the bits of its bucket), depth, shard_bytes, shard_docs, oversize."""
    docs, back = guarded(docs.drop(*OUT), "doc_id", "text")
    keyed = with_keys(docs)
    narrow = cut_lineage(keyed.select("shard_key", "n_bytes"))
    rounds = directory(narrow, limit)
    if any(r.where("oversize and shard_docs > 1").limit(1).count() for r in rounds):
        keyed = _split_copies(keyed, narrow, limit)
        rounds = directory(cut_lineage(keyed.select("shard_key", "n_bytes")), limit)
    out = keyed
    for r, settled in enumerate(rounds):
        cell = F.shiftright("shard_key", KEY_BITS - ROUND_BITS * (r + 1))
        named = settled.select(F.col("cell").alias(f"cell_{r}_"), F.struct(*OUT[1:]).alias(f"shard_{r}_"))
        out = out.join(checked_broadcast(named), cell == F.col(f"cell_{r}_"), "left")
    found = F.coalesce(*[F.col(f"shard_{r}_") for r in range(len(rounds))])
    return out.withColumn("shard_", found).select(*back, "n_bytes", "shard_.*")


def write_shards(docs: DataFrame, limit: int, path: str) -> None:
    """Write each shard to a folder of its own."""
    shard(docs, limit).repartition("shard_id").write.mode("overwrite").partitionBy("shard_id").parquet(path)
