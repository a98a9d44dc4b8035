"""Building blocks that stay parallel when one key holds a large share of all rows.

Joins on such keys need nothing here: plain equi-joins leave hot partitions to Spark's adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType


FEW = 100_000      # rows of a key that one window takes


def row_salt(df: DataFrame, salts: int) -> Column:
    """Salt of a row: the same on every attempt of a task, and full copies spread over the input tasks."""
    hashable = [F.col(f.name) for f in df.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    return F.pmod(F.xxhash64(*hashable) + F.spark_partition_id(), F.lit(salts)).cast("int")


_SAMPLED = 32       # sampled rows between two bounds


def number_rows(df: DataFrame, keys, order, name: str = "rn", depth: int = 2, few: int = FEW) -> DataFrame:
    """Exact `row_number` per key over `order`, without a window over the rows of a key that has more than about `few`.

    `order` is total and ascending (negate numbers to turn it around). Rows of such keys fall into ranges of the first columns of the
    order, two more than `depth` at most; rows that are equal in these are in one range. The bounds come from a sample by the rows'
    hash, so that they are the same each time they are made. Rows are dealt out once, by key and range, and numbered there, behind the
    counts of the ranges before theirs. `df` is read three times, for sample, counts and rows; the first two move next to nothing.
    Bounds and counts are broadcast: a row for every `few` / 2 rows or so of the keys with many.
    """
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    at = F.struct(*order[:depth + 2])
    key = F.struct(F.lit(0).alias("_all"), *keys)
    size = max(few // 2, 1)                                  # rows of a range, by the sample
    every = max(size // _SAMPLED, 1)
    sample = df.where(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).select(key.alias("_key"), at.alias("_at"))
    per = max(size // every, 1)
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_at"))
    bounds = (sample.withColumn("_nth", nth).where(F.col("_nth") % per == 0)
              .groupBy("_key").agg(F.sort_array(F.collect_set("_at")).alias("_bounds")))
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.size("_bounds"))).cast("int")), lambda i: F.pow(F.lit(2), i).cast("int"))
    bounds = bounds.select("_key", "_bounds", F.reverse(steps).alias("_steps"))
    placed = df.withColumn("_key", key).withColumn("_at", at).join(F.broadcast(bounds), "_key", "left")
    ahead = lambda i, step: (i + step <= F.size("_bounds")) & (F.get("_bounds", i + step - 1) <= F.col("_at"))
    found = F.aggregate("_steps", F.lit(0), lambda i, step: F.when(ahead(i, step), i + step).otherwise(i))    # bounds not above the row
    placed = placed.withColumn("_range", F.coalesce(found, F.lit(0)))
    before = Window.partitionBy("_key").orderBy("_range")
    starts = (placed.where(F.col("_bounds").isNotNull()).groupBy("_key", "_range").agg(F.count(F.lit(1)).alias("_n"))
              .select("_key", "_range", (F.sum("_n").over(before) - F.col("_n")).alias("_before")))
    dealt = placed.drop("_bounds", "_steps", "_at").withColumn("_slot", F.xxhash64("_key", "_range"))
    within = Window.partitionBy("_slot", "_key", "_range").orderBy(*order)
    return (dealt.withColumn("_in", F.row_number().over(within).cast("bigint"))
            .join(F.broadcast(starts), ["_key", "_range"], "left")
            .withColumn(name, F.col("_in") + F.coalesce("_before", F.lit(0))).select(*df.columns, name))


def chunked_lists(df: DataFrame, keys, order, value: Column, name: str, size: int = 1000) -> DataFrame:
    """Ordered lists of at most `size` values per key: `(keys, part, name)`, parts numbered from 1.

    No group is ever collected whole; a key with more values gives more parts.
    """
    return numbered_lists(number_rows(df, keys, order, "_rn"), keys, "_rn", value, name, size)


def numbered_lists(numbered: DataFrame, keys, number: str, value: Column, name: str, size: int = 1000) -> DataFrame:
    """`chunked_lists` of rows that are numbered from 1 in each key."""
    part = (F.floor((F.col(number) - 1) / size) + 1).cast("int")
    pairs = F.sort_array(F.collect_list(F.struct(F.col("_rn"), F.col("_value"))))
    return (numbered.select(*keys, part.alias("part"), F.col(number).alias("_rn"), value.alias("_value"))
            .groupBy(*keys, "part").agg(pairs.getField("_value").alias(name)))
