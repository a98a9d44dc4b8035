"""What several corpus operators share: tables, keys, size-checked broadcasts, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.session import cut_lineage, ensure_checkpoint_dir

KEY_BITS = 60
BROADCAST_ROWS = 200_000   # narrow rows (at most some 100 bytes each): 20 MB at most


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key60(*columns: Column) -> Column:
    """The first 60 bits of an MD5 as a non-negative bigint; the same in every engine and every run."""
    text = F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def text_key(text: Column) -> Column:
    """A digest that stands for a text in narrow tables; a null text has that of the empty one."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    """Rows that nothing may be learned from: a fifth, by crc32 of the id as text. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def guarded(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but the needed ones renamed out of the way, and the columns that give them their names back."""
    inner = [n if n in needed else f"extra_{i}_" for i, n in enumerate(docs.columns)]
    return docs.toDF(*inner), [F.col(i).alias(n) for i, n in zip(inner, docs.columns)]


def checked_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a stored table of narrow rows if it has few enough of them; else leave the join to Spark."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """df, written as Parquet and read again: as lasting as a checkpoint, but compressed."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing will read any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows, stored, with `copy_`: 0, 1, .. within each key. Rows are counted by key and part, so no task holds a whole key."""
    rows = cut_lineage(rows.withColumn("part_", F.spark_partition_id()))
    before = Window.partitionBy("key_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(F.col(key).alias("key_"), F.col("part_").alias("at_")).agg(F.count("*").alias("rows_")) \
        .withColumn("start_", F.coalesce(F.sum("rows_").over(before), F.lit(0))).drop("rows_")
    here = F.row_number().over(Window.partitionBy(key, "part_").orderBy("part_")) - 1
    return rows.withColumn("here_", here) \
        .join(checked_broadcast(cut_lineage(starts)), (F.col(key) == F.col("key_")) & (F.col("part_") == F.col("at_"))) \
        .withColumn("copy_", F.col("start_") + F.col("here_")).drop("part_", "at_", "key_", "start_", "here_")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable by undirected edges, for every id that has an edge.

    Alternating large and small stars: each step links a node's neighbours to the smallest of them, so the number of
    steps grows with the logarithm of the component, and no component is gathered in one place.
    """
    links = cut_lineage(edges.where(F.col(a) != F.col(b))
                        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        large = _star(links, both=True)
        small = cut_lineage(_star(large, both=False))
        changed = small.join(links, ["u", "v"], "left_anti").limit(1).count() or \
            links.join(small, ["u", "v"], "left_anti").limit(1).count()
        links = small
        if not changed:
            break
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")) \
        .union(links.select("v", "v").distinct())


def _star(links: DataFrame, both: bool) -> DataFrame:
    """One star step on links u > v: large (all neighbours, those above the node move) or small (those below move)."""
    around = links.union(links.select("v", "u")) if both else links
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    joined = around.join(least.withColumn("m", F.least("m", "u")), "u")
    if both:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()
