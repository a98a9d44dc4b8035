"""Result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_tables(tables: dict[str, DataFrame], out: str, partition_by: dict[str, list[str]] | None = None,
                 fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per table. Only the named columns make partitions; all should have few values."""
    for name, df in tables.items():
        writer = df.write.mode(mode).format(fmt)
        by = (partition_by or {}).get(name)
        (writer.partitionBy(*by) if by else writer).save(f"{out.rstrip('/')}/{name}")


def read_table(spark, out: str, name: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(f"{out.rstrip('/')}/{name}")
