"""Trend numbers that add up: a row of counts and sketches per period, merged to longer periods or over runs without the findings.

A distinct count of a month isn't the sum of its days. Here a period keeps a HyperLogLog sketch of its values beside its count; sketches are
binary columns of bounded size that can be stored as they are, and any set of them merges to what one pass over all findings would
have given. So a new run adds rows to the stored table, and a trend over years reads a row per run and period.

The relative standard error of an estimate is 1.04 / sqrt(2^lg) (`standard_error`). Nulls and odd input: a null value isn't
counted among the distinct ones; a period without any value has an estimate of 0; a null period or key is a group of its own. Empty
tables give empty results. Stored sketches of another `lg` are merged at the smaller precision.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG = 12                     # 4096 registers: 2 to 4 kB a sketch, an error of 1.6 %
ROWS, SUFFIX = "n_rows", "_sketch"


def standard_error(lg: int = LG) -> float:
    """Of an estimate, relative to the true count, as a standard deviation."""
    return 1.04 / math.sqrt(1 << lg)


def sketched(rows: DataFrame, keys, values, lg: int = LG) -> DataFrame:
    """keys, n_rows and `<value>_sketch` for each value: the stored form of a period. Partial sketches are built before the shuffle."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(ROWS),
                                   *[F.hll_sketch_agg(F.col(v).cast("string"), F.lit(lg)).alias(v + SUFFIX) for v in values])


def merged(stored: DataFrame, keys) -> DataFrame:
    """Stored rows of any periods and runs added up to coarser keys; the result may be stored and merged again."""
    sketches = [c for c in stored.columns if c.endswith(SUFFIX)]
    return stored.groupBy(*keys).agg(F.sum(ROWS).alias(ROWS), *[F.hll_union_agg(c, F.lit(True)).alias(c) for c in sketches])


def estimates(stored: DataFrame) -> DataFrame:
    """The sketches read off: `n_<value>`, the estimated number of distinct values."""
    def read(name: str) -> Column:
        return F.coalesce(F.hll_sketch_estimate(name), F.lit(0)).alias("n_" + name.removesuffix(SUFFIX))

    return stored.select(*[read(c) if c.endswith(SUFFIX) else F.col(c) for c in stored.columns])
