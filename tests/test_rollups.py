"""Sketches per period: merged ones equal one pass, estimates within the stated error, odd input."""

from pyspark.sql import functions as F

from riskloom.operators import rollups


def days(spark, n=20_000):
    return spark.range(n).selectExpr("cast(id % 28 as int) as day", "concat('rule-', id % 7919) as check_id", "concat('f', id % 97) as path")


def test_merged_sketches_equal_one_pass(spark):
    stored = rollups.sketched(days(spark), ["day"], ["check_id", "path"])
    weeks = rollups.merged(stored.withColumn("week", F.floor(F.col("day") / 7)), ["week"])
    month = rollups.estimates(rollups.merged(weeks, [])).first()
    whole = rollups.estimates(rollups.sketched(days(spark), [], ["check_id", "path"])).first()
    assert month.n_rows == whole.n_rows == 20_000
    assert (month.n_check_id, month.n_path) == (whole.n_check_id, whole.n_path)
    assert abs(month.n_check_id - 7919) <= 4 * rollups.standard_error() * 7919 and abs(month.n_path - 97) <= 2


def test_runs_add_rows_to_a_stored_table(spark, tmp_path):
    path = str(tmp_path / "trend")
    for run in range(3):       # a day that several runs report
        rows = spark.range(300).selectExpr("1 as day", f"concat('rule-', id + {100 * run}) as check_id")
        rollups.sketched(rows, ["day"], ["check_id"]).write.mode("append").parquet(path)
    row = rollups.estimates(rollups.merged(spark.read.parquet(path), ["day"])).first()
    assert row.n_rows == 900 and abs(row.n_check_id - 500) <= 4 * rollups.standard_error() * 500


def test_precisions_meet_and_odd_input(spark):
    rows = days(spark, 3000)
    both = rollups.sketched(rows, ["day"], ["check_id"], lg=8).union(rollups.sketched(rows, ["day"], ["check_id"], lg=12))
    row = rollups.estimates(rollups.merged(both, [])).first()
    assert row.n_rows == 6000 and abs(row.n_check_id - 3000) <= 4 * rollups.standard_error(8) * 3000
    nulls = spark.createDataFrame([(None, None), (None, None), (1, "a")], "day int, check_id string")
    got = {r.day: (r.n_rows, r.n_check_id) for r in rollups.estimates(rollups.sketched(nulls, ["day"], ["check_id"])).collect()}
    assert got == {None: (2, 0), 1: (1, 1)}
    assert rollups.estimates(rollups.merged(rollups.sketched(nulls.limit(0), ["day"], ["check_id"]), ["day"])).collect() == []
