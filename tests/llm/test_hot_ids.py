"""A third of the rows under one id, or without one: near duplicates and the mix stay right, and no pairs of such rows are made."""

import duckdb
from pyspark.sql import functions as F

from riskloom.llm import bottomk, mixing
from riskloom.llm.sql import MIX_SQL

SCHEMA = "doc_id long, text string, source string"


def _long_text(seed):
    return " ".join(f"w{(seed * 7919 + i * 31) % 100_003}" for i in range(1500))


def test_null_ids_give_one_set_per_class(spark, monkeypatch):
    near = _long_text(1).replace("w7919 ", "other ", 1)
    rows = [(None, _long_text(k % 3), "s") for k in range(60)] + [(5, _long_text(1), "s"), (6, near, "s"), (None, None, "s"), (7, near, "s"), (7, near, "s")]
    seen = []
    real = bottomk._sets

    def sets(docs, classes, repeated):
        out = real(docs, classes, repeated)
        seen.append((out.count(), out.select("class_id").distinct().count()))
        return out
    monkeypatch.setattr(bottomk, "_sets", sets)
    got = bottomk.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and seen and all(a == b for a, b in seen)
    placed = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert placed == {5: 5, 6: 5, 7: 5}


def _mixed(rows):
    """taken by the given SQL, over rows in the order of DuckDB."""
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    return sorted(con.execute(MIX_SQL).fetchall(), key=repr)


def test_the_mix_meets_its_targets_without_ids(spark):
    rows = [(None if k % 3 == 0 else k, " ".join(["w"] * (1 + k % 17) + [f"t{k}"]), f"s{k % 4}") for k in range(1200)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "size", "source_size", "target", "taken", "source").collect()
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 18 / 2 + 1e-6
    assert sorted(((r[0], r[1], r[2], r[3], r[4]) for r in got), key=repr) == _mixed(rows)


def test_the_mix_splits_equal_rows(spark):
    rows = [(None if k % 2 else 3, "one and the same text", "hot") for k in range(900)] + [(k, "w " * 5, "cold") for k in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs.repartition(5)).select("doc_id", "size", "source_size", "target", "taken", "source").collect()
    for s in ("hot", "cold"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2.5 + 1e-6
    assert sorted(((r[0], r[1], r[2], r[3], r[4]) for r in got), key=repr) == _mixed(rows)
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.agg(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0] == sum(r.taken for r in got)
