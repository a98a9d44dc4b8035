"""Embedding near-dedup by counting collisions of one-dimensional projections.

1. Rows with the same label and the same components are one class with a multiplicity; vectors of different lengths or labels
   are never compared. A vector is scaled to length 1 and projected on PROJECTIONS Gaussian directions. Two vectors at the
   threshold lie `reach` apart, so each projection's difference is normal with that deviation.
2. For each of TABLES sets of leading projections, vectors meet in cells: a vector stands in its own cell and in the one below
   on every side that its window reaches over. The number of leads grows with the logarithm of the label's size, so a cell's
   mean size is bounded. A cell above BLOCK vectors is split into blocks, and every pair of blocks is one group: complete, and
   bounded for each task.
3. In a group vectors are sorted by the first lead. Around each query, all vectors in its window are its candidates; a candidate
   collides in a projection if the difference is within `NARROW` deviations. Pairs with at least the count that a pair at the
   threshold reaches with probability 1 - MISS are verified by their cosine in double precision.
4. Every found pair belongs to one cell of one table, so a group reports, for each class, the number of vectors linked to it and
   one link to the smallest class of its local component: output is linear also where all vectors of a cell are alike.

Nulls and odd input: a null label, and a null, empty, zero vector or one with null or non-finite components, link with nothing.
A null vec_id takes part, but is never the smallest id; its `kept` is null. Repeated rows are vectors of their own and link with
each other. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import checked_broadcast, components
from riskloom.llm.words import mix
from riskloom.session import cut_lineage, ship_package

COSINE = 0.98
PROJECTIONS = 32
TABLES = 2
MAX_LEADS = 8
WIDE = 3.0            # window of a lead, in deviations of a pair at the threshold
NARROW = 1.5          # window of a counted projection
MISS = 1e-5
CELL = 2048           # mean size of a cell that the number of leads aims at
BLOCK = 4096
SLICE = 1 << 18       # candidate pairs counted at once


def required_count(n: int = PROJECTIONS, miss: float = MISS) -> int:
    """The largest count of collisions that a pair at the threshold reaches with probability 1 - miss."""
    p = math.erf(NARROW / math.sqrt(2))
    below, count = 0.0, 0
    while True:
        below += math.comb(n, count) * p ** count * (1 - p) ** (n - count)
        if below > miss:
            return count
        count += 1


def directions(dims: int) -> np.ndarray:
    return np.random.RandomState(1_000_003 + dims).randn(dims, PROJECTIONS + TABLES * MAX_LEADS)


def _units(column: pa.ListArray, dims: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(1, keepdims=True)          # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ok = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)) \
        & F.exists("embedding", lambda v: v != 0)
    return vectors.withColumn("class_id", F.when(F.coalesce(ok, F.lit(False)), F.xxhash64("label", "embedding")))


def cells(classes: DataFrame, reach: float) -> DataFrame:
    """One row per class, table and cell: where it may meet others. Homes tell which of several cells a pair belongs to."""
    wide, width = WIDE * reach, 2 * WIDE * reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, leads = np.array(batch.column("dims")), np.array(batch.column("leads"))
            labels = np.array(batch.column("label_key"))
            for d, g in sorted(set(zip(dims.tolist(), leads.tolist()))):
                own = np.flatnonzero((dims == d) & (leads == g))
                part = batch.take(pa.array(own))
                shown = _units(part.column("embedding"), d) @ directions(d)
                for t in range(TABLES):
                    lead = shown[:, PROJECTIONS + t * MAX_LEADS:][:, :g]
                    home = np.floor(lead / width).astype(np.int64)
                    reaches = lead - home * width < wide
                    for corner in range(1 << g):
                        down = (corner >> np.arange(g)) & 1
                        here = np.flatnonzero((reaches | (down == 0)).all(1))
                        if not len(here):
                            continue
                        at = home[here] - down
                        key = mix(labels[own[here]].astype(np.uint64) + np.uint64(d * 8 + t))
                        for k in range(g):
                            key = mix(key * np.uint64(31) + at[:, k].astype(np.uint64) + np.uint64(k + 1))
                        rows = part.take(pa.array(here))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key.astype(np.int64)), pa.array(np.full(len(here), t, np.int32)),
                             pa.array([list(x) for x in at.tolist()], pa.list_(pa.int64())),
                             *[rows.column(c) for c in ("class_id", "size", "label", "leads", "embedding")]],
                            names=["cell", "part", "corner", "class_id", "size", "label", "leads", "embedding"])

    kind, label = classes.schema["embedding"].dataType.simpleString(), classes.schema["label"].dataType.simpleString()
    return classes.mapInArrow(run, f"cell long, part int, corner array<long>, class_id long, size long, label {label}, "
                                   f"leads int, embedding {kind}")


def _meet(table: pa.Table, reach: float, count: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked rows of one group, each pair once over all groups."""
    column = table.column("embedding").combine_chunks()
    dims = len(column[0])
    raw, x = _raw(column, dims), _units(column, dims)
    shown = x @ directions(dims)
    t, g = table.column("part")[0].as_py(), table.column("leads")[0].as_py()
    corner = np.array(table.column("corner")[0].as_py(), np.int64)
    wide, width = WIDE * reach, 2 * WIDE * reach
    leads = shown[:, PROJECTIONS:].reshape(len(x), TABLES, MAX_LEADS)
    home = np.floor(leads[:, t, :g] / width).astype(np.int64)
    side = np.array(table.column("block"))
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    order = np.argsort(leads[:, t, 0], kind="stable")
    value = leads[order, t, 0]
    until = np.searchsorted(value, value + wide, side="right")
    found = until - np.arange(len(x)) - 1
    ends = np.cumsum(found)
    first = 0
    while first < len(x):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + SLICE, side="right")))
        here = found[first:last]
        i = np.repeat(np.arange(first, last), here)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(here) - here, here)
        i, j = order[i], order[j]
        first = last
        if low != high:
            keep = side[i] != side[j]
            i, j = i[keep], j[keep]
        hits = np.zeros(len(i), np.int16)
        for k in range(PROJECTIONS):
            hits += np.abs(shown[i, k] - shown[j, k]) <= NARROW * reach
            if k % 8 == 7:       # those that can't reach the count any more
                keep = hits >= count - (PROJECTIONS - 1 - k)
                i, j, hits = i[keep], j[keep], hits[keep]
        keep = (np.abs(leads[i, t, :g] - leads[j, t, :g]) <= wide).all(1) & (np.minimum(home[i], home[j]) == corner).all(1)
        for earlier in range(t):
            keep &= ~(np.abs(leads[i, earlier, :g] - leads[j, earlier, :g]) <= wide).all(1)
        i, j = i[keep], j[keep]
        near = _cosines(raw, i, j) >= cosine
        yield i[near], j[near]


def _raw(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _cosines(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    peak = np.abs(x).max(1, keepdims=True)
    y = x if len(x) and peak.max() < 1e100 and peak.min() > 1e-100 else x / peak
    length = np.sqrt(np.einsum("nd,nd->n", y, y))
    return np.einsum("nd,nd->n", y[i], y[j]) / (length[i] * length[j])


def _forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches by the pairs."""
    i = np.concatenate([p[0] for p in pairs])
    j = np.concatenate([p[1] for p in pairs])
    label = ids.copy()
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        if (before == label).all():
            return label


def links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """class_id, root, linked: of each group, the vectors linked to a class, and the smallest class it is joined with."""
    reach = math.sqrt(2 - 2 * cosine)
    count = required_count()
    sizes = cut_lineage(classes.groupBy("label", "dims").agg(F.count("*").alias("group_size")))
    leads = F.least(F.greatest(F.ceil(F.log(F.col("group_size") / CELL) / math.log(3)), F.lit(1)), F.lit(MAX_LEADS)).cast("int")
    sizes = sizes.withColumn("leads", leads).withColumn("label_key", F.xxhash64("label")).drop("group_size")
    placed = cut_lineage(cells(classes.join(checked_broadcast(sizes), ["label", "dims"]), reach))
    large = placed.groupBy("cell").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK) \
        .select("cell", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    spread = placed.join(checked_broadcast(cut_lineage(large)), "cell", "left").withColumn("blocks", blocks) \
        .withColumn("block", F.pmod(F.col("class_id"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def run(table: pa.Table) -> pa.Table:
        ids, size = np.array(table.column("class_id")), np.array(table.column("size"))
        linked, pairs = np.zeros(len(ids), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i, j in _meet(table, reach, count, cosine):
            np.add.at(linked, i, size[j])
            np.add.at(linked, j, size[i])
            pairs.append((i, j))
        root = _forest(len(ids), pairs, ids)
        keep = np.flatnonzero(linked)
        return pa.table({"class_id": pa.array(ids[keep], pa.int64()), "root": pa.array(root[keep], pa.int64()),
                         "linked": pa.array(linked[keep], pa.int64())})

    return spread.groupBy("label", "cell", "low", "high").applyInArrow(run, "class_id long, root long, linked long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    ship_package(vectors.sparkSession)
    rows = usable(vectors.select(F.col("vec_id").cast("long"), "embedding", "label"))
    classes = cut_lineage(rows.where("class_id is not null").groupBy("class_id", "label", "embedding").agg(F.count("*").alias("size"))
                          .withColumn("dims", F.size("embedding")))
    found = cut_lineage(links(classes, cosine))
    linked = found.groupBy("class_id").agg(F.sum("linked").alias("linked"))
    labels = cut_lineage(components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b"))))
    known = classes.select("class_id", "size").join(linked, "class_id", "left") \
        .join(labels.withColumnRenamed("id", "class_id"), "class_id", "left") \
        .select("class_id", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
                F.coalesce("component", "class_id").alias("component"))
    placed = rows.select("vec_id", "class_id").join(known, "class_id", "left")
    smallest = placed.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("smallest"))
    return placed.join(smallest, "component", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("smallest", "vec_id").alias("component_id")) \
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
