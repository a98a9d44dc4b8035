"""MinHash near-dedup by bottom-k sketches from one hash function.

1. A text's set is its distinct 5-word shingles, as hashes; the sketch is the SKETCH smallest. Texts with the same set form one
   class, so exact copies and texts that differ in nothing but repeats cost one row from here on.
2. Inverted lists over the LISTED smallest values of a sketch generate overlaps. Two sets at the threshold share at least
   least_shared(percent) of those values (but for one pair in 10^8), so it is enough to list each class under its first
   LISTED - least_shared + 1 values in any common order. The order puts values with more than COLD classes last: such a list is reached only by classes that
   consist of common values. Short lists give all their pairs (at most COLD / 2 per row); long lists give none.
3. Classes that reach a long list (members of large near groups, for the most part) are listed once more by their whole sets, the
   rarest value first. There the bounds have no sampling slack: with sizes a and b and the threshold t a pair must share
   c = ceil(t / (1 + t) * (a + b)) values, so one of the first a - c + 1 of the one and the first b - c + 1 of the other. What sets a near copy apart is
   rare and comes first, so few classes still reach a long list. In these each member is compared with the list's most
   central one; then only lists whose members are not all linked are looked at again, and there only members outside the list's
   largest component with the others. All pairs within these bounds are compared or known to be connected.
4. The union sketch of a pair estimates its similarity; pairs that can't reach the threshold go. Sets of at most SKETCH
   shingles are whole in their sketch and decided there; larger ones are compared in full.
5. Linked classes form components by alternating stars; a component's id is its smallest doc_id.

Nulls and odd input: a null, empty or wordless text has the empty set and is linked with nothing, not even its like. A row with
a null doc_id takes part, but is never the smallest id; its `kept` is null. Rows that repeat a doc_id are compared by their own
texts. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import components, guarded, text_key
from riskloom.llm.words import mix, shingle_sets, text_chunks
from riskloom.session import cut_lineage, ship_package

WORDS = 5
PERCENT = 85     # the default threshold: a Jaccard similarity in hundredths, which every bound below follows
SKETCH = 64
LISTED = 24
COLD = 24
MISSED = 1e-8    # of pairs at the threshold, the share that the lists may not bring together
ERRORS = 5.6     # the estimate may fall so many standard errors of SKETCH values short


def least_shared(percent: int) -> int:
    """So many of the LISTED smallest values two sets at the threshold share, but for MISSED of the pairs."""
    t, missed = percent / 100, 0.0
    for k in range(LISTED):
        missed += math.comb(LISTED, k) * t ** k * (1 - t) ** (LISTED - k)
        if missed > MISSED:
            return max(1, k)
    return LISTED


def least_estimate(percent: int) -> float:
    t = percent / 100
    return t - ERRORS * math.sqrt(t * (1 - t) / SKETCH)


def set_key(s: np.ndarray) -> int:
    """One number (63 bits) for a set: two sums over its mixed hashes, and its size."""
    u = s.astype(np.uint64)
    sums = np.array([mix(u).sum(dtype=np.uint64), mix(u ^ np.uint64(0x5DEECE66D1CE4E5B)).sum(dtype=np.uint64)], np.uint64)
    parts = mix(sums + np.array([len(s), 1], np.uint64))
    return int(mix(parts[:1] * np.uint64(3) ^ parts[1:])[0] >> np.uint64(1))


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches and their texts, about a megabyte each, so that no more sets are held at once."""
    for batch in batches:
        at = 0
        for texts in text_chunks(batch.column("text")):
            yield batch.slice(at, len(texts)), texts
            at += len(texts)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, class_id (of equal sets; null for the empty set), sketch."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _portions(batches):
            n, keys, values = [], [], []
            for s in shingle_sets(texts, WORDS):
                n.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                values.append(s[:SKETCH].copy())
            lengths = np.concatenate([[0], np.cumsum([len(v) for v in values])])
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(keys, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "class_id", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("text_key"), "text") \
        .mapInArrow(run, "doc_id long, text_key string, n_shingles long, class_id long, sketch array<long>")


def postings(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """value, class_id, n, hot: the lists that a class must stand in by its sketch.

    A class whose largest partner has at most LISTED shingles has whole lists on both sides of every link, so its own bound holds.
    """
    listed = classes.select("class_id", "n", F.explode(F.slice("sketch", 1, LISTED)).alias("value"))
    needed = F.when(100 * F.col("n") > percent * LISTED, LISTED - least_shared(percent) + 1) \
        .otherwise(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    return _ranked(listed, F.least(F.col("n"), F.lit(LISTED)), F.when(F.col("rows") > COLD, 1).otherwise(0), needed)


def exact_postings(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """As postings, by whole sets (class_id, n, shingles): rarest value first, as many as the smallest partner may ask for."""
    needed = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return _ranked(sets.select("class_id", "n", F.explode("shingles").alias("value")), F.col("n"), F.col("rows"), needed)


def _ranked(listed: DataFrame, length: Column, order: Column, needed: Column) -> DataFrame:
    """value, class_id, n, rank, hot. Values of one class only come first and lead nowhere; they count for the rank."""
    lists = listed.groupBy("value").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    own = Window.partitionBy("class_id")
    alone = length - F.count("*").over(own)
    return listed.join(lists, "value").withColumn("order", order) \
        .withColumn("rank", alone + F.row_number().over(own.orderBy("order", "value"))) \
        .where(F.col("rank") <= needed).select("value", "class_id", "n", "rank", (F.col("rows") > COLD).alias("hot"))


def _pairs(left: DataFrame, right: DataFrame, exact: bool, percent: int, *conditions: Column) -> DataFrame:
    """Pairs (a < b) of classes under one value, of sizes and, for whole sets, ranks that the threshold allows."""
    x = left.select("value", F.col("class_id").alias("x"), F.col("n").alias("nx"), F.col("rank").alias("rx"),
                    *[F.col(c) for c in left.columns if c.startswith("l_")])
    y = right.select("value", F.col("class_id").alias("y"), F.col("n").alias("ny"), F.col("rank").alias("ry"),
                     *[F.col(c) for c in right.columns if c.startswith("r_")])
    joined = x.join(y, "value").where((F.col("x") != F.col("y")) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")))
    if exact:
        need = F.ceil((F.col("nx") + F.col("ny")) * percent / (100 + percent))
        joined = joined.where((F.col("rx") <= F.col("nx") - need + 1) & (F.col("ry") <= F.col("ny") - need + 1))
    for c in conditions:
        joined = joined.where(c)
    return joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def estimated(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b, whole: the pairs that may reach the threshold by their union sketch; `whole` if that decides it."""
    side = classes.select("class_id", "n", "sketch")
    both = pairs.join(side.select(F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a") \
        .join(side.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    top = F.least(*[F.when(F.col(f"n{s}") > SKETCH, F.element_at(f"s{s}", -1)).otherwise(F.lit((1 << 63) - 1)) for s in "ab"])
    union = F.size(F.filter(F.array_union("sa", "sb"), lambda v: v <= top))
    whole = (F.col("na") <= SKETCH) & (F.col("nb") <= SKETCH)
    passed = F.when(whole, 100 * shared >= percent * (F.col("na") + F.col("nb") - shared)) \
        .otherwise(shared >= least_estimate(percent) * union)
    return cut_lineage(both.where(passed).select("a", "b", whole.alias("whole")))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: the estimated pairs whose whole sets reach the threshold."""
    large = pairs.where(~F.col("whole")).select("a", "b") \
        .join(sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("sa")), "a") \
        .join(sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("sb")), "b") \
        .mapInArrow(_confirmed(percent), "a long, b long")
    return cut_lineage(pairs.where("whole").select("a", "b").union(large))


def _short(key: Column) -> Column:
    """64 bits of a text key, for narrow rows that are told apart by their id first."""
    return F.xxhash64(key)


def _sets(docs: DataFrame, classes: DataFrame, repeated: DataFrame) -> DataFrame:
    """class_id and its whole set, from the text of one document of each class: the example's, found by its id and text.

    `repeated` names the classes in which several rows have the same id, or none, and the same text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _portions(batches):
            keep, values = [], []
            classes = batch.column("class_id").to_pylist()
            for i, s in enumerate(shingle_sets(texts, WORDS)):
                if len(s) and set_key(s) == classes[i]:     # not another text of the same id and short key
                    keep.append(classes[i])
                    values.append(s)
            lengths = np.concatenate([[0], np.cumsum([len(v) for v in values])])
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keep, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.int64()))],
                names=["class_id", "shingles"])

    one = classes.select(F.col("example.doc_id").alias("example_id"), F.col("example.key").alias("example_key"), "class_id")
    texts = docs.select(F.col("doc_id").cast("long"), _short(text_key(F.col("text"))).alias("key"), "text") \
        .join(one, F.col("doc_id").eqNullSafe(F.col("example_id")) & (F.col("key") == F.col("example_key"))) \
        .select("class_id", "text")
    if repeated.limit(1).count():       # rows that repeat an id and text: one of them is enough
        texts = texts.join(repeated, "class_id", "left_anti").union(
            texts.join(repeated, "class_id", "left_semi").dropDuplicates(["class_id"]))
    return cut_lineage(texts.mapInArrow(run, "class_id long, shingles array<long>").withColumn("n", F.size("shingles").cast("long")))


def _confirmed(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def arrays(column: pa.ListArray) -> list[np.ndarray]:
        flat, at = column.values.to_numpy(), column.offsets.to_numpy()
        return [flat[i:j] for i, j in zip(at[:-1], at[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(arrays(batch.column("sa")), arrays(batch.column("sb"))):
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared = int((y[at] == x).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _common_links(sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links between classes of common values, by their whole sets: enough of them to connect what is connected."""
    lists = cut_lineage(exact_postings(sets, percent))
    cold, hot = lists.where(~F.col("hot")), lists.where("hot")
    centres = hot.groupBy("value").agg(F.min(F.struct("rank", -F.col("n"), "class_id", "n")).alias("h")) \
        .select("value", "h.class_id", "h.n", "h.rank")
    pairs = cut_lineage(_pairs(cold, cold, True, percent, F.col("x") < F.col("y")).union(_pairs(hot, centres, True, percent)).distinct())
    found = confirmed(estimated(pairs, classes, percent), sets, percent)
    placed = hot.join(cut_lineage(components(found)).withColumnRenamed("id", "class_id"), "class_id", "left") \
        .withColumn("component", F.coalesce("component", "class_id"))
    split = placed.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    open_ = cut_lineage(placed.join(split.select("value"), "value", "left_semi"))
    if not open_.limit(1).count():
        return found
    main = open_.groupBy("value", "component").agg(F.count("*").alias("rows")) \
        .groupBy("value").agg(F.max(F.struct("rows", "component")).alias("m")).select("value", F.col("m.component").alias("main"))
    rest = open_.join(main, "value").where(F.col("component") != F.col("main"))
    more = _pairs(rest.withColumn("l_c", F.col("component")), open_.withColumn("r_c", F.col("component")), True, percent,
                  F.col("l_c") != F.col("r_c"))
    more = cut_lineage(more.distinct().join(pairs, ["a", "b"], "left_anti"))
    return found.union(confirmed(estimated(more, classes, percent), sets, percent)) if more.limit(1).count() else found


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key. Texts are linked from a Jaccard similarity of percent / 100 on."""
    docs = docs.select("doc_id", "text")
    rows = cut_lineage(sketches(docs))
    classes = cut_lineage(rows.where("n_shingles > 0").groupBy("class_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", _short(F.col("text_key")).alias("key"))).alias("example"), F.min("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    lists = cut_lineage(postings(classes, percent))
    cold, common = lists.where(~F.col("hot")), cut_lineage(lists.where("hot").select("class_id").distinct())
    likely = estimated(_pairs(cold, cold, False, percent, F.col("x") < F.col("y")).distinct(), classes, percent)
    large = likely.where(~F.col("whole"))
    wanted = large.select(F.col("a").alias("class_id")).union(large.select("b")).union(common).distinct()
    repeated = cut_lineage(rows.where("n_shingles > 0").groupBy("class_id", "doc_id", _short(F.col("text_key"))).agg(F.count("*").alias("rows"))
                           .where("rows > 1").select("class_id").distinct())
    sets = _sets(docs, classes.join(wanted, "class_id", "left_semi"), repeated)
    found = confirmed(likely, sets, percent).union(_common_links(sets.join(common, "class_id", "left_semi"), classes, percent))
    labels = cut_lineage(components(found))
    placed = rows.select("doc_id", "text_key", "n_shingles", "class_id") \
        .join(labels.withColumnRenamed("id", "class_id"), "class_id", "left") \
        .withColumn("component", F.coalesce("component", "class_id"))
    smallest = placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    return placed.join(smallest, "component", "left").select(
        "doc_id", "n_shingles", F.coalesce("smallest", "doc_id").alias("component_id"),
        (F.col("doc_id") == F.coalesce("smallest", "doc_id")).alias("kept"), "text_key")


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near duplicates; of rows that repeat an id and text, one. Rows without an id stay."""
    docs, back = guarded(docs, "doc_id", "text")
    keyed = docs.withColumn("text_key", text_key(F.col("text")))
    flags = cut_lineage(near_duplicates(docs, percent).select(F.col("doc_id").alias("flag_id"), F.col("text_key").alias("flag_key"), "kept"))
    of_flag = F.col("doc_id").cast("long").eqNullSafe(F.col("flag_id")) & (F.col("text_key") == F.col("flag_key"))
    out = keyed.join(flags.where(~F.col("kept")).drop("kept").distinct(), of_flag, "left_anti")
    repeated = cut_lineage(flags.where("kept").groupBy("flag_id", "flag_key").agg(F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    if repeated.limit(1).count():
        out = out.join(repeated, of_flag, "left_anti").union(
            out.join(repeated, of_flag, "left_semi").dropDuplicates(["doc_id", "text_key"]))
    return out.select(*back)
