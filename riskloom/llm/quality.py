"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network.

1. A word is two units: its letters (hashed to CORES) and its shape (runs of upper case, lower case and digits as one sign each,
   other signs as they are; hashed to SHAPES). Every unit has a fixed sparse index vector. A unit's word vector is the sum of
   the index vectors of the words before and after it, over the whole corpus, and of its own: whole numbers, so any order of
   tasks gives the same sums. The table has CORES + SHAPES rows whatever the corpus, so it may be broadcast.
2. A document's features are the (shrunken) means of its units' vectors, the share of words that repeat their predecessor, and its length.
3. A two-layer network in numpy learns from at most `max_rows` labelled documents (a fixed share of the hashes of their ids);
   a part of them sets the temperature that calibrates its probabilities. Texts are scored where they are, without a join.

Labels come only from rows whose crc32(doc_id as text) mod 5 is not 0; label, language, source and id are never inputs of a
score. Nulls and odd input: a null or empty text has zero features and still gets a score; null labels are ignored, repeated
ones averaged; a null doc_id is not held out (its crc32 is null) and has no label. Without any label of both kinds every score
is the share of label 1 (0.5 without labels). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import checked_broadcast, guarded, held_out
from riskloom.llm.words import NOT_SPACE, mix, text_chunks, word_hashes
from riskloom.session import cut_lineage, ship_package

CORES, SHAPES = 8192, 1024
UNITS = CORES + SHAPES
DIMS = 32
SIGNS = 2                  # non-zero entries of an index vector
EXTRA = 3
FEATURES = 2 * DIMS + EXTRA
PRIOR = 3                  # words without any sign that a mean starts from, so that a text of a word or two isn't extreme
HIDDEN = 32
THRESHOLD = 0.3
MAX_ROWS = 20_000
PLACES = 1 << 30

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x41:0x5B] = ord("A")
_CLASS[0x61:0x7B] = ord("a")
_CLASS[0x30:0x3A] = ord("0")
_CLASS[0x80:] = ord("a")
_CLASS[0x09:0x0E] = 0x20
_CORE = np.ones(256, bool)
_CORE[[b for b in range(128) if not chr(b).isalnum()]] = False


def units(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word in order: the unit of its letters, of its shape, and the number of its text."""
    whole, owner = word_hashes(texts, NOT_SPACE)
    joined = np.frombuffer(b" ".join(t or b"" for t in texts), np.uint8)
    signs = _CLASS[joined]
    change = np.ones(len(signs), bool)
    change[1:] = signs[1:] != signs[:-1]
    shapes, _ = word_hashes([signs[change].tobytes()], NOT_SPACE, lower=False)
    letters = joined.copy()
    letters[~_CORE[joined]] = 0x5F                       # other signs inside a word count as one kind
    letters[~NOT_SPACE[joined]] = 0x20
    cores, _ = word_hashes([letters.tobytes()], NOT_SPACE)
    return (cores % np.uint64(CORES)).astype(np.int64), CORES + (shapes % np.uint64(SHAPES)).astype(np.int64), owner


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each unit's index vector."""
    h = mix(np.arange(1, 2 * UNITS * SIGNS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).reshape(2, UNITS, SIGNS)
    return (h[0] % np.uint64(DIMS)).astype(np.int64), 1 - 2 * (h[1] & np.uint64(1)).astype(np.int64)


def word_sums(docs: DataFrame) -> DataFrame:
    """unit, uses, v0, v1, ...: the summed index vectors of each unit's neighbours over all documents."""
    ship_package(docs.sparkSession)
    names = [f"v{i}" for i in range(DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        size = UNITS * DIMS
        sums, uses = np.zeros(size), np.zeros(UNITS, np.int64)
        for batch in batches:
            for texts in text_chunks(batch.column("text")):
                core, shape, owner = units(texts)
                uses += np.bincount(core, minlength=UNITS) + np.bincount(shape, minlength=UNITS)
                near = np.flatnonzero(owner[1:] == owner[:-1])
                for here, other, shift in ((near, near + 1, 0), (near + 1, near, DIMS // 2)):   # what follows, what precedes
                    for neighbour in (core[other], shape[other]):
                        for s in range(SIGNS):
                            place, sign = (places[neighbour, s] + shift) % DIMS, signs[neighbour, s].astype(np.float64)
                            for unit in (core[here], shape[here]):
                                sums += np.bincount(unit * DIMS + place, weights=sign, minlength=size)
        used = np.flatnonzero(uses)
        table = np.rint(sums).astype(np.int64).reshape(UNITS, DIMS)[used]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(uses[used]), *[pa.array(table[:, i]) for i in range(DIMS)]],
                                         names=["unit", "uses", *names])

    parts = docs.select("text").mapInArrow(run, "unit long, uses long, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy("unit").agg(F.sum("uses").alias("uses"), *[F.sum(n).alias(n) for n in names])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors, UNITS x DIMS: each unit's neighbours at length 1, and a share of its own index vector."""
    places, signs = index_vectors()
    own = np.zeros((UNITS, DIMS))
    for s in range(SIGNS):
        np.add.at(own, (np.arange(UNITS), places[:, s]), signs[:, s])
    around = np.zeros((UNITS, DIMS))
    for row in word_sums(docs).collect():          # at most UNITS rows
        around[row[0]] = row[2:]
    length = np.linalg.norm(around, axis=1, keepdims=True)
    return (around / np.maximum(length, 1) + own / np.sqrt(SIGNS)).astype(np.float32)


def pooled(texts: list[bytes | None], table: np.ndarray) -> np.ndarray:
    """The features of each text, by the table of word vectors."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    core, shape, owner = units(texts)
    if not len(core):
        return out
    n = np.bincount(owner, minlength=len(texts))
    present, first = np.flatnonzero(n), np.searchsorted(owner, np.flatnonzero(n))
    count = n[present][:, None] + PRIOR
    out[present, :DIMS] = np.add.reduceat(table[core], first, axis=0, dtype=np.float64) / count
    out[present, DIMS:2 * DIMS] = np.add.reduceat(table[shape], first, axis=0, dtype=np.float64) / count
    again = np.zeros(len(core))
    again[1:] = (core[1:] == core[:-1]) & (owner[1:] == owner[:-1])
    out[:, -3] = np.bincount(owner, weights=again, minlength=len(texts)) / np.maximum(n, 1)
    kinds = np.unique(owner * CORES + core) // CORES
    out[:, -2] = np.bincount(kinds, minlength=len(texts)) / np.maximum(n, 1)
    out[:, -1] = np.log1p(n)
    return out


def features(docs: DataFrame, vectors: Broadcast) -> DataFrame:
    """docs without text, with features: the pooled vectors of every document."""
    ship_package(docs.sparkSession)

    @F.arrow_udf("array<float>")
    def of_text(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            rows = np.concatenate([np.zeros((0, FEATURES), np.float32), *[pooled(t, vectors.value) for t in text_chunks(column)]])
            at = np.arange(0, len(column) + 1, dtype=np.int32) * FEATURES
            yield pa.ListArray.from_arrays(pa.array(at), pa.array(rows.ravel()))

    return docs.withColumn("features", of_text("text")).drop("text")


class Network:
    """Two layers on standardised inputs; Adam on the logistic loss; a temperature fitted on rows kept aside."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = 40, batch: int = 128):
        rng = np.random.RandomState(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        aside = np.arange(len(x)) % 5 == 0
        train, check = x[~aside], x[aside]
        parts = [rng.randn(x.shape[1], HIDDEN) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.randn(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
        for _ in range(max(epochs, 4000 // max(1, len(train) // batch + 1))):
            order = rng.permutation(len(train))
            for i in range(0, len(train), batch):
                a, t = train[order[i:i + batch]], y[~aside][order[i:i + batch]]
                h = np.tanh(a @ parts[0] + parts[1])
                error = (1 / (1 + np.exp(-(h @ parts[2] + parts[3]))) - t) / len(t)
                back = np.outer(error, parts[2]) * (1 - h * h)
                grads = [a.T @ back + 1e-4 * parts[0], back.sum(0), h.T @ error + 1e-4 * parts[2], error.sum(keepdims=True)]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    parts[k] = parts[k] - 0.003 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        self.parts, self.temperature = parts, 1.0
        logits, target = (self._logits(check), y[aside]) if len(check) else (self._logits(train), y[~aside])
        heats = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        self.temperature = float(heats[np.argmin([np.logaddexp(0, np.where(target > 0.5, -1, 1) * logits / t).mean() for t in heats])])

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.parts[0] + self.parts[1]) @ self.parts[2] + self.parts[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits((x - self.mean) / self.scale) / self.temperature, -500, 500)))


class Constant:
    """Without labels of both kinds there is nothing to tell apart."""

    def __init__(self, y: np.ndarray):
        self.share = float(y.mean()) if len(y) else 0.5

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, text, label_, place: about max_rows labelled documents that are not held out, by a fixed share of hashes.

    Ids decide first, so that the narrow table of labels, at most some max_rows rows, meets the texts where they are.
    """
    known = labels.where(F.col(label).isNotNull()).select(F.col("doc_id").cast("long"), F.col(label).cast("double").alias("label_")) \
        .groupBy("doc_id").agg(F.avg("label_").alias("label_")).where(~held_out(F.col("doc_id")))
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    known = cut_lineage(known.join(texts.groupBy("doc_id").agg(F.count("*").alias("rows_")), "doc_id")
                        .withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(PLACES))))
    chosen = known.where(F.col("place") < _share(known.count(), max_rows))
    rows = texts.join(checked_broadcast(chosen.drop("rows_"), 2 * max_rows), "doc_id")
    if (chosen.agg(F.sum("rows_")).first()[0] or 0) <= max_rows:
        return rows
    text = F.pmod(F.xxhash64("doc_id", "text"), F.lit(PLACES))      # ids that stand for several texts: a share of these
    return rows.where(text < _share(rows.select("doc_id", text).distinct().count(), max_rows))


def _share(rows: int, most: int) -> int:
    """The bound of places below which at most so many of the rows lie; a little less than allowed."""
    return PLACES if rows <= most else int(PLACES * most / rows * 0.97)


def fit(rows: DataFrame, max_rows: int = MAX_ROWS) -> Network | Constant:
    """Learn from a sample of (doc_id, features, label_, place); rows that repeat each other count once."""
    found = sorted(rows.groupBy("place", "doc_id", "features").agg(F.min("label_").alias("label_")).limit(2 * max_rows).collect(),
                   key=lambda r: (r.place, r.doc_id, r.features))[:max_rows]
    y = np.array([float(r.label_ >= 0.5) for r in found])
    if not len(y) or y.min() == y.max():
        return Constant(y)
    return Network(np.array([r.features for r in found], np.float64), y)


def scored(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """docs with score_, which depends on the text alone: no row leaves its place for it."""
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs))
    learned = cut_lineage(features(sample(docs, labels, max_rows=max_rows), vectors))
    model = spark.sparkContext.broadcast(fit(learned, max_rows))

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = [model.value.probability(pooled(t, vectors.value).astype(np.float64)) for t in text_chunks(column)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    return docs.withColumn("score_", score("text"))


def scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = scored(docs.select(F.col("doc_id").cast("long"), "text"), labels, max_rows)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("score_").alias("score"),
                       (F.col("score_") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier does not reject."""
    docs, back = guarded(docs, "doc_id", "text")
    return scored(docs, labels, **options).where(F.col("score_") >= THRESHOLD).select(*back)
