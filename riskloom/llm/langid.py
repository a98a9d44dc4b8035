"""Language ID by multilingual mixture inference over hashed byte trigrams.

Learning counts the trigrams of all labelled documents per language (a table of BUCKETS rows per language, so what is
broadcast depends on the number of languages only). A document is seen as drawn from a mixture of languages:
expectation-maximisation estimates the proportions from its trigrams' likelihoods. Languages are then added in order of their
proportion as long as the likelihood, less a penalty per language, grows. The prediction is the language with the largest
proportion in the chosen set. The score is that proportion; of a set of one language, its share in a tempered comparison of
the single-language likelihoods.

Learning uses text and non-null lang of documents whose crc32(doc_id as text) mod 5 is not 0; lang, source and doc_id are never
inputs of a prediction. Nulls and odd input: a null text, or one without any letter, gives `und` with score 0, as does every
text when nothing can be learned. Signs other than letters part words. Ties go to the language that comes first by code point.
A null doc_id is not held out. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import held_out
from riskloom.llm.words import as_bytes, chunks, mix
from riskloom.session import ship_package

BUCKETS = 1 << 15
SMOOTH = 0.5
ROUNDS = 12
MAX_LANGUAGES = 1000      # the model's size is MAX_LANGUAGES * BUCKETS numbers at most; more distinct values raise an error
PENALTY = 3.0             # per added language, in units of log(number of trigrams)

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_HIGH = re.compile(rb"[\x80-\xff]")


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(_ASCII_LETTER.search(text)) or \
        bool(_HIGH.search(text)) and any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def trigrams(texts: list[bytes | None]) -> list[np.ndarray]:
    """The bucket of every trigram of each text; runs of other signs than letters are one space, as are both ends."""
    joined = _LETTER[np.frombuffer(b" " + b" ".join((t or b"") + b" " for t in texts), np.uint8)]
    ends = np.cumsum([0] + [len(t or b"") + 2 for t in texts])
    keep = np.ones(len(joined), bool)
    keep[1:] = (joined[1:] != 0x20) | (joined[:-1] != 0x20)
    kept = np.concatenate([[0], np.cumsum(keep)])
    data = joined[keep].astype(np.uint64)
    code = data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]
    bucket = (mix(code + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)
    letters = np.flatnonzero((data[1:-1] != 0x20) | (data[:-2] != 0x20) & (data[2:] != 0x20))
    bucket[np.setdiff1d(np.arange(len(bucket)), letters, assume_unique=True)] = -1
    out = []
    for i in range(len(texts)):
        # a text's signs lie between the space before it and the space behind it
        own = bucket[max(0, kept[ends[i]] - (i > 0)):max(0, kept[min(ends[i + 1], len(joined))] - 2)]
        out.append(own[own >= 0])
    return out


def counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, uses over all labelled documents that are not held out."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = as_bytes(batch.column("text")), batch.column("lang").to_pylist()
            for i, j in chunks(texts):
                grams = trigrams(texts[i:j])
                for lang in set(langs[i:j]):
                    own = np.concatenate([g for g, name in zip(grams, langs[i:j]) if name == lang])
                    sums[lang] = sums.get(lang, 0) + np.bincount(own, minlength=BUCKETS)
        for lang, table in sums.items():
            used = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(table[used])],
                                             names=["lang", "bucket", "uses"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    return rows.mapInArrow(run, "lang string, bucket long, uses long").groupBy("lang", "bucket").agg(F.sum("uses").alias("uses"))


class Model:
    """Languages in code-point order and the probability of each bucket in each."""

    def __init__(self, rows: list):
        self.languages = sorted({r[0] for r in rows})
        if len(self.languages) > MAX_LANGUAGES:
            raise ValueError(f"{len(self.languages)} languages; at most {MAX_LANGUAGES} can be learned")
        number = {name: i for i, name in enumerate(self.languages)}
        table = np.full((len(self.languages), BUCKETS), SMOOTH)
        for lang, bucket, uses in rows:
            table[number[lang], bucket] += uses
        self.table = (table / table.sum(1, keepdims=True)).T.astype(np.float64).copy() if len(table) else table.T   # bucket x language

    def predict(self, grams: np.ndarray) -> tuple[str, float]:
        if not self.languages or not len(grams):
            return "und", 0.0
        number = np.bincount(grams, minlength=BUCKETS)
        used = np.flatnonzero(number)
        weight, likely = number[used].astype(np.float64), self.table[used]
        total = weight.sum()
        single = weight @ np.log(likely)
        chosen, shares, best = [int(single.argmax())], np.ones(1), float(single.max())
        full, _ = mixture(weight, likely)
        order = [int(i) for i in np.argsort(-full, kind="stable") if i != chosen[0]]
        penalty = PENALTY * np.log(total + 1)
        while order:        # add the next language while the penalised likelihood grows
            trial = [*chosen, order.pop(0)]
            part, value = mixture(weight, likely[:, trial])
            if value - penalty * (len(trial) - 1) <= best - penalty * (len(chosen) - 1):
                break
            chosen, shares, best = trial, part, value
        top = int(np.lexsort((chosen, -shares))[0])
        if len(chosen) > 1:
            return self.languages[chosen[top]], float(min(1.0, shares[top]))
        heat = np.exp((single - single.max()) / np.sqrt(total))
        return self.languages[chosen[0]], float(1 / heat.sum())


def mixture(weight: np.ndarray, likely: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the columns of `likely` that explain the weighted rows, by EM, and their log-likelihood."""
    shares = np.full(likely.shape[1], 1 / likely.shape[1])
    total = weight.sum()
    for _ in range(rounds):
        shares = shares * ((weight / (likely @ shares)) @ likely) / total
    return shares, float(weight @ np.log(likely @ shares))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    ship_package(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(Model(counts(docs).collect()))    # BUCKETS rows a language at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = as_bytes(batch.column("text")), []
            for i, j in chunks(texts):
                for text, grams in zip(texts[i:j], trigrams(texts[i:j])):
                    found.append(model.value.predict(grams) if has_letter(text) else ("und", 0.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double") \
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
