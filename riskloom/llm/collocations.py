"""Phrase collocations: frequent phrases by mergeable Misra-Gries summaries, counted exactly in a second pass, scored by their cuts.

A phrase is 1 to 5 words that follow each other within a piece; pieces lie between `.,;:!?` and line ends. Everything is per lang.

First pass. Every phrase occurrence has a 63-bit key over lang and words, and every key one of P hash partitions. Tasks count keys
locally (an untruncated summary of their rows), and one reducer per hash partition merges these summaries as they stream in. It holds
at most twice `capacity` counters, capacity being the partition's mass divided by the threshold: beyond that, all counters lose the
(capacity + 1)-th largest count, and the ones at zero go. What is lost so adds up to less than the threshold, so each phrase that
reaches it survives. Masses are counted beforehand; P grows with the corpus, so a reducer's memory does not.

The lengths are summarised in turn, 1 and 2, then 3, then 4 and 5. A longer phrase is only counted if the surviving shorter ones that
it must hold pass a table of bits (at most 2^GATE_BITS, so of bounded size; it can let too much through, never too little).

Second pass. The phrases that pass the bits of all survivors are counted exactly, by their words: tasks count by key, checked by a
second hash, and Spark adds the counts up by the phrase itself. What is below the threshold goes now.

Parts of a frequent phrase are frequent, so l and r are in the same table, and so are the longer phrases that hide a shorter one.
Scores are decimals of 38 digits. Ranks take a limited number per lang before any shuffle.

Nulls and odd input: a null lang is `und`, also where `und` is a lang of its own; a null or empty text has no words. Repeated rows
count as often as they stand. Ties in rank are broken by the phrase's bytes. Long texts are cut at the ends of pieces, so memory
follows the longest piece. An empty table gives an empty result. Columns other than lang and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import checked_broadcast
from riskloom.llm.words import _BYTE, _LOWER, _power_tables, as_bytes, mix
from riskloom.session import cut_lineage, ship_package

LONGEST, THRESHOLD, TOP = 5, 100, 2000
ROUNDS = ((1, 2), (3,), (4, 5))      # lengths that are summarised together; all but the first are gated by the round before
COUNTERS = 1 << 20                   # counters of a hash partition, by which the number of partitions is chosen
PARTITIONS = 32                      # hash partitions at least
GATE_BITS = 27                       # 2^27 bits, 16 MB, at most
CHUNK = 1 << 20
FLUSH = 1 << 21                      # counters that a task holds before it hands them on
SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"

_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, 0x09, *SEPARATORS]] = False
_CUT = np.zeros(256, bool)
_CUT[list(SEPARATORS)] = True
_CUTS = re.compile(rb"[.,;:!?\x0a-\x0d]")
_FACTORS = mix(np.arange(1, 2 * LONGEST + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Words:
    """The words of a stretch of texts: where they lie, their hashes, and the keys of the phrases that begin at each."""

    def __init__(self, data: bytes, seed: int):
        self.data, self.seed = data.translate(_LOWER), np.uint64(seed)
        raw = np.frombuffer(self.data, np.uint8)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = _INSIDE[raw]
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.piece = np.searchsorted(np.flatnonzero(_CUT[raw]), self.starts)
        powers, inverses = _power_tables(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * powers[:len(raw)], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * inverses[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.starts)

    def whole(self, n: int) -> np.ndarray:
        """The places from which n words lie in one piece."""
        m = len(self) - n + 1
        return np.flatnonzero(self.piece[n - 1:] == self.piece[:m]) if m > 0 else np.zeros(0, np.int64)

    def keys(self, n: int, at: np.ndarray, second: bool = False) -> np.ndarray:
        out = np.full(len(at), n, np.uint64) + self.seed
        for k in range(n):
            out += self.hashes[at + k] * _FACTORS[k + LONGEST * second]
        return (mix(out) >> np.uint64(1)).astype(np.int64)

    def phrase(self, i: int, n: int) -> bytes:
        return b" ".join(self.data[a:b] for a, b in zip(self.starts[i:i + n], self.ends[i:i + n]))


def _stretches(texts: Iterator[bytes]) -> Iterator[bytes]:
    """Texts, joined by line ends, in stretches of about CHUNK; a longer text is cut behind the ends of pieces."""
    waiting, size = [], 0
    for text in texts:
        start = 0
        while len(text) - start > CHUNK:
            cut = _CUTS.search(text, start + CHUNK)
            if cut is None:
                break
            yield text[start:cut.end()]
            start = cut.end()
        waiting.append(text[start:] if start else text)
        size += len(waiting[-1]) + 1
        if size >= CHUNK:
            yield b"\n".join(waiting)
            waiting, size = [], 0
    if waiting:
        yield b"\n".join(waiting)


def seed_of(lang: str) -> int:
    return int.from_bytes(hashlib.md5(lang.encode()).digest()[:8], "big")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    for batch in batches:
        texts, langs = as_bytes(batch.column(1)), batch.column(0).to_pylist()
        by_lang: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            if texts[i]:
                by_lang.setdefault("und" if lang is None else lang, []).append(i)
        for lang, rows in by_lang.items():
            for data in _stretches(texts[i] for i in rows):
                yield lang, Words(data, seed_of(lang))


def _open(gate: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bits of the keys are set."""
    bucket = keys & (len(gate) * 64 - 1)
    return (gate[bucket >> 6] >> (bucket & 63)) & 1 == 1


def _due(words: Words, n: int, gate: np.ndarray | None, gate_n: int) -> np.ndarray:
    """The places of n words in one piece whose shorter phrases pass the gate."""
    at = words.whole(n)
    if gate is None or not len(at):
        return at
    shorter = np.zeros(len(words), bool)
    places = words.whole(gate_n)
    shorter[places] = _open(gate, words.keys(gate_n, places))
    ok = np.ones(len(at), bool)
    for k in range(n - gate_n + 1):
        ok &= shorter[at + k]
    return at[ok]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _masses(partitions: int):
    """(lang, slot, n): words of a lang (slot -1), and phrase occurrences of a round and hash partition (slot round * P + partition)."""
    def run(batches):
        words_of: dict[str, int] = {}
        masses = np.zeros(len(ROUNDS) * partitions, np.int64)
        for lang, words in _read(batches):
            words_of[lang] = words_of.get(lang, 0) + len(words)
            for r, lengths in enumerate(ROUNDS):
                for n in lengths:
                    part = words.keys(n, words.whole(n)) % partitions
                    masses[r * partitions:(r + 1) * partitions] += np.bincount(part, minlength=partitions)
        slots = np.flatnonzero(masses)
        yield pa.RecordBatch.from_arrays([pa.array([*words_of, *[None] * len(slots)], pa.string()),
                                          pa.array([*[-1] * len(words_of), *slots.tolist()], pa.int64()),
                                          pa.array([*words_of.values(), *masses[slots].tolist()], pa.int64())], ["lang", "slot", "n"])
    return run


def _local(round_: int, partitions: int, gate):
    """(part, key, c): each task's own counts, an exact summary of its rows, handed on in bounded portions."""
    def run(batches):
        bits = None if gate is None else gate.value
        keys, counts, held = [], [], 0

        def portion():
            k, c = _summed(keys, counts)
            for i in range(0, len(k), 1 << 18):
                part = pa.array((k[i:i + (1 << 18)] % partitions).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part, pa.array(k[i:i + (1 << 18)]), pa.array(c[i:i + (1 << 18)])], ["part", "key", "c"])

        for _, words in _read(batches):
            for n in ROUNDS[round_]:
                at = _due(words, n, bits, max(ROUNDS[round_ - 1]) if round_ else 0)
                k, c = np.unique(words.keys(n, at), return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
            if held > FLUSH:
                keys, counts = map(list, zip(_summed(keys, counts)))
                held = len(keys[0])
                if held > FLUSH // 2:
                    yield from portion()
                    keys, counts, held = [], [], 0
        if held:
            yield from portion()
    return run


class Summary:
    """Misra-Gries: at most `capacity` counters after a cut, each at most `lost` too low. A key without one was seen at most `lost` times."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > max(4 * self.capacity, 1 << 16):
            self.cut()

    def cut(self) -> None:
        k, c = _summed(self.keys, self.counts) if self.keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(k) > 2 * self.capacity:
            less = int(np.partition(c, len(c) - self.capacity - 1)[len(c) - self.capacity - 1])
            self.lost += less
            left = c > less
            k, c = k[left], c[left] - less
        self.keys, self.counts, self.held = [k], [c], len(k)

    def survivors(self, threshold: int) -> np.ndarray:
        self.cut()
        return self.keys[0][self.counts[0] + self.lost >= threshold]


def _merged(capacities, threshold: int):
    """The surviving keys of the hash partitions that come to this task."""
    def run(batches):
        summaries: dict[int, Summary] = {}
        for batch in batches:
            parts, keys, counts = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            order = np.argsort(parts, kind="stable")
            parts, keys, counts = parts[order], keys[order], counts[order]
            starts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else []
            for a, b in zip(starts, [*starts[1:], len(parts)]):
                p = int(parts[a])
                if p not in summaries:
                    summaries[p] = Summary(int(capacities.value[p]))
                summaries[p].add(keys[a:b], counts[a:b])
        for s in summaries.values():
            yield pa.RecordBatch.from_arrays([pa.array(s.survivors(threshold))], ["key"])
    return run


def _gate(survivors: DataFrame):
    """The bits of the surviving keys as a broadcast; at most 2^GATE_BITS."""
    n = survivors.count()
    size = 1 << min(GATE_BITS, max(16, (32 * n).bit_length()))
    bucket = F.col("key").bitwiseAND(size - 1)
    rows = survivors.select(F.shiftright(bucket, 6).alias("at"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")) \
        .groupBy("at").agg(F.bit_or("bit").alias("bits"))
    bits = np.zeros(size // 64, np.int64)
    found = rows.toArrow()
    bits[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return survivors.sparkSession.sparkContext.broadcast(bits)


def _exact(gate):
    """(lang, phrase, words, c) of the phrases that pass the gate, counted within a task by key and second hash."""
    def run(batches):
        bits, names, counts = gate.value, {}, {}

        def portion():
            rows = [(lang, name, n, counts[id_]) for id_, (lang, name, n) in names.items()]
            for i in range(0, len(rows), 1 << 16):
                lang, name, n, c = zip(*rows[i:i + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(name, pa.binary()), pa.array(n, pa.int32()),
                                                  pa.array(c, pa.int64())], ["lang", "phrase", "words", "c"])

        for lang, words in _read(batches):
            for n in range(1, LONGEST + 1):
                at = words.whole(n)
                keys = words.keys(n, at)
                ok = _open(bits, keys)
                at, keys = at[ok], keys[ok]
                while len(at):      # once, but for phrases of equal keys
                    second = words.keys(n, at, second=True)
                    k, first, back, c = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
                    same = second == second[first][back]
                    if not same.all():
                        c = np.bincount(back[same], minlength=len(k))
                    for key, other, i, m in zip(k.tolist(), second[first].tolist(), at[first].tolist(), c.tolist()):
                        if (id_ := (key, other)) in counts:
                            counts[id_] += m
                        else:
                            counts[id_] = m
                            names[id_] = (lang, words.phrase(i, n), n)
                    at, keys = at[~same], keys[~same]
            if len(names) > FLUSH // 16:
                yield from portion()
                names.clear()
                counts.clear()
        if names:
            yield from portion()
    return run


def frequent_phrases(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to 5 words that stand at least `threshold` times, and (lang, n); both stored."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    ship_package(spark)
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(PARTITIONS, -(-LONGEST * (size // 2 + 1) // (threshold * COUNTERS)))    # a word and its gap are two bytes at least
    totals = cut_lineage(texts.mapInArrow(_masses(partitions), "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")))
    masses = np.zeros(len(ROUNDS) * partitions, np.int64)
    for row in totals.where("slot >= 0").collect():
        masses[row.slot] = row.n
    gate, survivors = None, None
    for r in range(len(ROUNDS)):
        capacities = sc.broadcast(masses[r * partitions:(r + 1) * partitions] // threshold)
        local = texts.mapInArrow(_local(r, partitions, gate), "part int, key long, c long")
        found = cut_lineage(local.repartition(partitions, "part").mapInArrow(_merged(capacities, threshold), "key long"))
        survivors = found if survivors is None else survivors.union(found)
        gate = _gate(found)
    counted = texts.mapInArrow(_exact(_gate(survivors)), "lang string, phrase binary, words int, c long") \
        .groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "words").agg(F.sum("c").alias("f")).where(F.col("f") >= threshold)
    return cut_lineage(counted), totals.where("slot = -1").select("lang", "n")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of 2 to 5 words of each lang."""
    frequent, n_words = frequent_phrases(docs, threshold)
    candidates = frequent.where("words >= 2").withColumn("w", F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k")) \
        .select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("left"),
                F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("right"))
    part = frequent.select(F.col("lang").alias("part_lang"), F.col("phrase").alias("part"), "f")
    lefts, rights = part.withColumnRenamed("f", "l"), part.withColumnRenamed("f", "r")
    scored = cuts.join(lefts, (F.col("lang") == F.col("part_lang")) & (F.col("left") == F.col("part"))).drop("part_lang", "part") \
        .join(rights, (F.col("lang") == F.col("part_lang")) & (F.col("right") == F.col("part"))).drop("part_lang", "part") \
        .join(checked_broadcast(n_words), "lang") \
        .withColumn("score", F.expr("cast(a as decimal(18, 0)) * cast(n as decimal(19, 0)) * 1000 div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("b")).select("lang", "phrase", "b.*")
    inner = F.expr("""flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))""")
    longer = candidates.where("words >= 3").select(F.col("lang").alias("in_lang"), F.explode(inner).alias("in_phrase"), "f") \
        .groupBy("in_lang", "in_phrase").agg(F.max("f").alias("f"))
    alone = best.join(longer, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("in_phrase")) & (F.col("f") >= F.col("a")), "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return alone.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top) \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


COLLOCATION_SQL = r"""
with p as (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[.,;:!?\x0A-\x0D]')) piece from documents),
w as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from p),
n as (select lang, sum(len(w))::bigint n from w group by all),
g as (select lang, unnest(flatten(list_transform(range(1, 6), lambda m: list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])))) g from w),
f as materialized (select lang, g, count(*) f from g group by all having f >= 100),
cuts as (select lang, g, f a, unnest(range(1, len(g))) k from f where len(g) >= 2),
scored as (select c.lang, c.g, c.k, c.a, x.f l, y.f r, n.n, 1000::hugeint * c.a * n.n // (x.f::hugeint * y.f) score
           from cuts c join f x on x.lang = c.lang and x.g = c.g[:c.k] join f y on y.lang = c.lang and y.g = c.g[c.k + 1:] join n on n.lang = c.lang),
best as (select * from scored qualify row_number() over (partition by lang, g order by score, k) = 1),
inside as (select lang, f, unnest(flatten(list_transform(range(2, len(g)), lambda m: list_transform(range(1, len(g) - m + 2), lambda i: g[i:i + m - 1])))) g
           from f where len(g) >= 3),
alone as (select * from best b where not exists (select 1 from inside i where i.lang = b.lang and i.g = b.g and 100 * i.f >= 100 * b.a))
select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank, array_to_string(g, ' ') phrase,
       a, l, r, n, score::bigint score from alone qualify rank <= 2000
"""
