"""Benchmark decontamination by suffix arrays over the training text.

Every batch of documents is a shard. The shard's suffixes that could begin a benchmark window (their first words are those of
some window) are sorted by their words; every test suffix is binary-searched in that order, which gives the range of its
verbatim occurrences, with their locations. Documents are never shuffled: the benchmark goes to them, in blocks of at most
BLOCK_BYTES of text, one pass per block, so what is broadcast has a fixed bound whatever the benchmark's size.

A window is `window` consecutive words of an item; an item of fewer words is one window. Words are compared by 64-bit hashes.

Nulls and odd input: a null text has no words, so nothing in it is hit; items without words have no window; a null item_id is
named by the empty string, and items that share an id count once. Repeated documents give repeated rows. An empty benchmark
marks nothing. Extra columns stay if asked for; `annotate` replaces those named like its results, `clean_documents` changes none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import guarded
from riskloom.llm.words import ALNUM, all_word_hashes, as_bytes, mix
from riskloom.session import cut_lineage, ship_package

WINDOW = 10
HEAD = 3                    # first words that a suffix must share with a window to be sorted at all
BLOCK_BYTES = 8 << 20
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                       T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()),
                       T.StructField("contaminated", T.BooleanType())])
STATE = T.StructType([T.StructField("hit_bits_", T.BinaryType()), T.StructField("hit_items_", T.ArrayType(T.StringType()))])
MATCH = "item_id string, item_word long, doc_id long, doc_word long, n_words long"


class Block:
    """Test windows of some items: their words, lengths and owners, and a table of the heads that a suffix may begin with."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        hashes, owner = all_word_hashes([t for _, t in items], ALNUM)
        self.item = np.array([number[i] for i, _ in items], np.int64)[owner]
        self.words = hashes | np.uint64(1)
        bounds = np.searchsorted(owner, np.arange(len(items) + 1))
        starts, lengths = [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            n = max(1, b - a - window + 1) if b > a else 0
            starts.append(np.arange(a, a + n))
            lengths.append(np.full(n, min(window, b - a)))
        self.first = bounds[:-1][owner]                         # first word of the item of each word
        self.end = bounds[1:][owner]
        self.start = np.concatenate([np.zeros(0, np.int64), *starts]).astype(np.int64)
        self.length = np.concatenate([np.zeros(0, np.int64), *lengths]).astype(np.int64)
        self.rows = suffix_rows(self.words, self.start, self.end, window)
        self.window = window
        bits = max(10, int(16 * len(self.start)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.heads = {}
        for k in range(1, HEAD + 1):
            own = self.start[np.minimum(self.length, HEAD) == k]
            if len(own):
                self.heads[k] = np.zeros(1 << bits, bool)
                self.heads[k][head_hashes(self.words, k)[own] >> self.shift] = True


def head_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each position."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j:j + n] * np.uint64(2 * 0x632BE59BD9B4E019 * (j + 1) % (1 << 64) | 1)
    return mix(out)


def suffix_rows(words: np.ndarray, positions: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """The first `depth` words from each position, 0 behind the end of its text."""
    out = np.zeros((len(positions), depth), np.uint64)
    stop = end[positions] if len(positions) else positions
    for j in range(depth):
        inside = positions + j < stop
        out[inside, j] = words[positions[inside] + j]
    return out


class Shard:
    """The sorted suffixes of a batch of texts that begin like some window."""

    def __init__(self, texts: list[bytes | None]):
        hashes, self.owner = all_word_hashes(texts, ALNUM)
        self.words = hashes | np.uint64(1)
        self.bounds = np.searchsorted(self.owner, np.arange(len(texts) + 1))

    def search(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(window number, position) of every verbatim occurrence of every test window."""
        keep = np.zeros(len(self.words), bool)
        for k, table in block.heads.items():
            heads = head_hashes(self.words, k)
            keep[:len(heads)] |= table[heads >> block.shift]
        at = np.flatnonzero(keep)
        if not len(at) or not len(block.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = suffix_rows(self.words, at, self.bounds[1:][self.owner], block.window)
        order = np.lexsort(rows.T[::-1])
        at, rows = at[order], rows[order]
        low = self._bound(rows, block, right=False)
        high = self._bound(rows, block, right=True)
        found = high - low
        window = np.repeat(np.arange(len(found)), found)
        inner = np.arange(len(window)) - np.repeat(np.cumsum(found) - found, found)
        return window, at[low[window] + inner]

    @staticmethod
    def _bound(rows: np.ndarray, block: Block, right: bool) -> np.ndarray:
        low, high = np.zeros(len(block.start), np.int64), np.full(len(block.start), len(rows), np.int64)
        looked = np.arange(block.window) < block.length[:, None]
        each = np.arange(len(low))
        while (low < high).any():
            middle = (low + high) // 2
            there = rows[np.minimum(middle, len(rows) - 1)]
            unlike = (there != block.rows) & looked
            first = unlike.argmax(1)
            x, y, differ = there[each, first], block.rows[each, first], unlike.any(1)
            up = (differ & (x < y)) | (~differ if right else False)
            active = low < high
            low, high = np.where(active & up, middle + 1, low), np.where(active & ~up, middle, high)
        return low


def blocks(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The items in blocks of at most `most` bytes (or one longer item), read one block at a time."""
    items, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("binary"))
    for item, text in rows.where(F.col("text").isNotNull()).toLocalIterator(prefetchPartitions=True):
        if items and size + len(text) > most:
            yield Block(items, window)
            items, size = [], 0
        items.append((item, bytes(text)))
        size += len(text)
    yield Block(items, window)


def annotate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW,
             block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (the columns in `keep`, all by default) with n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.drop(*RESULT.names, *STATE.names)
    keep = docs.columns if keep is None else keep
    carried = list(dict.fromkeys([*keep, "text"]))
    state, waiting = docs.select(*carried), None
    for block in blocks(benchmark, window, block_bytes):
        if waiting is not None:
            state = cut_lineage(_marked(state, waiting, carried, last=False))
        waiting = block
    return _marked(state, waiting, keep, last=True)


def _marked(docs: DataFrame, block: Block, keep: list[str], last: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)
    out = T.StructType([docs.schema[c] for c in keep] + (RESULT if last else STATE).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = Shard(as_bytes(batch.column("text")))
            window, at = shard.search(shared.value)
            cover = _cover(shard, at, shared.value.length[window])
            items = _items(shard, shared.value, window, at, batch.num_rows)
            if "hit_bits_" in batch.schema.names:
                for i, (bits, names) in enumerate(zip(batch.column("hit_bits_").to_pylist(), batch.column("hit_items_").to_pylist())):
                    a, b = shard.bounds[i], shard.bounds[i + 1]
                    cover[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
                    items[i] = sorted({*items[i], *names})
            columns = [batch.column(c) for c in keep]
            if last:
                columns += _results(shard, cover, items)
            else:
                columns += [pa.array([np.packbits(cover[a:b]).tobytes() for a, b in zip(shard.bounds[:-1], shard.bounds[1:])], pa.binary()),
                            pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return docs.mapInArrow(run, out)


def _cover(shard: Shard, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which words stand inside an occurrence."""
    n = len(shard.words)
    edges = np.bincount(at, minlength=n + 1) - np.bincount(at + length, minlength=n + 1)
    return np.cumsum(edges)[:n] > 0


def _items(shard: Shard, block: Block, window: np.ndarray, at: np.ndarray, n: int) -> list[list[str]]:
    pairs = np.unique(shard.owner[at] * max(1, len(block.ids)) + block.item[block.start[window]])
    out: list[list[str]] = [[] for _ in range(n)]
    for pair in pairs.tolist():
        out[pair // len(block.ids)].append(block.ids[pair % len(block.ids)])
    return out


def _results(shard: Shard, cover: np.ndarray, items: list[list[str]]) -> list[pa.Array]:
    upto = np.concatenate([[0], np.cumsum(cover)])
    n_hit = upto[shard.bounds[1:]] - upto[shard.bounds[:-1]]
    none = hashlib.sha256(b"").hexdigest()
    digests = [hashlib.sha256(",".join(i).encode()).hexdigest() if i else none for i in items]
    return [pa.array(np.diff(shard.bounds), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()),
            pa.array(digests, pa.string()), pa.array(n_hit > 0, pa.bool_())]


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark window."""
    docs, back = guarded(docs, "text")
    return annotate(docs, benchmark, **options).where(~F.col("contaminated")).select(*back)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per item and document that share a window: where their longest verbatim match begins in each, and its words.

    Words are counted from 0. Of equally long matches the first in the item, then the first in the document, is given.
    """
    ship_package(docs.sparkSession)
    parts = []
    for block in blocks(benchmark, window, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shard, block = Shard(as_bytes(batch.column("text"))), shared.value
                found, at = shard.search(block)
                if not len(at):
                    continue
                test, length, active = block.start[found], block.length[found].copy(), np.arange(len(at))
                stop = shard.bounds[1:][shard.owner[at]]
                while len(active):      # extend all matches by a word at a time, as long as the words agree
                    inside = active[(test[active] + length[active] < block.end[test[active]]) & (at[active] + length[active] < stop[active])]
                    active = inside[block.words[test[inside] + length[inside]] == shard.words[at[inside] + length[inside]]]
                    length[active] += 1
                doc, item = shard.owner[at], block.item[test]
                order = np.lexsort((at, test, -length, item, doc))
                pair = doc[order] * len(block.ids) + item[order]
                best = order[np.concatenate([[True], pair[1:] != pair[:-1]])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.ids[i] for i in item[best].tolist()], pa.string()), pa.array(test[best] - block.first[test[best]], pa.int64()),
                     batch.column("doc_id").take(pa.array(doc[best])), pa.array(at[best] - shard.bounds[doc[best]], pa.int64()),
                     pa.array(length[best], pa.int64())], names=["item_id", "item_word", "doc_id", "doc_word", "n_words"])

        parts.append(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MATCH))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
