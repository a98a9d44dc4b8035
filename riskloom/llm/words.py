"""Words of many texts at once: numpy over the bytes of a batch, inside Spark tasks.

Texts are joined with a space, so that no word spans two of them; words are runs of the bytes that a table allows. A word's
hash is a polynomial over its bytes, read off a running sum, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20          # bytes of text handled at once; a longer text is one chunk
BLOCK = 1 << 18          # bytes over which arrays of numbers are held; a longer word is one block
_BASE = 0x9E3779B97F4A7C15
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

NOT_SPACE = np.ones(256, bool)                      # [^\x20\x09-\x0D]
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)                         # [^\x00-\x2F\x3A-\x60\x7B-\x7F]
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_BYTE = np.random.RandomState(20).randint(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, BLOCK + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
                        for b in (_BASE, inverse))
    return _powers


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist() if not pa.types.is_null(column.type) else [None] * len(column)


def chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"") + 1
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_chunks(column: pa.Array) -> Iterator[list[bytes | None]]:
    """The texts of a column, in order, in lists of about CHUNK bytes; only one list is made at a time."""
    if pa.types.is_null(column.type):
        if len(column):
            yield [None] * len(column)
        return
    column = column.cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start, before = 0, 0
    while start < len(column):
        stop = min(int(np.searchsorted(ends, before + CHUNK)) + 1, len(column))
        yield column.slice(start, stop - start).to_pylist()
        start, before = stop, int(ends[stop - 1])


def _blocks(data: np.ndarray, allowed: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK bytes that end where no word goes on."""
    start = 0
    while start < len(data):
        end = start + BLOCK
        while end < len(data):
            gaps = np.flatnonzero(~allowed[data[end:end + BLOCK]])
            if len(gaps):
                end += int(gaps[0])
                break
            end += BLOCK
        end = min(end, len(data))
        yield start, end
        start = end


def word_hashes(texts: list[bytes | None], allowed: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of the text that each stands in (rising)."""
    joined = b" ".join(t or b"" for t in texts)
    if lower:
        joined = joined.translate(_LOWER)
    data = np.frombuffer(joined, np.uint8)
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for start, end in _blocks(data, allowed):
        found, starts = _block_hashes(data[start:end], allowed)
        hashes.append(found)
        places.append(starts + start)
    offsets = np.cumsum([len(t or b"") + 1 for t in texts])
    return np.concatenate(hashes), np.searchsorted(offsets, np.concatenate(places), side="right")


def _block_hashes(data: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the words of a block."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = allowed[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    powers, inverses = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64)), starts


def all_word_hashes(texts: list[bytes | None], allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, chunk by chunk, so that only the words of a large batch are held, not arrays over its bytes."""
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in chunks(texts):
        h, d = word_hashes(texts[i:j], allowed)
        hashes.append(h)
        owners.append(d + i)
    return np.concatenate(hashes), np.concatenate(owners)


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes (63 bits) of its runs of `size` words; of fewer words, the one run of all."""
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    hashes, owner = word_hashes(texts, NOT_SPACE)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    total = max(0, len(hashes) - size + 1)
    runs = np.zeros(total, np.uint64)
    for k in range(size):
        runs += hashes[k:k + total] * factors[k]
    runs = mix(runs + np.uint64(size)) >> np.uint64(1)
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= size:
            own = np.sort(runs[a:b - size + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])].astype(np.int64))
        elif b > a:
            run = (hashes[a:b] * factors[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)
            sets.append((mix(run) >> np.uint64(1)).astype(np.int64))
        else:
            sets.append(np.zeros(0, np.int64))
    return sets
