"""Vectorised text helpers used inside Spark tasks (numpy over UTF-8 bytes).

A chunk is a run of documents held as one byte buffer with document offsets.
Word hashes come from prefix sums of a polynomial modulo 2**64, so no Python
loop runs over words or characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
PIECE = 1 << 20            # bytes hashed at once; bounds the temporary arrays
CHUNK = 1 << 20            # bytes of text per chunk of whole documents
WHITESPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

_powers: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below PIECE."""
    if not _powers:
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(PIECE, base, U64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64 constants): spreads every input bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def whitespace_words() -> np.ndarray:
    table = np.ones(256, bool)
    table[list(WHITESPACE)] = False
    return table


def alnum_words() -> np.ndarray:
    """ASCII letters and digits and every byte of a non-ASCII character."""
    table = np.zeros(256, bool)
    table[128:] = True
    for lo, hi in ((48, 58), (65, 91), (97, 123)):
        table[lo:hi] = True
    return table


def ascii_fold() -> np.ndarray:
    """Byte values plus one, A-Z as a-z (plus one: no byte counts as nothing)."""
    table = np.arange(256, dtype=U64) + U64(1)
    table[65:91] += U64(32)
    return table


FOLD = ascii_fold()


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] per span; values are at most PIECE long."""
    p, inv = powers()
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * p[:len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[np.minimum(starts, PIECE - 1)])


def words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, hash, document index) of every word; words end at document
    borders. Hashes ignore the case of A-Z."""
    flag = is_word[buf]
    n = len(buf)
    before = np.zeros(n + 1, bool)
    before[1:] = flag
    before[offsets[offsets < n]] = False
    starts = np.flatnonzero(flag & ~before[:n])
    after = np.zeros(n + 1, bool)
    after[:n] = flag
    after[offsets] = False
    ends = np.flatnonzero(flag & ~after[1:]) + 1
    hashes = np.empty(len(starts), U64)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        if ends[hi - 1] - base > PIECE:          # one word longer than a piece
            hashes[lo] = long_hash(buf[base:ends[lo]])
            hi = lo + 1
        else:
            hashes[lo:hi] = span_hashes(FOLD[buf[base:ends[hi - 1]]], starts[lo:hi] - base, ends[lo:hi] - base)
        lo = hi
    return starts, ends, hashes, np.searchsorted(offsets, starts, "right") - 1


def long_hash(part: np.ndarray) -> int:
    h = U64(0)
    with np.errstate(over="ignore"):
        for i in range(0, len(part), PIECE):
            piece = FOLD[part[i:i + PIECE]]
            h = mix(np.array([h * U64(BASE)], U64) + span_hashes(piece, np.array([0]), np.array([len(piece)])))[0]
    return h


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (order matters)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, k, U64)
    for i in range(k):
        out = out * U64(BASE) + hashes[i:i + n]
    return mix(out)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; a shorter text is one shingle of all its words."""
    if not len(hashes):
        return np.zeros(0, U64)
    return np.unique(shingles(hashes, min(k, len(hashes))))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (rebased to 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0]:offsets[-1]], offsets - offsets[0]


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:                                  # glibc only
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK
           ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Whole documents in chunks of about ``limit`` bytes: (rows, bytes, offsets). A task that has read all
    of them gives its free memory back, since the worker stays for the tasks of later stages."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo), buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
            lo = hi
    release_memory()
