"""Vectorised words and 64-bit hashes over the raw bytes of an Arrow string column.

Words never become Python objects: a chunk of whole documents is one byte array, words are pairs of offsets and
each word is a 64-bit polynomial over a table of random byte values, so equal words always have equal hashes and
different ones collide with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20



def tidy(task: Callable) -> Callable:
    """The same Arrow function, giving back what it freed when it ends: a worker goes on to other tasks, beside the JVM."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release()
    return run


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies on this machine; asked for in tasks, so every executor finds its own."""
    import public_tokenizers

    return public_tokenizers.path(name)


RELEASE_SECONDS = 1.0  # small groups follow one another faster than memory could pile up
_released = 0.0


def release() -> None:
    global _released
    if time.monotonic() - _released < RELEASE_SECONDS:
        return
    _released = time.monotonic()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        return


_BYTES = np.arange(256)
LOWER = _BYTES.astype(np.uint8)
LOWER[65:91] += 32
# Words are what is not white space (space and the characters 9 to 13) ...
NOT_SPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
# ... or letters, digits and everything beyond ASCII.
ALNUM = (((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90))
         | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128))

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_RANDOM = np.random.Generator(np.random.PCG64(20240917)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _RANDOM[LOWER]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    """Words of some consecutive documents, in order."""

    first: int  # row of the first document in its batch
    buf: np.ndarray  # bytes of the documents
    bounds: np.ndarray  # documents + 1 byte offsets into buf
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray
    at: np.ndarray  # documents + 1 offsets into starts
    hashes: np.ndarray | None = None

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.at)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.n)


def byte_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of whole rows; nulls are empty, a longer row is a chunk of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        yield row, whole[bounds[row]:bounds[last]], bounds[row:last + 1] - bounds[row]
        row = last


def split_words(first: int, buf: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> Words:
    """Maximal runs of bytes the table marks, never across documents."""
    inside = table[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[bounds] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    if len(buf):
        word = inside[starts]
        starts, ends = starts[word], ends[word]
    else:
        starts, ends = starts[:0], ends[:0]
    return Words(first, buf, bounds, starts, ends, np.searchsorted(starts, bounds))


def hash_words(words: Words, fold: bool = True) -> np.ndarray:
    """One 64-bit value per word, letters A-Z folded if asked."""
    powers, inverse = _power_tables(len(words.buf) + 1)
    sums = np.empty(len(words.buf) + 1, np.uint64)
    sums[0] = 0
    terms = (_FOLDED if fold else _RANDOM)[words.buf]
    terms *= powers[:-1]
    np.cumsum(terms, out=sums[1:])
    h = sums[words.ends]
    h -= sums[words.starts]
    h *= inverse[words.starts]
    return mix(h)


def hash_one(word: str) -> int:
    """The hash of a single folded word, as hash_words gives it."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hash_words(Words(0, raw, np.array([0, len(raw)]), np.array([0]), np.array([len(raw)]), np.array([0, 1])))[0])


def words_of(column: pa.Array, table: np.ndarray, fold: bool = True, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """Hashed words of a whole column, a bounded run of documents at a time."""
    for first, buf, bounds in byte_chunks(column, limit):
        words = split_words(first, buf, bounds, table)
        words.hashes = hash_words(words, fold)
        yield words


_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of `width` words; a document of fewer, but not none, is one run."""
    h, n, at = words.hashes, words.n, words.at
    doc = words.doc_of_word()
    if len(h) >= width:
        whole = h[:len(h) - width + 1].copy()
        for k in range(1, width):
            whole *= _STEP
            whole += h[k:len(h) - width + 1 + k]
        same = doc[:len(whole)] == doc[width - 1:]
        whole, owner = mix(whole[same]), doc[:len(whole)][same]
    else:
        whole, owner = h[:0], doc[:0]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        few = np.array([_run(h[at[d]:at[d + 1]]) for d in short], np.uint64)
        whole, owner = np.concatenate([whole, mix(few)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        whole, owner = whole[order], owner[order]
    return whole, owner


def _run(h: np.ndarray) -> int:
    value = 0
    for x in h.tolist():
        value = (value * int(_STEP) + x) & 0xFFFFFFFFFFFFFFFF
    return value
