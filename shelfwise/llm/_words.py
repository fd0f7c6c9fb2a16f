"""Vectorised words and word shingles over Arrow string arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)


def texts_of(column: pa.Array) -> pa.Array:
    """A string array with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that the texts of a piece hold about ``max_bytes`` (one text is never cut)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - 1) // max_bytes
    cuts = np.flatnonzero(np.diff(group)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(lo, hi - lo)
    release()


def release() -> None:
    """Gives memory that is free in this worker back: workers live through many stages, beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another, and the row offsets into them (length rows + 1)."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mapped(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """Each byte of each text through a 256-entry table; only for tables that keep bytes of 0x80 and above."""
    data, offsets = raw_bytes(texts)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(table[data]))


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: the code of each word in order, the distinct words, and the words of each row."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets -= offsets[0]
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate([[0], np.cumsum(full)])
    counts = np.diff(before[offsets])
    if not full.all():
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, counts


def hashes_of(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x, seed=seed) for x in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * _MIX2
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` word hashes, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        h ^= words[j : j + n]
        h *= _MIX
        h ^= h >> np.uint64(31)
    return mixed(h)


def shingles_of(words: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles of each row in order, and their number per row.

    A row of 1 to k - 1 words has its whole sequence as one shingle; a row without words has none.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    out = np.empty(int(sizes.sum()), dtype=np.uint64)
    to = np.cumsum(sizes) - sizes
    whole = rolling(words, k)
    long_rows = counts >= k
    if long_rows.any():
        take = np.repeat(starts[long_rows] - (np.cumsum(sizes[long_rows]) - sizes[long_rows]), sizes[long_rows]) + np.arange(int(sizes[long_rows].sum()))
        put = take if long_rows.all() and len(whole) == len(out) else np.repeat(to[long_rows] - (np.cumsum(sizes[long_rows]) - sizes[long_rows]), sizes[long_rows]) + np.arange(int(sizes[long_rows].sum()))
        out[put] = whole[take]
    for n in range(1, k):
        rows = np.flatnonzero(counts == n)
        if len(rows):
            out[to[rows]] = rolling(words, n)[starts[rows]]
    return out, sizes


def sets_of(hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each row."""
    ends = np.cumsum(sizes)
    return [np.unique(hashes[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
