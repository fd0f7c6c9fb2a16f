"""Content-defined anchors: every window of ``length`` bytes has one, and equal windows have it at the same place."""

from __future__ import annotations

import numpy as np

from ._words import mixed

GRAM = 32
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE_BITS = np.uint64(31)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (b + _B) * _A) * _B
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 32 bytes and of the 128 bytes from each place on (shorter by so much at the end)."""
    b = data.astype(np.uint16)
    b2 = b[:-1] | b[1:] << np.uint16(8)
    b4 = b2[:-2].astype(np.uint32) | b2[2:].astype(np.uint32) << np.uint32(16)
    b8 = b4[:-4].astype(np.uint64) | b4[4:].astype(np.uint64) << np.uint64(32)
    h16 = _joined(b8[:-8], b8[8:])
    h32 = _joined(h16[:-16], h16[16:])
    h64 = _joined(h32[:-32], h32[32:])
    return h32, _joined(h64[:-64], h64[64:])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of window starts that share an anchor, for texts one after another in ``data`` (``offsets``: of each text).

    ``row`` the text, ``lo`` and ``hi`` the first and last start (within the text), ``at`` the anchor's place, ``gram``
    the hash of its 32 bytes, ``all`` a hash of the bytes ``lo .. hi + length`` and of where the anchor is in them.
    The anchor of a window is its 32-byte string with the least hash, the leftmost of equal ones.
    """
    n, w = len(data) - length + 1, length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return {"row": none, "lo": none, "hi": none, "at": none, "gram": none.view(np.uint64), "all": none.view(np.uint64)}
    h32, h128 = gram_hashes(data)
    key = (mixed(h32) >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(h32), dtype=np.uint64)
    # least of each w keys: the smaller of a block's tail and the next block's head
    pad = -len(key) % w
    blocks = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    best = (np.minimum(tail[:n], head[w - 1 : w - 1 + n]) & np.uint64((1 << 31) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + length <= offsets[1:][row]
    cut = np.concatenate([[True], (best[1:] != best[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])])
    lo = np.flatnonzero(cut)
    hi = np.append(lo[1:], n) - 1
    lo, hi = lo[inside[lo]], hi[inside[lo]]
    at = best[lo]
    whole = lambda s: _joined(h128[s], h128[s + length - 128])  # noqa: E731  for 128 <= length <= 256
    everything = _joined(_joined(whole(lo), whole(hi)), mixed(((at - lo) << 20 | (hi - lo)).astype(np.uint64)))
    start = offsets[row[lo]]
    return {"row": row[lo], "lo": lo - start, "hi": hi - start, "at": at - start, "gram": h32[at], "all": everything}
