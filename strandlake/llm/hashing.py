"""64-bit hashes computed with numpy, alike in every worker."""

from __future__ import annotations

import numpy as np
import xxhash

#: Spans of more bytes than this are hashed one by one; few words are that long.
_LANE, _LONG = 8, 64
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(_LANE + 1)], dtype=np.uint64)


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """Bijective scrambling of 64-bit words (two multiply-xorshift rounds)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _lanes(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every place of a byte array as one word, with zeros after its end."""
    padded = np.zeros(len(data) + _LANE, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of data[first:last] for every span of a byte array, and a mark to tell different spans of one hash apart.

    A span is read eight bytes at a time; every step scrambles what it has with the next bytes, so where bytes stand
    matters as much as which they are. Spans of more than 64 bytes are hashed by XXH3. The mark is made of the length,
    the first and the last eight bytes, without the hash: to be taken for each other, two different spans need one hash
    and agree in all of these.
    """
    lanes, size = _lanes(data), last - first
    head = lanes[first] & _MASK[np.minimum(size, _LANE)]
    tail = lanes[np.maximum(last - _LANE, first)] & _MASK[np.minimum(size, _LANE)]
    with np.errstate(over="ignore"):
        mark = head * np.uint64(0x9E3779B97F4A7C15) + tail * np.uint64(0xC2B2AE3D27D4EB4F) + size.astype(np.uint64)
        out = mix64(head ^ (size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), 1)
    short = size <= _LONG
    left = np.flatnonzero((size > _LANE) & short)
    for at in range(_LANE, _LONG, _LANE):
        if not len(left):
            break
        rest = np.minimum(size[left] - at, _LANE)
        out[left] = mix64(out[left] ^ (lanes[first[left] + at] & _MASK[rest]), 2)
        left = left[size[left] > at + _LANE]
    if not short.all():
        for i in np.flatnonzero(~short).tolist():
            out[i] = xxhash.xxh3_64_intdigest(data[first[i] : last[i]].tobytes())
    return out, mark
