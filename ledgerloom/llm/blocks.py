"""Sorted keys sent to parts of the key range as compressed blocks, and answered in the order sent.

Where a corpus has more keys than rows that Spark shuffles well, a batch of documents sends one block
for each part of the key range it has keys in. A part sees one entry per key and batch, however many
documents share the key.
"""

from __future__ import annotations

import numpy as np


def squeeze(a: np.ndarray) -> bytes:
    """An array, byte plane by byte plane, compressed."""
    import zstandard

    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def sorted_out(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def sorted_in(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, np.uint64), dtype=np.uint64)


def cuts(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of the sorted keys in each part of the range that has any."""
    if not len(keys):
        return []
    of = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    starts = np.flatnonzero(np.diff(of, prepend=np.uint64(parts)) != 0)
    return [(int(of[a]), int(a), int(b)) for a, b in zip(starts, np.append(starts[1:], len(keys)), strict=True)]


def grouped(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Of all keys in a part's blocks: their order, where each group of equal keys begins, and the blocks' lengths."""
    sent = [sorted_in(b) for b in blocks]
    keys = np.concatenate(sent)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))), [len(s) for s in sent]


def spread(values: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each group's value, in the order sent."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, np.diff(starts, append=len(order)))
    return out


def order_of(keys: np.ndarray) -> np.ndarray:
    """The places of whole numbers (none below 0) in their order, equal ones as they stand.

    Numbers sort several times faster than places by numbers, so that places are sorted below the keys' highest bits.
    """
    bits = len(keys).bit_length()
    top = int(keys.max()).bit_length() if len(keys) else 0
    cut = max(0, top + bits - 64)
    place = np.arange(len(keys), dtype=np.uint64)
    packed = np.sort((keys.astype(np.uint64) >> np.uint64(cut)) << np.uint64(bits) | place)
    order = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    if cut:  # keys that differ in the bits left out alone may stand wrong
        k = keys[order]
        if (k[1:] < k[:-1]).any():
            return np.argsort(keys, kind="stable")
    return order


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct of whole numbers in order, where each is first, and the number of each key's."""
    order = order_of(keys)
    k = keys[order]
    first = np.ones(len(k), bool)
    np.not_equal(k[1:], k[:-1], out=first[1:])
    number = np.empty(len(k), np.int64)
    number[order] = np.cumsum(first) - 1
    return k[first], order[first], number
