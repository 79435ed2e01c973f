"""Vectorised word splitting and hashing over batches of texts.

A batch of texts becomes one byte buffer (ASCII letters lower-cased, one separator byte after each text), and words,
word hashes and shingle hashes are computed for the whole buffer with numpy, so the cost per word is a few array
operations instead of a Python object.  Hashes are 64-bit and depend on content only, never on the batch.
"""

from __future__ import annotations

import numpy as np

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_RADIX = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _M3)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Powers:
    """Powers of the radix and of its inverse, grown on demand and kept by the worker."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            inverse = pow(_RADIX, -1, 1 << 64)
            with np.errstate(over="ignore"):
                for name, base in (("up", _RADIX), ("down", inverse)):
                    out = np.full(size, np.uint64(base))
                    out[0] = 1
                    setattr(cls, name, np.multiply.accumulate(out))
        return cls.up, cls.down


def trim() -> None:
    """Gives free memory back, so that workers that wait for their next task leave it to the others."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches, rows: int = 1024):
    """Arrow batches in slices of at most so many rows, so that what a task holds as Python objects stays small."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    trim()


def batches(texts: list, limit: int = 1 << 20, lower: bool = True):
    """(first, last, texts as bytes): runs of texts of about `limit` bytes; a longer text is a run of its own.  A null
    text is an empty one; with `lower`, A-Z become a-z."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        raw = raw.lower() if lower else raw
        if held and size + len(raw) > limit:
            yield start, i, held
            start, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield start, len(texts), held


def words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words (runs of bytes other than ASCII white space) of all texts in order: the buffer, where words start and
    end in it, their hashes, and where each text's words begin among them (one entry more than texts)."""
    buf = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    lens = np.fromiter((len(r) + 1 for r in raws), np.int64, len(raws))
    space = _SPACE[buf]
    edge = np.empty(len(buf), bool)
    edge[0] = not space[0]
    np.logical_and(space[:-1], ~space[1:], out=edge[1:])
    starts = np.flatnonzero(edge)
    edge[0] = False
    np.logical_and(~space[:-1], space[1:], out=edge[1:])
    ends = np.flatnonzero(edge)
    up, down = Powers.get(len(buf) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M3)
    bounds = np.zeros(len(raws) + 1, np.int64)
    bounds[1:] = np.searchsorted(starts, np.cumsum(lens))
    return buf, starts, ends, hashes, bounds


def shingle_sets(raws: list[bytes], n: int):
    """For each text the sorted distinct hashes of its n-word shingles; a text of fewer words has one shingle, its whole
    sequence, and a text without words has none."""
    *_, words_, bounds = words(raws)
    with np.errstate(over="ignore"):
        rolled = words_ * _M1
        if len(words_) >= n:
            rolled = np.zeros(len(words_) - n + 1, np.uint64)
            for k in range(n):
                rolled = rolled * _M2 + mix(words_[k : k + len(rolled)] + np.uint64(k))
            rolled = mix(rolled)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= n:
            yield np.unique(rolled[a : b - n + 1])
        elif b > a:
            with np.errstate(over="ignore"):
                whole = np.uint64(b - a)
                for w in words_[a:b]:
                    whole = whole * _M3 + w
            yield mix(np.array([whole], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
