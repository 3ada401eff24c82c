"""Words of many texts at once, as places in one byte buffer, and their 64-bit hashes (xxhash64), in NumPy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash

CHUNK_BYTES = 4 << 20
#: Fixed values of xxhash64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words, once A-Z are lower-cased: letters and digits of ASCII and all of other scripts; or all but white space.
ALNUM = np.r_[np.zeros(48, bool), np.ones(10, bool), np.zeros(39, bool), np.ones(26, bool), np.zeros(5, bool), np.ones(128, bool)]
NOT_WHITE = ~np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


@dataclass
class Words:
    """Words stand in `buf` one after the other, a space between; `first` tells where each text's words begin (one more
    than there are texts)."""

    buf: np.ndarray
    start: np.ndarray
    size: np.ndarray
    first: np.ndarray

    def grams(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, size and text of every run of `width` words of one text."""
        n = np.diff(self.first)
        runs = np.maximum(n - width + 1, 0)
        text = np.repeat(np.arange(len(n)), runs)
        at = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + self.first[:-1][text]
        last = at + width - 1
        return self.start[at], self.start[last] + self.size[last] - self.start[at], text


def split(texts: list[str | None], word: np.ndarray = ALNUM) -> Words:
    """Words of the texts, A-Z lower-cased; null texts have none."""
    raws = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    low = LOWER[np.frombuffer(b"\n".join([*raws, b""]), dtype=np.uint8)]
    inside = word[low]
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    start, end = edges[::2], edges[1::2]
    begins = np.cumsum([0, *(len(r) + 1 for r in raws)])
    size = end - start
    inside[end] = True  # and the separator after each word
    buf = low[inside]
    placed = np.cumsum(size + 1)
    buf[placed - 1] = 32
    return Words(np.r_[buf, np.zeros(8, np.uint8)], placed - size - 1, size, np.searchsorted(start, begins))


def lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; buf ends with eight spare bytes."""
    return np.ndarray((len(buf) - 7,), dtype="<u8", buffer=np.ascontiguousarray(buf), strides=(1,))


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """xxhash64 of each run of bytes; those of 32 bytes and more go one by one."""
    lane = lanes(buf)
    h = P5 + size.astype(np.uint64)
    short = np.flatnonzero(size < 32)
    for k in range(3):
        at = short[size[short] >= 8 * k + 8]
        h[at] = _rotated(h[at] ^ (_rotated(lane[start[at] + 8 * k] * P2, 31) * P1), 27) * P1 + P4
    done = size // 8 * 8
    at = short[size[short] - done[short] >= 4]
    h[at] = _rotated(h[at] ^ ((lane[start[at] + done[at]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    done[at] += 4
    for k in range(3):
        at = short[size[short] - done[short] > k]
        h[at] = _rotated(h[at] ^ (buf[start[at] + done[at] + k].astype(np.uint64) * P5), 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(size >= 32):
        h[k] = xxhash.xxh64_intdigest(buf[start[k] : start[k] + size[k]].tobytes())
    return h


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the runs at a and b, of the same size, hold the same bytes."""
    lane, same = lanes(buf), np.ones(len(a), dtype=bool)
    for k in range(8):
        at = np.flatnonzero(size > 8 * k)
        left = np.minimum(size[at] - 8 * k, 8).astype(np.uint64)
        unused = (np.uint64(8) - left) * np.uint64(8)
        same[at] &= ((lane[a[at] + 8 * k] ^ lane[b[at] + 8 * k]) << unused) == 0
    for k in np.flatnonzero(size > 64):
        same[k] &= buf[a[k] : a[k] + size[k]].tobytes() == buf[b[k] : b[k] + size[k]].tobytes()
    return same


def chunks(batches: Iterator[pd.DataFrame], text: str, most: int = CHUNK_BYTES) -> Iterator[pd.DataFrame]:
    """The batches in parts of about `most` characters of text, so that memory follows the longest text, not the batch."""
    for b in batches:
        upto = b[text].map(lambda t: len(t or "") + 1).cumsum().to_numpy()
        lo = 0
        while lo < len(b):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
            yield b.iloc[lo:hi]
            lo = hi
