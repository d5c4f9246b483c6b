"""Words and rolling hashes of an Arrow column of texts, over its bytes, with NumPy.

A word is a maximal run of bytes other than space and tab to carriage return. All hashes are 64 bits and depend on content only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOW_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], np.uint64)
# Odd multipliers of the hashes (arbitrary, fixed so that reruns agree).
M1, M2, BASE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
CHUNK = 1 << 15  # entries worked on at once, so that what is in between stays in the cache


def chunks(n: int):
    """Bounds (a, b) of consecutive runs of at most CHUNK of n entries."""
    return ((a, min(a + CHUNK, n)) for a in range(0, n, CHUNK))


def _mix_in_place(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= M1
    h ^= h >> np.uint64(33)
    h *= M2
    h ^= h >> np.uint64(33)
    return h


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit words over the word."""
    out = np.array(h, np.uint64, order="C")
    flat = out.reshape(-1)
    for a, b in chunks(len(flat)):
        _mix_in_place(flat[a:b])
    return out


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one behind the other, and the n + 1 offsets; a null text has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.Array, most: int = 2 << 20):
    """Slices (first, past) of consecutive texts of about ``most`` bytes; a longer text is a slice of its own."""
    _, offsets = joined(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        past = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(past, n)
        first = past


def loads(raw: np.ndarray) -> np.ndarray:
    """At each byte the little-endian 64-bit word that starts there (zeros behind the end)."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))


@dataclass
class Words:
    """Words of several texts: byte bounds in ``raw``, hash, and the index of each text's first word (n + 1 entries)."""

    raw: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts: pa.Array, lower: bool = False) -> Words:
    raw, offsets = joined(texts)
    if lower:
        raw = LOWER[raw]
    solid = ~SPACE[raw]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    begin[inner] = solid[inner]
    end[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(raw, offsets, starts, ends, np.searchsorted(starts, offsets), spans_hash(raw, starts, ends))


def spans_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, eight at a time."""
    at, left = loads(raw), ends - starts
    out = mix((left.astype(np.uint64) + np.uint64(1)) * BASE)
    live, pos = np.arange(len(starts)), starts
    while len(live):
        n = left[live]
        out[live] = mix(out[live] * M1 + (at[pos] & _LOW_BYTES[np.minimum(n, 8)]))
        go = n > 8
        live, pos = live[go], pos[go] + 8
        left[live] -= 8
    return out


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive values: the polynomial in BASE of the values, modulo 2**64."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, scaled, last = np.empty(n, np.uint64), np.empty(min(CHUNK, n) + k - 1, np.uint64), min(CHUNK, n)
    up, down = powers(len(scaled), BASE)[:-1], powers(last, BASE_INVERSE)[:-1]
    sums = np.zeros(len(scaled) + 1, np.uint64)
    for a, b in chunks(n):  # the polynomial of a run does not depend on where its chunk starts
        m = b - a
        np.multiply(values[a : b + k - 1], up[: m + k - 1], out=scaled[: m + k - 1])
        np.cumsum(scaled[: m + k - 1], out=sums[1 : m + k])
        np.subtract(sums[k : m + k], sums[:m], out=out[a:b])
        out[a:b] *= down[:m]
        _mix_in_place(out[a:b])
    return out


def within(first: np.ndarray, k: int) -> np.ndarray:
    """Of the windows of k over all units, those that stay inside one text (mask over window starts)."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(first[-1])
    return left[:n] >= k


def chosen(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each run of w consecutive hashes the index of its least one (by the upper 32 bits), the leftmost among equals.

    Gives len - w + 1 entries. What is chosen depends on the w hashes alone, so equal contents choose the same place.
    """
    n = len(hashes)
    if n < w:
        return np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    out = np.empty(n - w + 1, np.int64)
    for a, b in chunks(len(out)):
        keys, span = (hashes[a : b + w - 1] & ~low) | np.arange(a, b + w - 1, dtype=np.uint64), 1
        while span * 2 <= w:
            keys, span = np.minimum(keys[:-span], keys[span:]), span * 2
        out[a:b] = np.minimum(keys[: b - a], keys[w - span : w - span + b - a]) & low
    return out


def runs(sorted_ids: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the length."""
    if not len(sorted_ids):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_ids[1:] != sorted_ids[:-1]) + 1, [len(sorted_ids)]])


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = runs(keys)
    return keys[at[:-1]], np.diff(at)


def covered(starts: np.ndarray, width: np.ndarray | int, n: int) -> np.ndarray:
    """Mask of the n places that lie in some [start, start + width)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return np.cumsum(change[:-1]) > 0
