"""Words of a block of UTF-8 texts, found and hashed with numpy and Arrow.

A word is a run of bytes other than space and \\x09-\\x0D. All offsets are bytes.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of the longest spans that Spans may hash, and that are mixed eight bytes at a time.
LONGEST_ROLLING, LONGEST_MIXED = 256, 64
_LEFT = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20_240_601)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose outputs look random."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Spans:
    """Hashes of byte spans of at most LONGEST_ROLLING bytes, each from two sums: for the
    prefixes of pieces. Longer spans could be chosen so that they collide."""

    def __init__(self, data: np.ndarray):
        n = 1 << max(16, len(data).bit_length())
        self.back = _powers(n, _INVERSE)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(n, _BASE)[: len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(h + (end - start).astype(np.uint64))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each offset of data, zeros behind its end."""
    return np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))


def quick_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time. Spans of 16 bytes can be made that
    share one, so only for tables that compare the bytes as well."""
    size = end - start
    out = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x9E3779B97F4A7C15))
    long = np.flatnonzero(size > LONGEST_MIXED)
    eights = _eights(data)
    at, done = np.flatnonzero((size > 0) & (size <= LONGEST_MIXED)), 0
    while len(at):
        rest = size[at] - done
        chunk = eights[start[at] + done] & _LEFT[np.minimum(rest, 8)]
        out[at] = mix((out[at] ^ chunk) * np.uint64(0x9FB21C651E98DF25) + np.uint64(done))
        at, done = at[rest > 8], done + 8
    if len(long):
        raw = data.tobytes()
        out[long] = [int.from_bytes(blake2b(raw[s:e], digest_size=8).digest(), "little") for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return out


def column(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.LargeBinaryArray:
    """Non-empty byte spans, in order and apart, as an Arrow column."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    kept = data[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))])


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each span: the halves of its bytes' 128-bit BLAKE2b, which is worked
    out once for each different span. Equal bytes have equal hashes wherever they stand; two
    spans that share one are as hard to make as for BLAKE2b cut to as many bits (2**32 and
    2**64 tries)."""
    found = column(data, start, end).dictionary_encode()
    raw = b"".join([blake2b(w, digest_size=16).digest() for w in found.dictionary.to_pylist()])
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)[found.indices.to_numpy(zero_copy_only=False)]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first of the ``digests``."""
    return np.ascontiguousarray(digests(data, start, end)[:, 0])


def same_spans(a: np.ndarray, start: np.ndarray, end: np.ndarray, b: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which spans of a have the bytes of their spans of b."""
    size = end - start
    out = size == stop - begin
    x, y = _eights(a), _eights(b)
    at, done = np.flatnonzero(out & (size > 0) & (size <= LONGEST_MIXED)), 0
    while len(at):
        rest = size[at] - done
        equal = ((x[start[at] + done] ^ y[begin[at] + done]) & _LEFT[np.minimum(rest, 8)]) == 0
        out[at] = equal
        at, done = at[equal & (rest > 8)], done + 8
    for i in np.flatnonzero(out & (size > LONGEST_MIXED)).tolist():
        out[i] = np.array_equal(a[start[i] : end[i]], b[begin[i] : stop[i]])
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the index of its first word (one more at the end)."""
    return runs(SPACE[data], offsets)


def runs(gap: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_spans``, of the longest runs of bytes that are no gap."""
    n = len(gap)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.ones(n + 1, bool)
    edge[1:] = np.append(gap[:-1], True)
    edge[offsets] = True
    start = np.flatnonzero(~gap & edge[:-1])
    edge[:-1] = gap
    edge[offsets] = True
    end = np.flatnonzero(~gap & edge[1:]) + 1
    return start, end, np.searchsorted(start, offsets)


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags within each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def windows(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of every window of ``size`` words within one text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if len(h) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = len(h) - size + 1
    out = np.full(last, np.uint64(size))
    for i in range(size):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + last])
    at = np.flatnonzero(text[:last] == text[size - 1 :])
    return out[at], text[at], at


def by_text(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The order that sorts by text, then hash. Texts are numbered below 65536."""
    order = np.argsort(h)
    return order[np.argsort(text[order].astype(np.uint16), kind="stable")]
