"""Vectorised text primitives over Arrow string columns.

The operators that need byte or word level work read Arrow batches and hand
them to these helpers, which see a column as one byte buffer plus offsets.
Nothing here makes a Python object for a word: words are (start, end, 64-bit
hash) arrays.  Work is cut into blocks of a few MB, so memory follows the
longest single text rather than the batch.  A null text counts as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
#: Bytes of a text that arrays of eight bytes for each of them are made over at once.
STEP = 1 << 22

_LIBC = ctypes.CDLL(None)
_U = np.uint64
_rng = np.random.default_rng(0x5EED)
#: A random 64-bit value for each byte; word and gram hashes are built from it.
BYTE_VALUES = _rng.integers(0, 2**64, 256, dtype=_U)
_ODD = _U(0x9E3779B97F4A7C15)


def _table(pairs: list[tuple[int, int]]) -> np.ndarray:
    t = np.zeros(256, bool)
    for lo, hi in pairs:
        t[lo : hi + 1] = True
    return t


#: ASCII letters A-Z to a-z; every other byte stays.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes of words [^\x20\x09-\x0D]+ .
NOT_SPACE = ~_table([(0x20, 0x20), (0x09, 0x0D)])
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of texts whose A-Z are lower case.
ALNUM = ~_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (murmur finaliser)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    c = batch.column(batch.schema.get_field_index(name))
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the n + 1 offsets into them; null is empty."""
    a = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes; one longer text is a block of its own. After the last, memory that is free goes back to the system."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
    give_back()


def give_back() -> None:
    """Return what the allocators hold for later: a worker that waits for its next stage should be small."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


class Words:
    """Words of a block of texts: ``start``, ``end`` (bytes in the block), ``hash``, and ``first`` (n + 1 offsets of each text's words)."""

    __slots__ = ("buf", "start", "end", "hash", "first")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, wordbytes: np.ndarray = NOT_SPACE):
        base = offsets[0]
        buf, offsets = buf[base : offsets[-1]], offsets - base
        self.buf = buf
        inside = wordbytes[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = (self.end - self.start).astype(_U)
        past = 0
        for a in range(0, len(buf), STEP):  # a word may lie over several steps
            at = np.flatnonzero(inside[a : a + STEP])
            if len(at):
                begun = np.cumsum(begins[a : a + STEP])
                word = past - 1 + begun[at]
                past += int(begun[-1])
                value = BYTE_VALUES[FOLD[buf[a : a + STEP][at]]] * _power(at + a - self.start[word])
                first = np.flatnonzero(np.diff(word, prepend=-1))
                self.hash[word[first]] += np.add.reduceat(value, first)
        self.hash = mix(self.hash)

    @property
    def text_of(self) -> np.ndarray:
        """For each word, its text's row in the block."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def hashes(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each string of a buffer, upper and lower case told apart."""
    size = np.diff(offsets)
    buf, at = buf[offsets[0] : offsets[-1]], offsets - offsets[0]
    value = BYTE_VALUES[buf] * _power(np.arange(len(buf)) - np.repeat(at[:-1], size))
    total = np.concatenate([np.zeros(1, _U), np.cumsum(value, dtype=_U)])
    return mix(total[at[1:]] - total[at[:-1]] + size.astype(_U))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in as many bytes as the greatest needs, all lowest bytes first."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(held: bytes) -> np.ndarray:
    planes = np.frombuffer(held, np.uint8, offset=1).reshape(held[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : held[0]] = planes.T
    return out.view("<u8").ravel().astype(_U, copy=False)


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers, most of them small, in seven-bit groups, compressed."""
    v = values.astype(_U)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= _U(1 << (7 * k))
    out = np.zeros(int(size.sum()), np.uint8)
    at = np.cumsum(size) - size
    for k in range(int(size.max(initial=0))):
        m = size > k
        out[at[m] + k] = ((v[m] >> _U(7 * k)) & _U(127)).astype(np.uint8) | np.where(size[m] > k + 1, 128, 0).astype(np.uint8)
    return len(out).to_bytes(8, "little") + pa.compress(out.tobytes(), "zstd", asbytes=True)


def unsqueezed(held: bytes) -> np.ndarray:
    n = int.from_bytes(held[:8], "little")
    b = np.frombuffer(pa.decompress(held[8:], n, "zstd", asbytes=True), np.uint8)
    if not n:
        return np.zeros(0, np.int64)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(n) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127).astype(_U) << (7 * place).astype(_U), first).astype(np.int64)


#: Powers of the multiplier up to the 2^16th, and powers of that.
_LOW = np.multiply.accumulate(np.concatenate(([_U(1)], np.full((1 << 16) - 1, _ODD, _U))))
_HIGH = np.multiply.accumulate(np.concatenate(([_U(1)], np.repeat(_LOW[-1:] * _ODD, (1 << 16) - 1))))


def _power(n: np.ndarray) -> np.ndarray:
    """The n-th powers of the multiplier, for n below 2^32."""
    found = _LOW[n & 0xFFFF]
    big = n > 0xFFFF
    if big.any():
        found[big] *= _HIGH[n[big] >> 16]
    return found


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive word hashes (len(h) - size + 1 of them, at least none)."""
    n = max(len(h) - size + 1, 0)
    out = h[:n].copy()
    for i in range(1, size):
        out = mix(out) * _ODD + h[i : i + n]
    return mix(out)


def distinct(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (group, key) pairs, sorted by group, then key; ``group`` is sorted already."""
    if not len(keys):
        return keys, group
    order = np.lexsort((keys, group))
    k, g = keys[order], group[order]
    keep = np.ones(len(k), bool)
    keep[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
    return k[keep], g[keep]
