"""Vectorised text primitives over Arrow string columns.

Everything works on the UTF-8 bytes of many texts at once: words are byte ranges, a word's hash is
a range of a polynomial prefix hash, and word k-grams are sums of word hashes. The separators and
case folding of all contracts are ASCII, so bytes and code points agree on where words stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_GRAM = _RNG.integers(1, 2**63, (8, 64), dtype=U64) * U64(2) + U64(1)
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 2**64)
_POW = np.ones(1, dtype=U64)
_IPOW = np.ones(1, dtype=U64)

#: Which bytes belong to words: all but ASCII white space; or ASCII letters, digits and non-ASCII.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Bytes with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _IPOW
    if len(_POW) < n:
        size = max(n, 1 << 20)
        for name, base in (("_POW", _R), ("_IPOW", _RINV)):
            a = np.full(size, base, dtype=U64)
            a[0] = 1
            globals()[name] = np.cumprod(a)
    return _POW[:n], _IPOW[:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finaliser that spreads 64-bit values over all bits."""
    h = h + U64((0xD1B54A32D192ED03 * (2 * salt + 1)) % 2**64)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Texts:
    """A run of whole texts: bytes, document offsets, and words as byte ranges.

    `bounds[d]:bounds[d+1]` are the words of document d, counted over the run.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, first: int, table: np.ndarray = NON_SPACE, lower: bool = False):
        self.raw, self.offs, self.first, self.n = buf, offs, first, len(offs) - 1
        self.buf = LOWER[buf] if lower else buf
        inside = table[self.buf]
        size = len(buf)
        begin, stop = inside.copy(), inside.copy()
        if size:
            begin[1:] &= ~inside[:-1]
            stop[:-1] &= ~inside[1:]
            at = offs[:-1][offs[:-1] < offs[1:]]
            begin[at] = inside[at]
            at = offs[1:][offs[:-1] < offs[1:]] - 1
            stop[at] = inside[at]
        self.inside = inside
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(stop) + 1
        self.bounds = np.searchsorted(self.starts, offs)
        self._prefix = None

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            c = np.empty(len(self.buf) + 1, dtype=U64)
            c[0] = 0
            np.cumsum(_BYTE[self.buf] * _powers(len(self.buf))[0], out=c[1:])
            self._prefix = c
        return self._prefix

    def range_hash(self, s: np.ndarray, e: np.ndarray, salt: int = 0) -> np.ndarray:
        """64-bit hash of the bytes s:e of each range."""
        inverse = _powers(len(self.buf) + 1)[1]
        return mix((self.prefix[e] - self.prefix[s]) * inverse[s] + (e - s).astype(U64) * _GRAM[7, 1], salt)

    def words(self) -> np.ndarray:
        return self.range_hash(self.starts, self.ends)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.bounds))


def grams(words: np.ndarray, docs: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows that lie in one document, and the index of their first words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U64), np.empty(0, dtype=np.int64)
    at = np.flatnonzero(docs[:n] == docs[k - 1 :])
    acc = np.zeros(n, dtype=U64)
    for j in range(k):
        acc += words[j : n + j] * _GRAM[seed, j]
    return mix(acc[at], seed + 1), at


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(array: pa.Array, table: np.ndarray = NON_SPACE, lower: bool = False, limit: int = 1 << 20) -> Iterator[Texts]:
    """The texts of a string column in runs of about `limit` bytes; a longer text is a run of its own. Null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    n = len(array)
    if not n:
        return
    offs = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + n + 1]
    data = array.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield Texts(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lo, table, lower)
        lo = hi


def pack(a: np.ndarray) -> bytes:
    """Byte planes of an integer array; planes of small values compress well in the shuffle."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def unpack(b: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(b, dtype=np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def pack_rising(a: np.ndarray) -> bytes:
    """Byte planes of the steps of a rising uint32 array."""
    return pack(np.diff(a, prepend=np.zeros(1, dtype=a.dtype)).astype(np.uint32))


def unpack_rising(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint32), dtype=np.int64)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices in rising order) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    ranked = bucket[order]
    cuts = np.flatnonzero(np.diff(ranked)) + 1
    if len(ranked):
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(ranked)], strict=True):
            yield int(ranked[lo]), order[lo:hi]


def binaries(table: pa.Table | pa.RecordBatch, name: str) -> list[bytes]:
    return table.column(name).to_pylist()


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
