"""Vectorised word splitting and hashing for Arrow string columns.

Words are maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``, so a
UTF-8 text is split without decoding it.  Every helper works on one Arrow
batch (or a slice of it) inside a task; nothing here holds more than the texts
of one slice plus a few words-long arrays.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text hashed at a time, and bytes of text in a slice of a batch.
BLOCK = 1 << 20
SLICE_BYTES = 1 << 20
#: Bytes of the longest word with a polynomial hash; much longer ones could be built to collide modulo 2^64.
LONGEST = 255

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_NO_LETTER = np.zeros(256, dtype=bool)
_NO_LETTER[:128] = [not chr(c).isalpha() for c in range(128)]
_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_ORDER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 4096), base, dtype=np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(have, dtype=np.uint64)
        if n <= BLOCK + 4096:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; overflow wraps."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n codes from each place on, in a constant number of passes for any n."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, step = np.empty(m, dtype=np.uint64), BLOCK // 8
    for i in range(0, m, step):
        k = min(step, m - i)
        size = k + n - 1
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(codes[i : i + size] * _power_table(_BASE, size)[:size], out=total[1:])
        out[i : i + k] = mix((total[n:] - total[:k]) * _power_table(_INVERSE, size)[:k])
    return out


class Words:
    """The words of the texts of one slice.

    ``begin``/``end`` are byte positions in ``data``, ``code`` the 64-bit hash of
    each word, and text i has the words ``ptr[i]:ptr[i + 1]``.  With ``letters`` words are
    runs of ASCII letters and of non-ASCII characters instead.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, letters: bool = False):
        if texts.null_count:
            texts = texts.fill_null("")
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * texts.offset)
        low, high = int(offsets[0]), int(offsets[-1])
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, dtype=np.uint8)[low:high] if raw is not None and high > low else np.zeros(0, np.uint8)
        self.offsets = offsets - low
        text = ~(_NO_LETTER if letters else _SPACE)[self.data]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(text))]
        first = text.copy()
        first[1:] &= ~text[:-1]
        first[cuts] = text[cuts]
        last = text.copy()
        last[:-1] &= ~text[1:]
        last[cuts - 1] = text[cuts - 1]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.ptr = np.searchsorted(self.begin, self.offsets)
        self._table = _LOWER if lower else _BYTE
        self.code = self._hash(self.end)

    def with_prefixes(self, *sizes: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each word and of its first bytes for each size, and where those of each text begin."""
        parts = [self.code, *(self._hash(np.minimum(self.end, self.begin + n)) + U64(n) for n in sizes)]
        return np.column_stack(parts).ravel(), self.ptr * len(parts)

    def _hash(self, ends: np.ndarray) -> np.ndarray:
        out, i, n = np.empty(len(self.begin), dtype=np.uint64), 0, len(self.begin)
        while i < n:
            at = int(self.begin[i])
            j = max(i + 1, int(np.searchsorted(self.end, at + BLOCK, side="right")))
            size = int(self.end[j - 1]) - at
            total = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum(self._table[self.data[at : at + size]] * _power_table(_BASE, size)[:size], out=total[1:])
            begin, end = self.begin[i:j] - at, ends[i:j] - at
            h = (total[end] - total[begin]) * _power_table(_INVERSE, size)[begin]
            out[i:j] = mix(h + (end - begin).astype(np.uint64) * U64(0xD6E8FEB86659FD93))
            i = j
        for i in np.flatnonzero(ends - self.begin > LONGEST).tolist():
            word = self.data[self.begin[i] : ends[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word.lower() if self._table is _LOWER else word, digest_size=8).digest(), "little")
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def grams(self, n: int) -> np.ndarray:
        """The hash of the n words from each word on, over ends of texts too."""
        m = len(self.code) - n + 1
        if m <= 0:
            return np.zeros(0, dtype=np.uint64)
        if n <= len(_ORDER):
            total = np.zeros(m, dtype=np.uint64)
            for k in range(n):
                total += self.code[k : k + m] * _ORDER[k]
            return mix(total)
        raise ValueError("too many words in a gram")

    def shingle_sets(self, n: int) -> list[np.ndarray]:
        """Per text the sorted distinct hashes of its n-word shingles; a shorter text is one shingle."""
        grams, out = self.grams(n), []
        for a, b in zip(self.ptr[:-1].tolist(), self.ptr[1:].tolist(), strict=True):
            if b - a >= n:
                s = np.sort(grams[a : b - n + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif b > a:
                # the number of words keeps it apart from longer shingles
                part = self.code[a:b] * _ORDER[: b - a]
                out.append(mix(part.sum(dtype=np.uint64, keepdims=True) + U64((b - a) * 0x9FB21C651E98DF25 % (1 << 64))))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        return out


def freed(run: Callable) -> Callable:
    """A function for mapInArrow that gives unused memory back to the system when it ends, as workers live on."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)

    return wrapped


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose texts have about ``limit`` bytes; a longer text is alone."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)

