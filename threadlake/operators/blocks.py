"""What indexes make of a block of texts at once, in NumPy: numbers packed by bytes, cuts of batches, memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of whole numbers, seven bits in each and the eighth for a further one, and the number of bytes of each."""
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        more = values >> bits > 0
        if not more.any():
            break
        sizes += more
    at = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = np.flatnonzero(sizes > k)
        out[at[has] + k] = (values[has] >> 7 * k & 127) | (sizes[has] > k + 1) * 128
    return out, sizes


def unpacked(data: bytes) -> np.ndarray:
    """The numbers of packed bytes."""
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    sizes, out = ends - starts + 1, np.zeros(len(ends), np.int64)
    for k in range(int(sizes.max(initial=0))):
        has = np.flatnonzero(sizes > k)
        out[has] |= (b[starts[has] + k] & 127).astype(np.int64) << 7 * k
    return out


def binaries(values: np.ndarray, firsts: np.ndarray) -> pa.Array:
    """The packed values as binaries, one from each first place to the next."""
    data, sizes = packed(values)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    offsets = ends[np.concatenate((firsts, [len(values)]))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(firsts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def changes(*sorted_: np.ndarray) -> np.ndarray:
    """Whether a place of sorted columns differs from the one before; the first does."""
    out = np.zeros(len(sorted_[0]), bool)
    out[:1] = True
    for x in sorted_:
        out[1:] |= x[1:] != x[:-1]
    return out


def pieces(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Consecutive parts of a batch, and where they begin, whose rows' sizes add up to about ``limit``, and to no more than that and one row's."""
    of = np.cumsum(sizes) // limit
    firsts = np.flatnonzero(changes(of))
    for a, b in zip(firsts.tolist(), [*firsts.tolist(), batch.num_rows][1:], strict=True):
        yield a, batch.slice(a, b - a)


def freed(run: Callable) -> Callable:
    """A function for mapInArrow that gives unused memory back to the system when it ends, as workers live on."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)

    return wrapped
