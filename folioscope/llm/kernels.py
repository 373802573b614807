"""Vectorised text kernels shared by the operators: Arrow batches in, numpy arrays out.

Texts of a batch are looked at as one byte buffer, a chunk of about ``CHUNK`` bytes at a time, so a worker holds a few
dozen MB whatever the batch size; memory freed at the end of a task goes back to the system, as workers are kept. A text longer than a chunk makes a chunk of its own and is never cut.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
#: Multipliers (odd) and masks of the hash family, for up to 256 permutations.
FAMILY_A = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
FAMILY_X = _rng.integers(0, 2**63, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The same with ASCII punctuation and controls: words are runs of letters and digits.
MARKS = np.ones(256, bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_pow = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if _pow["n"] < n:
        m = max(n, CHUNK + 2)
        for name, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            out = np.full(m, base, U)
            out[0] = 1
            _pow[name] = np.multiply.accumulate(out)
        _pow["n"] = m
    return _pow["p"], _pow["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def release() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_kept: dict = {}


def kept(kind: str, key, build):
    """What ``build()`` makes of ``key``, kept for the worker's next tasks. A worker keeps one such table: the next kind takes its place."""
    if _kept.get("of") != (kind, key):
        _kept.clear()
        release()
        _kept.update(value=build(), of=(kind, key))
        release()
    return _kept["value"]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each begins (one more than texts); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return all_bytes[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows with about ``size`` bytes of text; no text is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = bytes_of(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
            j = min(j, batch.num_rows)
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j
    release()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of code(byte) * base**position over data[i:j], modulo 2**64."""
    p, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, U)
    out[0] = 0
    np.cumsum(BYTE_CODES[data] * p[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal strings wherever they stand."""
    _, inverse = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U))


def words(data: np.ndarray, at: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) in order, and for each text where its words begin; ``between`` marks the bytes
    that part words, by default those of ``[\\x20\\x09-\\x0D]``."""
    data = LOWER[data]
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    letter = ~between[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    start = np.flatnonzero(letter & (edge[:-1] | np.concatenate(([True], ~letter[:-1]))))
    end = np.flatnonzero(letter & (edge[1:] | np.concatenate((~letter[1:], [True])))) + 1
    return range_hash(prefix_hash(data), start, end), np.searchsorted(start, at)


def grams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words that lie within one text, and for each text where its runs begin."""
    m = max(0, len(h) - k + 1)
    out = np.zeros(m, U)
    for i in range(k):
        out = (out + h[i : i + m]) * U(0xD6E8FEB86659FD93)
        out ^= out >> U(29)
    n = np.maximum(np.diff(first) - (k - 1), 0)
    begin = np.concatenate(([0], np.cumsum(n)))
    doc = np.repeat(np.arange(len(n)), n)
    return mix(out[first[doc] + np.arange(begin[-1]) - begin[doc]]) if m else np.zeros(0, U), begin


def long_column(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
