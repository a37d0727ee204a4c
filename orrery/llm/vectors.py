"""Bytes of texts as numpy vectors: words, their hashes, and windows, for whole Arrow batches at once.

Hashes are polynomials modulo 2^64 from prefix sums, mixed at the end; nothing is looped per byte.
Memory is bounded by CHUNK bytes of text (and by the longest single text).
"""

from __future__ import annotations

import os
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"p": np.ones(1, U), "q": np.ones(1, U)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
WORD = DIGIT.copy()
WORD[65:91] = WORD[97:123] = WORD[128:] = True


def ship(spark) -> None:
    """Lets Python workers find this package as the driver does, for sessions that were started elsewhere.

    A path that a machine lacks is passed over there; clusters install the package or send it with --py-files.
    """
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in (paths := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


@contextmanager
def small_batches(spark, rows: int = 1000):
    """Fewer rows an Arrow batch for what is computed inside; a smaller setting stays, and the old one comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(int(old), rows) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        m = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            for key, base in (("p", _BASE), ("q", _INVERSE)):
                x = np.full(m, base, U)
                x[0] = 1
                _powers[key] = np.cumprod(x, dtype=U)
    return _powers["p"][:n], _powers["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def batch_texts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, most: int = CHUNK):
    """(first, last) rows of runs of at most most bytes, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(raw: np.ndarray, off: np.ndarray, numbers: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of each word; numbers: points and commas between digits belong to words."""
    m = WORD[raw]
    if numbers and len(raw) > 2:
        d = DIGIT[raw]
        m[1:-1] |= ((raw[1:-1] == 46) | (raw[1:-1] == 44)) & d[:-2] & d[2:]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    start = m.copy()
    start[1:] &= ~m[:-1] | edge[1:-1]
    end = m.copy()
    end[:-1] &= ~m[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def span_hash(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of each span raw[s:e]."""
    if not len(s):
        return np.zeros(0, U)
    p, q = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * p[:-1], out=total[1:])
    return mix((total[e] - total[s]) * q[s] + (e - s).astype(U))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of h[i : i + size] for each i."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(size):
        out = out * U(_BASE) + h[j : j + n]
    return mix(out)
