"""Vectorised word scanning of UTF-8 text inside Arrow tasks.

A group of texts is joined by a separator byte and scanned once: a 256-entry table marks word bytes, word borders come
from its differences, and every word gets a 64-bit hash from one prefix sum of a polynomial modulo 2**64.  All
separators are ASCII, so bytes above 0x7F always belong to words and no text has to be decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

CHUNK_BYTES = 512 << 10  # the arrays of a scan take some 50 times as much
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _table(separators: bytes) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[np.frombuffer(separators, dtype=np.uint8)] = False
    return out


#: Letters, digits and every non-ASCII byte are word bytes; texts are lower-cased first, so A-Z never occur.
ALNUM = _table(bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122)))
#: Everything but ASCII white space is a word byte.
SPACED = _table(b" \t\n\v\f\r")


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound the bytes of one Arrow batch, so that a run of very long texts can't fill a Python worker."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, str(2**63 - 1), str(2**31 - 1), "-1"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def encoded(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of every text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``limit`` bytes; a longer text is a range of its own."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > 4 * CHUNK_BYTES:
            return made  # one very long text: not kept
        _powers[:] = made
    return _powers


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of ``units[start:end]`` for every pair, the same wherever the span lies."""
    power, inverse = _power_tables(len(units) + 1)
    sums = np.zeros(len(units) + 1, dtype=np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * power[: len(units)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class Scan:
    """Words of a group of texts: byte ``starts`` and ``ends``, and ``first`` (n_texts + 1 word offsets)."""

    def __init__(self, texts: list[bytes], table: np.ndarray, lower: bool = False):
        data = b" ".join(texts) + b" "
        self.data = data.lower() if lower else data
        self.bytes = np.frombuffer(self.data, dtype=np.uint8)
        inside = table[self.bytes].view(np.int8)
        edges = np.flatnonzero(np.diff(inside, prepend=np.int8(0)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.text_at = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.text_at[1:])
        self.first = np.searchsorted(self.starts, self.text_at)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.bytes, self.starts, self.ends)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sum of word values by text."""
        total = np.concatenate(([0], np.cumsum(values)))
        return total[self.first[1:]] - total[self.first[:-1]]


_ODD = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(1, 65)]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` (at most 64) consecutive words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += words[j : j + n] * _ODD[j]
    return mix(out + np.uint64(k))


def row_hashes(table: np.ndarray) -> np.ndarray:
    """Hash of every row of word hashes (at most 64 to a row)."""
    out = np.zeros(len(table), dtype=np.uint64)
    for j in range(table.shape[1]):
        out += table[:, j] * _ODD[j]
    return mix(out)
