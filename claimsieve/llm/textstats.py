"""Countable properties of whole texts, computed by the vectorised word scan: one row in, one row out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimsieve.llm.words import SPACED, Scan, bounded_batches, chunks, encoded, gram_hashes, mix

WINDOW = 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Counts behind the ratios that the learned models use.
MORE = ["n_upper", "n_letters", "n_marks", "n_bars", "n_digits", "n_stops", "n_lines", "n_doubled", "n_distinct", "n_wide", "n_shout", "longest"]


def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int8)
    out[np.frombuffer(chars, dtype=np.uint8)] = 1
    return out


_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_TABLES = {
    "n_symbols": _bytes(b"[#*$%&|<>]".strip(b"[]")), "n_upper": _bytes(_UPPER), "n_letters": _bytes(_UPPER + _LOWER), "n_marks": _bytes(b"!?"),
    "n_bars": _bytes(b"|"), "n_digits": _bytes(b"0123456789"), "n_stops": _bytes(b".,;:"), "n_wide": _bytes(bytes(range(0xC2, 0xF5))),
}


def _dup_lines(text: bytes) -> tuple[int, int]:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines)), len(lines)


def _chunk_stats(texts: list[bytes]) -> dict[str, np.ndarray]:
    scan = Scan(texts, SPACED)
    words, first = scan.hashes(), scan.first
    n = np.diff(first)

    def byte_sums(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return total[scan.text_at[1:]] - total[scan.text_at[:-1]]

    out = {name: byte_sums(table[scan.bytes]) for name, table in _TABLES.items()}
    inside = SPACED[scan.bytes]
    out["word_chars"] = byte_sums(inside & ((scan.bytes & 0xC0) != 0x80))
    doc = np.repeat(np.arange(len(texts)), n)
    repeat = np.zeros(len(words), dtype=np.int64)
    if len(words) >= WINDOW:
        windows = gram_hashes(words, WINDOW)
        owner = doc[: len(windows)]
        whole = np.flatnonzero(owner == doc[WINDOW - 1 :])
        key = mix(windows[whole] + mix(owner[whole].astype(np.uint64)))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        again = whole[count[inverse] > 1]
        cover = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + WINDOW, -1)
        repeat = (np.cumsum(cover[:-1]) > 0).astype(np.int64)
    doubled = np.zeros(len(words), dtype=np.int64)
    doubled[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    distinct = np.unique(mix(words + mix(doc.astype(np.uint64))), return_index=True)[1]
    size = scan.ends - scan.starts
    upper = np.concatenate(([0], np.cumsum(_TABLES["n_upper"][scan.bytes], dtype=np.int64)))
    capitals = upper[scan.ends] - upper[scan.starts]
    longest = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(longest, doc, size)
    lines = [_dup_lines(t) for t in texts]
    return out | {
        "n_words": n, "n_repeat_words": scan.per_text(repeat), "n_doubled": scan.per_text(doubled), "longest": longest,
        "n_distinct": np.bincount(doc[distinct], minlength=len(texts)), "n_shout": scan.per_text((capitals >= 2) & (capitals * 2 > size)),
        "n_dup_lines": np.array([x for x, _ in lines]), "n_lines": np.array([x for _, x in lines]),
    }


def text_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of every row with ``BASE`` and ``MORE`` counts (long) of its whole text; null text counts as empty."""
    bounded_batches(docs.sparkSession)
    names = BASE + MORE
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(batch.num_columns - 1))
            parts = [_chunk_stats(texts[lo:hi]) for lo, hi in chunks(texts)]
            made = [pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64()) for c in names]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + made, keep + names)

    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(read, schema)


def ratios() -> dict[str, F.Column]:
    """Inputs of the learned models; every one is defined (0 for an empty text) and free of ids, sources and languages."""
    c = F.col

    def share(a: str, b: str) -> F.Column:
        return F.coalesce(F.try_divide(c(a).cast("double"), c(b)), F.lit(0.0))

    return {
        "length": F.log1p(c("n_words").cast("double")), "word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "n_words"),
        "upper": share("n_upper", "n_letters"), "marks": share("n_marks", "n_words"), "bars": share("n_bars", "n_words"), "digits": share("n_digits", "word_chars"),
        "stops": share("n_stops", "n_words"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"),
        "doubled": share("n_doubled", "n_words"), "distinct": share("n_distinct", "n_words"), "shout": share("n_shout", "n_words"), "longest": F.log1p(c("longest").cast("double")),
    }
