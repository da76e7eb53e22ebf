"""Hard-negative mining by a vertical scan that drops candidates by bounds (BOND).

Shards hold vectors by dimension.  For an anchor the dimensions are read in descending magnitude of its own components;
after each few of them every candidate's score lies between its partial sum plus the least and plus the most that the
unread dimensions can add, from each dimension's minimum and maximum in the shard.  Candidates that can't reach the
wanted scores leave the bitmap; those that are left after the last dimension have exact scores.

Two searches: the best rows of the anchor's label (its positives), then, in the score window of every positive, the
best rows of other labels.  The wanted scores are the window's ends, and at least the ``k``-th highest of the lower bounds of
rows that are surely in the window, or the ``k``-th score that the task has found in earlier shards.

Defined results: rows with a null label or vector, or a null or non-finite component, take no part; a shorter vector
counts as followed by zeros; rows are told apart by row, so an anchor's positives may be other rows with its id; null
ids are never anchors and come last in ties; repeated rows count as often as they occur; a positive without a row in its
window has no row in the result; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.llm import vectors as V
from claimsieve.session import materialize

STEP = 8
_NAMES = ["dim", "columns", "ids", "rows", "labels"]
_SHARD = "dim int, columns binary, ids binary, rows binary, labels binary"
_LOW, _HIGH = -(2**62), 2**62


class Shard:
    """Vectors by dimension (``columns[d, i]``) with ids, rows and labels, and the range of every dimension."""

    def __init__(self, columns: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray):
        self.columns, self.ids, self.rows, self.labels = columns, ids, rows, labels
        self.lo, self.hi = (columns.min(axis=1), columns.max(axis=1)) if len(ids) else (np.zeros(len(columns)), np.zeros(len(columns)))

    def pack(self) -> list:
        kind = np.int32 if self.columns.size == 0 or np.abs(self.columns).max() < 2**31 else np.int64
        return [len(self.columns), self.columns.astype(kind).tobytes(), *[x.astype(np.int64).tobytes() for x in (self.ids, self.rows, self.labels)]]

    @classmethod
    def unpack(cls, dim: int, columns: bytes, ids: bytes, rows: bytes, labels: bytes) -> Shard:
        long = [np.frombuffer(x, dtype=np.int64) for x in (ids, rows, labels)]
        kind = np.int64 if len(columns) == 8 * dim * len(long[0]) else np.int32
        return cls(np.frombuffer(columns, dtype=kind).astype(np.int64).reshape(dim, len(long[0])), *long)

    def ready(self, queries: np.ndarray) -> tuple[Shard, np.ndarray]:
        """This shard and the queries with as many dimensions as either, in the number kind that keeps scores exact."""
        dim = max(queries.shape[1], len(self.columns))
        kind = V.exact_kind(self.columns.T, queries)
        columns = V.widened(self.columns.T, dim).T if len(self.columns) < dim else self.columns
        return Shard(np.ascontiguousarray(columns.astype(kind)), self.ids, self.rows, self.labels), V.widened(queries, dim).astype(kind)


def vertical_scan(shard: Shard, query: np.ndarray, candidates: np.ndarray, windows: list[tuple[int, int]], k: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """Candidates (positions) that any window may want among its best ``k``, their exact scores, and how many components were read."""
    order = np.argsort(-np.abs(query), kind="stable")
    ends = np.stack([query * shard.lo, query * shard.hi])[:, order]
    # what the dimensions not yet read can add
    most, least = (np.append(np.cumsum(e[::-1])[::-1], 0) for e in (ends.max(axis=0), ends.min(axis=0)))
    score = np.zeros(len(candidates), dtype=shard.columns.dtype)
    read = 0
    for at in range(0, len(order), step):
        dims = order[at : at + step]
        cells = shard.columns[dims] if len(candidates) == len(shard.ids) else shard.columns[np.ix_(dims, candidates)]
        score = score + query[dims] @ cells
        read += cells.size
        done = min(at + step, len(order))
        low, high = score + least[done], score + most[done]
        wanted = np.zeros(len(candidates), dtype=bool)
        for floor, ceiling in windows:
            inside = (high >= floor) & (low <= ceiling)
            sure = low[inside & (low >= floor) & (high <= ceiling)]
            if len(sure) >= k:  # k rows of the window reach this score at least
                inside &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
            wanted |= inside
        if not wanted.all():
            candidates, score = candidates[wanted], score[wanted]
        if not len(candidates):
            break
    return candidates, score.astype(np.int64), read


def _lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in V.blocks(batches):
        points = V.matrix_of(table["v"].combine_chunks())
        packed = Shard(points.T, V.ids_of(table["vec_id"]), table["row"].to_numpy(), table["label"].to_numpy()).pack()
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(packed, [pa.int32(), *[pa.binary()] * 4])], _NAMES)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Shard.unpack(*[batch.column(_NAMES.index(c))[k].as_py() for c in _NAMES])


def _best_alike(sent: dict, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` rows of every anchor's label."""
    found = V.Found(len(sent["row"]), k)
    anchors, own, labels = V.matrix_of(sent["v"]), np.array(sent["row"], dtype=np.int64), sent["label"]
    for given in _shards(batches):
        shard, queries = given.ready(anchors)
        alike = {x: np.flatnonzero(shard.labels == x) for x in set(labels)}
        for q, query in enumerate(queries):
            start = alike[labels[q]]
            start = start[shard.rows[start] != own[q]]
            floor = found.floor(q)
            at, score, _ = vertical_scan(shard, query, start, [(_LOW if floor is None else floor, _HIGH)], k)
            found.add(q, score, shard.ids[at])
    yield found.batch(anchor=own, anchor_id=np.array(sent["vec_id"], dtype=np.int64))


def _best_in_windows(sent: dict, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` rows of other labels in every window of every anchor."""
    anchors, own, labels = V.matrix_of(sent["v"]), sent["row"], sent["label"]
    sizes = [len(w) for w in sent["windows"]]
    first = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    flat = [w for ws in sent["windows"] for w in ws]
    found = V.Found(len(flat), k)
    for given in _shards(batches):
        shard, queries = given.ready(anchors)
        unlike = {x: np.flatnonzero(shard.labels != x) for x in set(labels)}
        for q, query in enumerate(queries):
            ends = []
            for w in range(first[q], first[q + 1]):
                floor, ceiling = flat[w]["floor"], flat[w]["ceiling"]
                ends.append((max(floor, found.floor(w, floor)), ceiling))
            at, score, _ = vertical_scan(shard, query, unlike[labels[q]], ends, k)
            for w, (floor, ceiling) in zip(range(first[q], first[q + 1]), ends):
                fits = (score >= floor) & (score <= ceiling)
                if fits.any():
                    found.add(w, score[fits], shard.ids[at[fits]])
    yield found.batch(anchor=np.repeat(np.array(own, dtype=np.int64), sizes), positive_score=np.array([w["score"] for w in flat], dtype=np.int64))


def hard_negatives(
    table: DataFrame, label: F.Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, every: int = 100, block: int = V.BLOCK_QUERIES
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are rows whose ``vec_id`` is divisible by ``every``; a negative's score is between ``low`` and ``high`` percent of the positive's."""
    rows = V.integer_rows(table, scale, label)
    shards = materialize(rows.select("row", "vec_id", "label", "v").mapInArrow(_lay_out, _SHARD), "columns")
    anchors = materialize(rows.filter(F.col("vec_id") % every == 0).select("row", "vec_id", "label", "v"), "anchors")
    alike = V.search_blocks(shards, anchors, lambda s, b: _best_alike(s, b, positives), ["anchor", "anchor_id"], block)
    chosen = materialize(V.best_of(alike, ["anchor"], positives), "positives")
    window = F.struct("score", F.expr(f"(score * {low} + 99) div 100").alias("floor"), F.expr(f"score * {high} div 100").alias("ceiling"))
    asked = chosen.filter("score >= 0").groupBy("anchor").agg(F.collect_set(window).alias("windows"))  # none below 0; one for each positive at most
    asked = materialize(anchors.join(asked, F.col("row") == F.col("anchor")).select("row", "vec_id", "label", "v", "windows"), "windows")
    near = V.search_blocks(shards, asked, lambda s, b: _best_in_windows(s, b, negatives), ["anchor", "positive_score"], block)
    best = V.best_of(near, ["anchor", "positive_score"], negatives).withColumnsRenamed({"found_id": "negative_id", "score": "negative_score"})
    named = chosen.select("anchor", "anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(best, ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
