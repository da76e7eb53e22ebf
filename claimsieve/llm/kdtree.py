"""Exact top-k search by inner product with one KD-tree per shard.

A tree halves its rows at the median of the widest dimension (ties by id, so equal vectors are halved too) down to small
leaves; every node keeps the tight bounding box of its rows and their smallest id.  The score of a query with any row of
a box is at most ``sum(max(q * lo, q * hi))``.  A query visits nodes best bound first and stops at the first bound that the
``k``-th best row so far beats.  That row's score goes on from tree to tree within a task; before, all queries search
one tree, whose ``k``-th score goes with them to all others.

Defined results: rows whose vector is null or holds a null or non-finite component take no part; a shorter vector counts
as followed by zeros; a query is a row and is left out of its own candidates by row, so another row with its id is one;
a null id is never a query and comes last in ties; repeated rows are found as often as they occur; an empty table or no
query gives an empty result; a single row has no candidates; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.llm import vectors as V
from claimsieve.session import materialize

LEAF_ROWS = 128
_NAMES = ["dim", "points", "ids", "rows", "nodes", "lo", "hi"]
_SHARD = "dim int, points binary, ids binary, rows binary, nodes binary, lo binary, hi binary"


class Tree:
    """``points`` in tree order with ``ids`` and ``rows``; per node start, end, left child (right one follows; 0: leaf) and
    smallest id in ``nodes``, and the corners ``lo`` and ``hi`` of its box."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, nodes: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.points, self.ids, self.rows, self.nodes, self.lo, self.hi = points, ids, rows, nodes, lo, hi

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
        order = np.arange(len(ids))
        nodes, lows, highs = [[0, len(ids), 0, 0]], [], []
        at = 0
        while at < len(nodes):
            start, end, _, _ = nodes[at]
            own = order[start:end]
            lo, hi = points[own].min(axis=0), points[own].max(axis=0)
            lows.append(lo)
            highs.append(hi)
            nodes[at][3] = int(ids[own].min())
            if end - start > leaf:
                wide = int((hi - lo).argmax()) if len(lo) else 0
                by = points[own, wide] if len(lo) else ids[own]
                order[start:end] = own[np.lexsort((ids[own], by))]
                middle = (start + end) // 2
                nodes[at][2] = len(nodes)
                nodes += [[start, middle, 0, 0], [middle, end, 0, 0]]
            at += 1
        return cls(points[order], ids[order], rows[order], np.array(nodes, dtype=np.int64), np.array(lows), np.array(highs))

    def pack(self) -> list:
        kind = np.int32 if self.points.size == 0 or np.abs(self.points).max() < 2**31 else np.int64
        return [self.points.shape[1], self.points.astype(kind).tobytes(), *[x.astype(np.int64).tobytes() for x in (self.ids, self.rows, self.nodes, self.lo, self.hi)]]

    @classmethod
    def unpack(cls, dim: int, points: bytes, ids: bytes, rows: bytes, nodes: bytes, lo: bytes, hi: bytes) -> Tree:
        long = [np.frombuffer(x, dtype=np.int64) for x in (ids, rows, nodes, lo, hi)]
        kind = np.int64 if len(points) == 8 * dim * len(long[0]) else np.int32
        cells = np.frombuffer(points, dtype=kind).astype(np.int64).reshape(len(long[0]), dim)
        return cls(cells, long[0], long[1], long[2].reshape(-1, 4), long[3].reshape(-1, dim), long[4].reshape(-1, dim))


def search_tree(tree: Tree, queries: np.ndarray, rows: np.ndarray, floors: list[int | None], found: V.Found) -> int:
    """Add a tree's best rows for every query to ``found``; returns how many leaves were read."""
    dim = max(queries.shape[1], tree.points.shape[1])
    queries, points, lo, hi = (V.widened(x, dim) for x in (queries, tree.points, tree.lo, tree.hi))
    kind = V.exact_kind(points, queries)
    queries, points = queries.astype(kind), points.astype(kind)
    bounds = hi.astype(kind) @ np.maximum(queries, 0).T + lo.astype(kind) @ np.minimum(queries, 0).T
    nodes, least = tree.nodes.tolist(), tree.nodes[:, 3].tolist()
    read = 0
    for q, (query, own) in enumerate(zip(queries, rows)):
        bound = bounds[:, q].astype(np.int64).tolist()
        floor = found.floor(q, floors[q])
        last = int(found.id[q][-1]) if len(found.id[q]) == found.k and floor == int(found.score[q][-1]) else None
        heap = [(-bound[0], least[0], 0)]
        while heap:
            best, first, at = heapq.heappop(heap)
            if floor is not None and -best < floor:
                break
            if last is not None and -best == floor and first > last:
                continue  # ties of this box come after the k-th row
            start, end, left, _ = nodes[at]
            if left:
                for child in (left, left + 1):
                    if floor is None or bound[child] >= floor:
                        heapq.heappush(heap, (-bound[child], least[child], child))
                continue
            read += 1
            score = points[start:end] @ query
            keep = tree.rows[start:end] != own
            if floor is not None:
                keep &= score >= floor
            keep = np.flatnonzero(keep)
            if len(keep):
                found.add(q, score[keep].astype(np.int64), tree.ids[start:end][keep])
                floor = found.floor(q, floors[q])
                last = int(found.id[q][-1]) if len(found.id[q]) == found.k and floor == int(found.score[q][-1]) else None
    return read


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in V.blocks(batches):
        points = V.matrix_of(table["v"].combine_chunks())
        packed = Tree.build(points, V.ids_of(table["vec_id"]), table["row"].to_numpy()).pack()
        kinds = [pa.int32(), *[pa.binary()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(packed, kinds)], _NAMES)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Tree.unpack(*[batch.column(_NAMES.index(c))[k].as_py() for c in _NAMES])


def top_k(table: DataFrame, k: int = 10, scale: int = 1024, every: int = 100, block: int = V.BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows for every row whose ``vec_id`` is divisible by ``every``."""
    rows = V.integer_rows(table, scale)
    trees = materialize(rows.select("row", "vec_id", "v").mapInArrow(_grow, _SHARD), "trees")
    queries = rows.filter(F.col("vec_id") % every == 0).select("row", "vec_id", "v")
    first = table.sparkSession.sparkContext.broadcast([[r[c] for c in _NAMES] for r in trees.limit(1).collect()])  # one tree

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = [Tree.unpack(*x) for x in first.value]
        for batch in batches:
            found = V.Found(batch.num_rows, k)
            for tree in grown:
                search_tree(tree, V.matrix_of(batch.column(2)), batch.column(0).to_numpy(), [None] * batch.num_rows, found)
            floors = pa.array([found.floor(q) for q in range(batch.num_rows)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, floors], ["row", "vec_id", "v", "floor"])

    asked = materialize(queries.mapInArrow(begin, "row bigint, vec_id bigint, v array<bigint>, floor bigint"), "queries")

    def search(sent: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = V.Found(len(sent["row"]), k)
        points, own = V.matrix_of(sent["v"]), np.array(sent["row"], dtype=np.int64)
        for tree in _trees(batches):
            search_tree(tree, points, own, sent["floor"], found)
        yield found.batch(query=own, query_id=np.array(sent["vec_id"], dtype=np.int64))

    best = V.best_of(V.search_blocks(trees, asked, search, ["query", "query_id"], block), ["query"], k)
    return best.select("query_id", "rank", F.col("found_id").alias("vec_id"), "score")
