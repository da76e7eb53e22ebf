"""Integer vectors in shards, searched by blocks of queries.

A table of vectors becomes ``row, vec_id, label, v`` (``row`` tells rows apart, ``v`` holds the scaled components), and its
rows are packed into shards of at most ``SHARD_ROWS``, one written row each.  A search sends a block of queries of
bounded size to every shard, keeps the best of each query while a task goes from shard to shard, and merges what the
tasks found.  The queries themselves stay in Spark; only one block at a time is on the driver.

Scores are integers.  While every sum of products stays below 2**53 they are computed with doubles, which are then exact;
up to 2**62 with long integers; vectors beyond that are refused with an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimsieve.session import materialize, scratch_path

SHARD_ROWS = 4_096
SHARDS_A_TASK = 64
BLOCK_QUERIES = 8_192
NO_ID = 2**63 - 1  # a null id comes after all others in ties


def integer_rows(table: DataFrame, scale: int, label: F.Column | None = None) -> DataFrame:
    """``row, vec_id, label, v`` of the usable rows: vectors without null or non-finite components, ``floor(scale * x)``."""
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    kept = table.filter(usable) if label is None else table.filter(usable & label.isNotNull())
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    named = kept.select(F.col("vec_id").cast("long").alias("vec_id"), (F.lit(0) if label is None else label).cast("long").alias("label"), scaled.alias("v"))
    size = named.count()
    cores = table.sparkSession.sparkContext.defaultParallelism
    parts = min(-(-size // SHARD_ROWS), max(2 * cores, -(-size // (SHARD_ROWS * SHARDS_A_TASK))))
    return materialize(named.repartition(max(1, parts)).withColumn("row", F.monotonically_increasing_id()), "vectors")


def matrix_of(vectors: pa.Array | list) -> np.ndarray:
    """One line of longs per vector; a shorter vector is followed by zeros."""
    if isinstance(vectors, pa.Array):
        sizes = set(pc.list_value_length(vectors).to_pylist())
        if len(sizes) == 1:
            return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(vectors), sizes.pop())
        vectors = vectors.to_pylist()
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), dtype=np.int64)
    for line, x in zip(out, vectors):
        line[: len(x)] = x
    return out


def widened(m: np.ndarray, dim: int) -> np.ndarray:
    return m if m.shape[1] >= dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))


def exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """The number kind in which every sum of products of a line of ``a`` with one of ``b`` is exact."""
    top = [max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0 for x in (a, b)]
    most = top[0] * top[1] * max(a.shape[1], b.shape[1], 1)
    if most >= 2**62:
        raise ValueError("scaled components are too large for scores of 64 bits")
    return np.float64 if most < 2**53 else np.int64


def blocks(batches: Iterator[pa.RecordBatch], rows: int = SHARD_ROWS) -> Iterator[pa.Table]:
    """Tables of at most ``rows`` rows; only the last one of a task is smaller."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while batch.num_rows:
            take = batch.slice(0, rows - size)
            held.append(take)
            size += take.num_rows
            batch = batch.slice(take.num_rows)
            if size == rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy().astype(np.int64)


def query_blocks(queries: DataFrame, size: int = BLOCK_QUERIES) -> Iterator[tuple[int, pa.Table]]:
    """The queries in blocks of about ``size / 2`` and practically never more than ``size``: their unique rows are hashed."""
    parts = 1 + queries.count() // max(1, size // 2)
    for k in range(parts):
        part = queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("row"), F.lit(parts)) == k)
        yield k, part.toArrow()  # bounded by size


class Found:
    """The best ``k`` of every query: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = [np.zeros(0, dtype=np.int64)] * n
        self.id = [np.zeros(0, dtype=np.int64)] * n

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[q], score]), np.concatenate([self.id[q], ids])
        best = np.lexsort((ids, -score))[: self.k]
        self.score[q], self.id[q] = score[best], ids[best]

    def floor(self, q: int, other: int | None = None) -> int | None:
        """The score that a further row must reach, ties included; none while fewer than ``k`` are known."""
        own = int(self.score[q][-1]) if len(self.score[q]) == self.k else None
        return max((x for x in (own, other) if x is not None), default=None)

    def batch(self, **columns: np.ndarray) -> pa.RecordBatch:
        """All rows found; ``columns`` have one value per query."""
        sizes = [len(s) for s in self.score]
        ids = np.concatenate(self.id) if sizes else np.zeros(0, dtype=np.int64)
        arrays = [pa.array(np.repeat(np.asarray(c, dtype=np.int64), sizes)) for c in columns.values()]
        found = [pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(np.concatenate(self.score) if sizes else ids, pa.int64())]
        return pa.RecordBatch.from_arrays([*arrays, *found], [*columns, "found_id", "score"])


def search_blocks(shards: DataFrame, queries: DataFrame, search: Callable, keys: Sequence[str], size: int = BLOCK_QUERIES) -> DataFrame:
    """``<keys>, found_id, score`` from every block of queries against every shard.

    ``search(queries table, batches of shards)`` yields a task's record batches.  Each block is one job, written before the next begins."""
    spark = shards.sparkSession
    schema = ", ".join(f"{c} bigint" for c in [*keys, "found_id", "score"])
    path = scratch_path(spark, "found")
    for k, table in query_blocks(queries, size):
        sent = spark.sparkContext.broadcast(table.to_pydict())  # one block

        def read(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            return search(sent.value, batches)

        shards.mapInArrow(read, schema).write.parquet(f"{path}/part={k}")
        sent.unpersist()
    return spark.read.schema(schema).parquet(*[f"{path}/part={i}" for i in range(k + 1)])


def best_of(found: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` rows of every key by score and id, with their ``rank`` from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("found_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
