"""Merkle manifest of a dataset: a hash tree over rows, proofs of every row, and their verification, by slot pivots.

The hash of a node is the lower-case hex sha256 of its children's, concatenated.  A pivot makes a level: conditional
aggregates over the nodes of one parent spread them into ``fanout`` slot columns; concatenating the columns and hashing
gives the parent, and leaving out a node's own slot column gives its siblings.

Rows of one run (a language) are ordered by a range sort and numbered by counts of the sorted partitions.  ``fanout ** height``
consecutive nodes form a block.  A table that is dealt by run and block builds ``height`` levels without a further
shuffle, since every parent lies in one block; the block's top nodes are the next, much smaller table.  So a run that
holds a third of all rows is many blocks, and a tree over 10 billion rows takes four passes.  The run's top nodes, ordered
by run, make the last tree.

The siblings of a row are found in the same way, in windows over each parent of its block, and joined to those of its
block's top node.  Verification folds the row's hash with them up to the root.

Defined results: a null value is hashed as ``-``, another as its byte length, ``:`` and itself, so null, empty and
joined values differ; rows ascend by id with null first, then by hash (equal rows have equal hashes, and each has its own
place); a single row is its own subroot, and a single run's subroot the root; an empty table has no rows and no root;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimsieve.session import materialize

HEIGHT = 10  # levels of a block of two-child nodes


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def value_code(value: Column) -> Column:
    """``-`` for null, else byte length, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return hashed(*[value_code(v) for v in values])


def run_key(value: Column) -> Column:
    """A string that is never null and sorts like the value, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``pos`` (from 0, in the given order within ``run``) and ``n`` (rows of the run), without a task that holds a run.

    Rows with equal values in all order columns follow each other in any order."""
    salt = F.xxhash64(F.monotonically_increasing_id())
    sorted_rows = rows.withColumn("_salt", salt).repartitionByRange("run", *order, "_salt").sortWithinPartitions("run", *order, "_salt").drop("_salt")
    placed = materialize(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    pieces = placed.groupBy("run", part.alias("_part")).agg(F.min("_at").alias("_from"), F.count("*").alias("_c"))
    own = Window.partitionBy("run")  # one row for each sorted partition that holds the run
    before = F.sum("_c").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("run", "_part", "_from", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_c").over(own).alias("n"))
    joined = placed.withColumn("_part", part).join(materialize(pieces, "pieces"), ["run", "_part"])
    return joined.select(*rows.columns, (F.col("_at") - F.col("_from") + F.col("_before")).alias("pos"), "n")


def slots(node: Column, slot: Column, fanout: int) -> list[Column]:
    """The pivot: one conditional aggregate for each child of a parent."""
    return [F.max(F.when(slot == j, node)) for j in range(fanout)]


def _levels_of(n: Column, fanout: int, height: int) -> list[Column]:
    """Whether a run of ``n`` nodes still has several nodes at each level of a block."""
    return [n > fanout**level for level in range(height)]


def block_tops(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """``run, pos, n, node``: the top nodes of the blocks of ``run, block, pos, n, node``, numbered as the blocks are."""
    names = [f"s{j}" for j in range(fanout)]
    now = nodes.select("run", "block", "n", "pos", "node")
    for more in _levels_of(F.col("n"), fanout, height):
        parent = F.expr(f"pos div {fanout}")
        pivot = now.groupBy("run", "block", "n", parent.alias("parent")).agg(*[s.alias(c) for s, c in zip(slots(F.col("node"), F.col("pos") % fanout, fanout), names)])
        # a run of one node is finished: it is the first child of its parent and stays as it is
        now = pivot.select("run", "block", "n", F.col("parent").alias("pos"), F.when(more, hashed(F.concat_ws("", *names))).otherwise(F.col("s0")).alias("node"))
    return now.select("run", F.col("block").alias("pos"), F.expr(f"(n + {fanout**height - 1}) div {fanout**height}").alias("n"), "node")


def block_paths(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """``nodes`` with ``path``: what stands before and after the node at every level of its block."""
    now = nodes.withColumn("path", F.array().cast("array<struct<before:string,after:string>>")).withColumn("_node", F.col("node")).withColumn("_pos", F.col("pos"))
    for more in _levels_of(F.col("n"), fanout, height):
        slot = F.col("_pos") % fanout
        parent = Window.partitionBy("run", "block", "_parent")
        names = [f"_s{j}" for j in range(fanout)]
        now = now.withColumn("_parent", F.expr(f"_pos div {fanout}"))
        now = now.select("*", *[s.over(parent).alias(c) for s, c in zip(slots(F.col("_node"), slot, fanout), names)])
        before = F.concat_ws("", *[F.when(slot > j, F.col(c)) for j, c in enumerate(names)])
        after = F.concat_ws("", *[F.when(slot < j, F.col(c)) for j, c in enumerate(names)])
        step = F.array(F.struct(before.alias("before"), after.alias("after")))
        now = now.select(
            *nodes.columns, F.when(more, F.concat("path", step)).otherwise(F.col("path")).alias("path"),
            F.when(more, hashed(F.concat_ws("", *names))).otherwise(F.col("_node")).alias("_node"), F.col("_parent").alias("_pos"),
        )
    return now.drop("_node", "_pos")


def _dealt(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {fanout**height}")).repartition("run", "block")


def tree(nodes: DataFrame, fanout: int = 2, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """From ``run, pos, n, node``: the rows with their ``path`` up to the top of their run, and ``run, top``."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    if largest <= fanout**height:
        own, levels = _dealt(nodes, fanout, height), next(h for h in range(height + 1) if fanout**h >= largest)
        return block_paths(own, fanout, levels).drop("block"), block_tops(own, fanout, levels).select("run", F.col("node").alias("top"))
    above = materialize(block_tops(_dealt(nodes, fanout, height), fanout, height), "nodes")
    higher, tops = tree(above, fanout, height)
    upper = higher.select(F.col("run"), F.col("pos").alias("block"), F.col("path").alias("_upper"))
    own = block_paths(_dealt(nodes, fanout, height), fanout, height).join(upper, ["run", "block"])
    return own.withColumn("path", F.concat("path", "_upper")).drop("block", "_upper"), tops


def folded(node: Column, path: Column) -> Column:
    """The top that a node and its siblings lead to."""
    return F.aggregate(path, node, lambda acc, step: hashed(step["before"], acc, step["after"]))


def manifest(rows: DataFrame, run: Column, id_col: str, values: Sequence[Column], claimed: Sequence[Column] | None = None, fanout: int = 2, height: int = HEIGHT) -> DataFrame:
    """``<id>, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    Leaves hash ``values`` in order; verification starts from the hash of the ``claimed`` values (by default the same)."""
    leaf, told = leaf_hash(*values), leaf_hash(*(claimed or values))
    leaves = rows.select(run_key(run).alias("run"), F.col(id_col).alias("_id"), leaf.alias("node"), F.nullif(told, leaf).alias("told"))
    # hashes first, so the range sort samples and moves narrow rows and no text is read twice
    nodes = materialize(numbered(materialize(leaves, "hashes"), ["_id", "node"]), "leaves")
    own, tops = tree(nodes, fanout, height)
    tops = materialize(tops, "subroots")
    runs = materialize(numbered(tops.select(F.lit("").alias("run"), F.col("run").alias("_run"), F.col("top").alias("node")), ["_run"]), "runs")
    upper, roots = tree(runs, fanout, height)
    root = materialize(roots, "root").select("top").scalar()
    upper = materialize(upper.select(F.col("_run").alias("run"), F.col("node").alias("subroot"), F.col("path").alias("_upper")), "upper")
    full = own.join(upper, "run").withColumn("path", F.concat("path", "_upper")).withColumn("root", root)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = full.select(F.col("_id").alias(id_col), F.col("node").alias("leaf"), "subroot", "root", hashed(siblings).alias("proof_sha256"), folded(F.coalesce("told", "node"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
