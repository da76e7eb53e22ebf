"""Mergeable sketches: approximate figures of many parts that add up without reading the parts again.

Distinct counts are kept as HLL sketches per part (a file, a day) and column, quantiles as KLL sketches.  A sketch table is
small whatever the rows, so it is stored next to the data; new parts are appended and any selection of parts is merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsieve.functions.expr import nan_to_null
from claimsieve.session import materialize

LG_REGISTERS = 14
ITEMS = 2_000  # of a quantile sketch


def distinct_error(lg_registers: int = LG_REGISTERS) -> float:
    """Relative standard error of a distinct count."""
    return 1.04 / 2 ** (lg_registers / 2)


def rank_error(items: int = ITEMS) -> float:
    """Normalised rank error of a quantile sketch at 99 % confidence."""
    return 2.296 / items**0.9021


def distinct_sketches(df: DataFrame, cols: Sequence[str], part: Column, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """``part, column_name, n, sketch`` from one pass; nulls are no value."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])
    long = df.select(part.alias("part"), F.inline(cells))
    return long.groupBy("part", "column_name").agg(F.count("value").alias("n"), F.hll_sketch_agg("value", F.lit(lg_registers)).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: Sequence[str] = ("column_name",)) -> DataFrame:
    """Rows and approximate distinct values over all parts of a sketch table."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def quantile_sketches(df: DataFrame, value: str, by: Sequence[str], parts: int = 64, items: int = ITEMS) -> DataFrame:
    """``by…, part, sketch``.  Rows are dealt to ``parts`` by hash, so that no group is summed up in one task."""
    kept = df.where(nan_to_null(F.col(value).cast("double")).isNotNull())
    part = F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int")
    return kept.select(*by, part.alias("part"), F.col(value).cast("double").alias("_v")).groupBy(*by, "part").agg(F.kll_sketch_agg_double("_v", F.lit(items)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, probs: Sequence[float], by: Sequence[str] = (), name: str = "qs") -> DataFrame:
    """Approximate quantiles of every group, in the order of ``probs``."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    wanted = F.array(*[F.lit(min(max(float(p), 0.0), 1.0)) for p in probs])
    return merged.select(*by, F.kll_sketch_get_quantile_double("sketch", wanted).alias(name))


def sketched_nodes(df: DataFrame, taus: Sequence[float], k: int = 20, payout: str = "payout", excess: str = "excess", items: int = ITEMS) -> DataFrame:
    """The rule's node table by sketches alone: ``bin, tau, node_p, node_low, node_high, q, q_low, q_high``.

    Shares no step with the exact nodes: payout bins, node payouts and excess quantiles all come from merged sketches.  The
    low and high values are those at the sketch's rank error below and above, the tolerance of what is estimated here."""
    off = 2 * rank_error(items)  # the bin's edges are uncertain as well
    rows = df.select(payout, excess)
    edges = merged_quantiles(quantile_sketches(rows, payout, []), [i / k for i in range(1, k)]).scalar()
    place = F.size(F.filter("_edges", lambda e: e < F.col(payout)))
    binned = materialize(rows.withColumn("_edges", edges).select(payout, excess, place.alias("bin")), "sketch-bins")
    nodes = merged_quantiles(quantile_sketches(binned, payout, ["bin"], items=items), [0.5 - off, 0.5, 0.5 + off], ["bin"], "_p")
    levels = [p for t in taus for p in (t - off, t, t + off)]
    tails = merged_quantiles(quantile_sketches(binned, excess, ["bin"], items=items), levels, ["bin"], "_q")
    cells = F.array(*[F.struct(F.lit(float(t)).alias("tau"), F.get("_q", F.lit(3 * i)).alias("q_low"), F.get("_q", F.lit(3 * i + 1)).alias("q"), F.get("_q", F.lit(3 * i + 2)).alias("q_high")) for i, t in enumerate(taus)])
    points = [F.get("_p", F.lit(i)).alias(c) for i, c in enumerate(("node_low", "node_p", "node_high"))]
    return nodes.join(tails, "bin").select("bin", *points, F.inline(cells))
