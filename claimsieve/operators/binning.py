"""Equal-frequency bins and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsieve.functions.expr import edge_rank, linspace, nan_to_null, with_opaque
from claimsieve.operators.order import quantile_arrays


def quantile_edges(df: DataFrame, col: str, k: int) -> Column:
    """Scalar subquery: inner edges of ``k`` equal-frequency bins, equal edges dropped."""
    grid = [i / k for i in range(k + 1)]
    edges = quantile_arrays(df, col, grid, name="e").select(F.array_distinct("e").alias("e"))
    return edges.select(F.slice("e", F.lit(2), F.greatest(F.size("e") - 2, F.lit(0))).alias("inner")).scalar()


def assign_bin(df: DataFrame, col: str, inner_edges: Column, max_edges: int, name: str) -> DataFrame:
    bin_no = F.when(F.col(col).isNotNull(), edge_rank("_edges", col, max_edges))
    return with_opaque(df.withColumn("_edges", inner_edges), name, bin_no).drop("_edges")


def qcut(df: DataFrame, col: str, k: int, name: str = "bin", source: DataFrame | None = None) -> DataFrame:
    """Right-closed equal-frequency bins numbered from 0; ``source`` supplies the edges (default ``df``)."""
    return assign_bin(df, col, quantile_edges(source or df, col, k), max(k - 1, 1), name)


def _histogram(df: DataFrame, col: str, edges: Column, bins: int, closed: str, outside: bool = False) -> DataFrame:
    """Counts of all ``bins`` bins, empty ones included.

    Values outside the edges are dropped, or with ``outside`` counted in bins -1 (no lower end) and ``bins`` (no upper
    end), so that the counts add up to the values that are there.  Nulls and NaN are in no bin.
    """
    first, after = (-1, bins + 1) if outside else (0, bins)
    if closed not in ("left", "right"):
        raise ValueError("closed must be 'left' or 'right'")
    last = F.get("_e", F.lit(bins))
    if closed == "right":
        bin_no = edge_rank("_e", col, bins + 1) - 1
    else:
        bin_no = F.when(F.col(col) == last, bins - 1).otherwise(edge_rank("_e", col, bins + 1, inclusive=True) - 1)
    counts = (
        df.select(col)
        .where(nan_to_null(col).isNotNull())
        .withColumn("_e", edges)
        .select(bin_no.alias("bin"))
        .where(F.col("bin").between(first, after - 1))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = df.sparkSession.range(first, after).select(F.col("id").cast("int").alias("bin")).withColumn("_e", edges)
    return every.join(counts, "bin", "left").select(
        "bin",
        F.when(F.col("bin") >= 0, F.get("_e", F.col("bin"))).alias("lo"),
        F.when(F.col("bin") < bins, F.get("_e", F.col("bin") + 1)).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def histogram(df: DataFrame, col: str, edges: Sequence[float], closed: str = "right", outside: bool = False) -> DataFrame:
    return _histogram(df, col, F.array(*[F.lit(float(e)) for e in edges]), len(edges) - 1, closed, outside)


def equal_width_histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """``bins`` right-closed bins over the range of ``col``; the first edge is moved down by 0.1 % of the range."""
    lo, hi = F.min(col), F.max(col)
    cut = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: linspace(F.col("lo"), F.col("hi"), i, bins + 1))
    widened = F.transform(cut, lambda e, i: F.when(i == 0, e - (F.col("hi") - F.col("lo")) * 0.001).otherwise(e))
    edges = df.agg(lo.cast("double").alias("lo"), hi.cast("double").alias("hi")).select(widened.alias("e")).scalar()
    return _histogram(df, col, edges, bins, "right")


def density_histogram(a: DataFrame, b: DataFrame, col_a: str, col_b: str, edges: Sequence[float]) -> DataFrame:
    """Left-closed histograms of two samples clipped to the edges, each normalised to unit area."""
    lo, hi = F.lit(float(edges[0])), F.lit(float(edges[-1]))

    def one(df: DataFrame, col: str, name: str) -> DataFrame:
        clipped = df.where(F.col(col).isNotNull()).select(F.greatest(lo, F.least(hi, F.col(col))).alias("x"))
        h = histogram(clipped, "x", edges, closed="left")
        size = clipped.agg(F.count(F.lit(1)).alias("n")).scalar()
        return h.withColumn("_size", size).select(
            "bin", "lo", "hi", F.try_divide(F.col("n"), F.col("_size") * (F.col("hi") - F.col("lo"))).alias(name)
        )

    return one(a, col_a, "density_a").join(one(b, col_b, "density_b").drop("lo", "hi"), "bin")
