"""Gaussian kernel density of the excess within payout deciles, computed from every row.

Values are measured in bandwidths and collapsed into cells half a bandwidth wide; a cell keeps the power sums of its
values around its centre.  A Taylor series of the kernel turns the power sums of the cells within nine bandwidths into
one polynomial per cell, so the density at a value is a polynomial of its place in its own cell: the work per claim
doesn't depend on the number of claims, no pairs are formed, and a hot value or group is summed map-side.

Error bound: a kernel value (1 at its peak) errs by less than 1e-15.  Derivatives of order p of the kernel stay below
1.09 * sqrt(p!), two offsets differ by half a bandwidth at most, so what is left out after order 20 is below
1.1 * 0.5**21 / sqrt(21!), about 7e-17; cells beyond 18 cells add less than exp(-40.5) each.
"""

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsieve.functions.expr import linspace, nan_to_null
from claimsieve.session import materialize

ORDER = 20
CELL = 0.5
REACH = 18


class DensityCells(NamedTuple):
    """``groups``: group, ``n`` and bandwidth ``h``; ``cells``: group, cell number and polynomial ``_c0.._c20``."""

    groups: DataFrame
    cells: DataFrame


def bandwidth(df: DataFrame, by: str = "decile", value: str = "excess") -> DataFrame:
    """Rule-of-thumb bandwidth ``0.9 * sd * n ** -0.2`` per group; null where the group has no spread."""
    x = nan_to_null(F.col(value).cast("double"))
    sd, n = F.stddev_samp(x), F.count(x)
    return (
        df.groupBy(by)
        .agg(n.alias("n"), sd.alias("sd"))
        .withColumn("h", F.when((F.col("sd") > 0) & (F.col("n") >= 2), 0.9 * F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))))
    )


def _kernel_derivatives() -> Column:
    """``array<struct<step, g>>``: derivatives 0..ORDER of ``exp(-d * d / 2)`` at the distance of every near cell."""
    rows = []
    for step in range(-REACH, REACH + 1):
        d = step * CELL
        hermite = [1.0, d]
        for p in range(1, ORDER):
            hermite.append(d * hermite[p] - p * hermite[p - 1])
        g = [(-1) ** p * hermite[p] * math.exp(-d * d / 2) for p in range(ORDER + 1)]
        rows.append(f"struct({step}L as step, array({', '.join(f'{x!r}D' for x in g)}) as g)")
    return F.expr(f"array({', '.join(rows)})")


def _placed(df: DataFrame, groups: DataFrame, by: str, value: str) -> DataFrame:
    """``df`` with bandwidth, count, cell number and offset from the cell's centre, the last in bandwidths."""
    sizes = groups.select(F.col(by).alias("_by"), F.col("n").alias("_n"), F.col("h").alias("_h"))
    u = nan_to_null(F.col(value).cast("double")) / F.col("_h")
    out = df.join(sizes, df[by] == sizes["_by"], "left").withColumn("_cell", F.floor(u / CELL).cast("long"))
    return out.withColumn("_at", u - (F.col("_cell") + 0.5) * CELL)


def density_cells(df: DataFrame, by: str = "decile", value: str = "excess") -> DensityCells:
    """Collapse all rows of every group into cells; nothing is sampled."""
    groups = materialize(bandwidth(df, by, value), "density-groups")
    placed = _placed(df.select(by, value), groups, by, value).where(F.col("_cell").isNotNull())
    sums = placed.groupBy("_by", "_cell").agg(*[F.sum(F.pow("_at", F.lit(float(k)))).alias(f"_s{k}") for k in range(ORDER + 1)])
    scaled = F.array(*[F.col(f"_s{k}") * ((-1) ** k / math.factorial(k)) for k in range(ORDER + 1)])
    near = sums.select("_by", "_cell", scaled.alias("_m"), F.explode(_kernel_derivatives()).alias("_d"))

    def coefficient(q: int) -> Column:
        terms = F.zip_with(F.slice("_m", 1, ORDER + 1 - q), F.slice("_d.g", q + 1, ORDER + 1 - q), lambda a, b: a * b)
        return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / float(math.factorial(q))

    shifted = near.select("_by", (F.col("_cell") + F.col("_d.step")).alias("_cell"), *[coefficient(q).alias(f"_c{q}") for q in range(ORDER + 1)])
    cells = shifted.groupBy("_by", "_cell").agg(*[F.sum(f"_c{q}").alias(f"_c{q}") for q in range(ORDER + 1)])
    return DensityCells(groups, materialize(cells, "density-cells"))


def kde_at(df: DataFrame, refs: DensityCells, by: str = "decile", value: str = "excess", name: str = "density") -> DataFrame:
    """Add the kernel density of ``value`` among all values of its own group; null without a value, group or spread."""
    placed = _placed(df, refs.groups, by, value).drop("_by")
    found = placed.join(refs.cells.withColumnRenamed("_cell", "_to"), (F.col(by) == F.col("_by")) & (F.col("_cell") == F.col("_to")), "left")
    poly = reduce(lambda a, q: a * F.col("_at") + F.coalesce(f"_c{q}", F.lit(0.0)), reversed(range(ORDER)), F.coalesce(f"_c{ORDER}", F.lit(0.0)))
    density = F.greatest(poly, F.lit(0.0)) / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))
    return found.select(*df.columns, F.when(F.col("_cell").isNotNull(), density).alias(name))


def pair_sums(df: DataFrame, by: str = "decile", value: str = "excess", refs: DensityCells | None = None) -> DataFrame:
    """Per group: ``n``, ``pair_sum`` (the kernel summed over all ordered pairs of its values, each with itself included)
    and ``mean_density``; a group without spread has null sums.

    What a self-join of the group would add up, without the join: the other side of every pair comes from the cells, and
    rows are summed before they move, so neither the pairs nor a hot group meet in one task.  ``n`` counts all rows."""
    refs = refs or density_cells(df, by, value)
    scored = kde_at(df.select(by, value), refs, by, value, "_density")
    sums = scored.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("_density").alias("_sum"), F.count("_density").alias("_m"))
    sizes = refs.groups.select(F.col(by).alias("_by"), F.col("n").alias("_n"), F.col("h").alias("_h"))
    whole = F.col("_sum") * F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi)
    return sums.join(sizes, F.col(by) == F.col("_by"), "left").select(by, "n", whole.alias("pair_sum"), F.try_divide(F.col("_sum"), F.col("_m")).alias("mean_density"))


def kde_curve(df: DataFrame, by: str, value: str, lo: float, hi: float | None = None, points: int = 600) -> DataFrame:
    """Density of ``value`` per group on an even grid from ``lo`` to ``hi`` (default: the largest value of all groups)."""
    refs = density_cells(df, by, value)
    top = df.agg(F.max(nan_to_null(F.col(value).cast("double"))).alias("top")).scalar() if hi is None else F.lit(float(hi))
    x = linspace(F.lit(float(lo)), F.col("_top"), F.col("point"), points)
    grid = refs.groups.select(by, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    return kde_at(grid.withColumn("_top", top).withColumn("x", x).drop("_top"), refs, by, "x")
