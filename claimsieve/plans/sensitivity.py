"""Sensitivity of the linear rule to its two quantile levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from claimsieve.operators import rule as R
from claimsieve.plans.estimate import with_density
from claimsieve.session import materialize


def tau_sensitivity(
    claims: DataFrame, taus_low: Sequence[float] = R.TAUS_LOW, taus_high: Sequence[float] = R.TAUS_HIGH
) -> DataFrame:
    """Class shares, number of severe claims and density contrast of every pair of levels, from one pass."""
    grid = materialize(R.rule_candidates(claims, taus_low, taus_high, [1.0], isotonic=False), "tau-grid")
    scored = materialize(with_density(claims), "tau-density")
    cells = materialize(R.candidate_cells(scored, grid), "tau-cells")
    return (
        grid.select("candidate", "tau1", "tau2")
        .join(R.class_share_columns(cells), "candidate")
        .join(R.density_contrast(cells, "mean_of_ratios"), "candidate")
        .drop("candidate")
    )
