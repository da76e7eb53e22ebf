"""End-to-end estimation of the risk rule and its use on new claims."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.operators import rule as R
from claimsieve.operators.binning import qcut
from claimsieve.operators.density import density_cells, kde_at
from claimsieve.session import materialize


class RuleEstimate(NamedTuple):
    grid: DataFrame
    pick: DataFrame
    labels: DataFrame


def with_density(claims: DataFrame, k: int = R.DECILES) -> DataFrame:
    """Payout deciles and the density of every claim among the claims of its decile.

    The density does not depend on the rule, so it is computed once per claim for all candidates.
    """
    binned = materialize(qcut(claims.select("claim_key", "payout", "excess"), "payout", k, "decile"), "deciles")
    return kde_at(binned, density_cells(binned))


def estimate_rule(claims: DataFrame, slack: float = 0.05) -> RuleEstimate:
    """Nodes, curves, 60 candidates, their measures, the choice, and the labels under the chosen rule.

    Three tables are written to the shared folder because later passes read them again: the two claim columns with
    their key, the claims with decile and density, and the 60-row grid.
    """
    base = materialize(claims.select("claim_key", "payout", "excess"), "rule-claims")
    scored = materialize(with_density(base), "rule-density")
    candidates = materialize(R.rule_candidates(base), "rule-candidates")
    grid = materialize(R.rule_grid(scored, candidates), "rule-grid")
    pick = R.pick_rule(grid, slack)
    usable = pick.where(F.col("n_admissible") > 0)
    labels = R.apply_rule(base, usable).where(F.col("risk_class").isNotNull())
    return RuleEstimate(grid, pick, labels)


def frozen(pick: DataFrame) -> DataFrame:
    """The chosen rule as a flat one-row configuration."""
    return pick.select(
        "form",
        "tau1",
        "tau2",
        F.col("lower.gamma").alias("gamma"),
        F.col("lower.alpha").alias("alpha1"),
        F.col("lower.beta").alias("beta1"),
        F.col("upper.alpha").alias("alpha2"),
        F.col("upper.beta").alias("beta2"),
        F.col("lower.xs").alias("nodes_p"),
        F.col("lower.ys").alias("t1_nodes"),
        F.col("upper.ys").alias("t2_nodes"),
    )


FROZEN_SCHEMA = (
    "form string, tau1 double, tau2 double, gamma double, alpha1 double, beta1 double, alpha2 double, beta2 double, "
    "nodes_p array<double>, t1_nodes array<double>, t2_nodes array<double>"
)


def thawed(config: DataFrame) -> DataFrame:
    """A saved flat configuration back in the layout :func:`claimsieve.operators.rule.apply_rule` takes."""

    def curve(alpha: str, beta: str, ys: str):
        return F.struct(
            "gamma", F.col(alpha).alias("alpha"), F.col(beta).alias("beta"), F.col("nodes_p").alias("xs"), F.col(ys).alias("ys")
        )

    return config.select(
        "form",
        "tau1",
        "tau2",
        curve("alpha1", "beta1", "t1_nodes").alias("lower"),
        curve("alpha2", "beta2", "t2_nodes").alias("upper"),
    )
