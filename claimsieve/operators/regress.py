"""Payout baselines and regression metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsieve.operators.order import quantile_scalar


def regression_metrics(df: DataFrame, y: str = "payout", yhat: str = "payout_hat", by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, MAPE, MAPE over payouts of at least 1, and WAPE of predictions clamped at 0.  One pass."""
    target = F.col(y)
    error = F.abs(target - F.greatest(F.col(yhat), F.lit(0.0)))
    share = F.try_divide(error, target)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(error).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(share) * 100).alias("mape_all"),
        (F.avg(F.when(target >= 1, share)) * 100).alias("mape_ge1"),
        (F.try_divide(F.sum(error), F.sum(target)) * 100).alias("wape"),
    )


def median_baseline(train: DataFrame, df: DataFrame | None = None, y: str = "payout") -> DataFrame:
    """Predict the global median payout."""
    return (train if df is None else df).withColumn("payout_hat", quantile_scalar(train, y))


def loglog_baseline(
    train: DataFrame, df: DataFrame | None = None, y: str = "payout", x: str = "claim_amount"
) -> DataFrame:
    """``exp(intercept + slope * ln(claim))`` fitted by least squares on the logs."""
    logs = train.select(F.ln(y).alias("ly"), F.ln(x).alias("lx"))
    line = logs.agg(
        F.struct(F.regr_intercept("ly", "lx").alias("a"), F.regr_slope("ly", "lx").alias("b")).alias("line")
    ).scalar()
    out = (train if df is None else df).withColumn("_line", line)
    return out.withColumn("payout_hat", F.exp(F.col("_line.a") + F.col("_line.b") * F.ln(x))).drop("_line")


def gap_baseline(
    train: DataFrame, df: DataFrame | None = None, x: str = "claim_amount", excess: str = "excess", clamp: bool = False
) -> DataFrame:
    """Claimed amount minus the median excess."""
    out = (train if df is None else df).withColumn("_gap", quantile_scalar(train, excess))
    value: Column = F.col(x) - F.col("_gap")
    return out.withColumn("payout_hat", F.greatest(value, F.lit(0.0)) if clamp else value).drop("_gap")


def share_baselines(df: DataFrame, shares: Sequence[float], x: str = "claim_amount") -> DataFrame:
    """Every row once per constant share of the claim, with ``config``, ``share`` and ``payout_hat``; one pass for all shares."""
    grid = F.array(*[F.struct(F.lit(i).alias("config"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)])
    return df.select("*", F.inline(grid)).withColumn("payout_hat", F.col(x) * F.col("share"))


def freeze_trees(iterations: DataFrame, col: str = "best_iteration", lo: int = 100, hi: int = 2000) -> DataFrame:
    """Number of trees of the final refit: 1.2 times the median best iteration, within limits."""
    middle = F.floor(F.percentile(col, 0.5))  # one row per fold, so the buffer is bounded by the number of folds
    return iterations.agg(F.least(F.lit(hi), F.greatest(F.lit(lo), F.floor(middle * 1.2))).cast("int").alias("n_trees"))
