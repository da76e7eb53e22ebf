"""Profiling reports.  Single-pass aggregates where possible; quantiles are exact and distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsieve.functions.expr import nan_to_null, null_safe_join
from claimsieve.operators.binning import qcut
from claimsieve.operators.order import average_ranks, positions, quantile_columns, quantile_table
from claimsieve.session import materialize


def _one_row_long(df: DataFrame, measures: list[Column]) -> DataFrame:
    """Run all measures in one aggregation and turn the single row into one row per measure."""
    return df.agg(F.array(*measures).alias("m")).select(F.inline("m"))


def profile_missing(df: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    measures = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.count_if(F.col(f.name).isNull()).alias("n_missing"),
            (F.try_divide(F.count_if(F.col(f.name).isNull()), total) * 100).alias("pct_missing"),
        )
        for f in df.schema.fields
    ]
    return _one_row_long(df, measures)


def long_form(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(keep…, column_name, value)`` with the values as double."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in cols]
    return df.select(*keep, F.inline(F.array(*cells)))


def profile_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    moments = _one_row_long(
        df,
        [
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            )
            for c in cols
        ],
    )
    quartiles = quantile_columns(
        long_form(df, cols), "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["column_name"]
    )
    return moments.join(quartiles, "column_name", "left")


def value_counts(df: DataFrame, col: str, k: int = 15) -> DataFrame:
    """Top-k values including null, ties by value, with the number of distinct non-null values."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    distinct = counts.agg(F.count("value").alias("d")).scalar()
    return counts.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(k).withColumn("n_distinct", distinct)


def predicate_rates(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Number and share of rows per named predicate; an unknown predicate counts as false."""
    total = F.count(F.lit(1))
    return _one_row_long(
        df,
        [
            F.struct(
                F.lit(name).alias("predicate"),
                F.count_if(p).alias("n"),
                (F.try_divide(F.count_if(p), total) * 100).alias("pct"),
            )
            for name, p in predicates.items()
        ],
    )


def compare_ranges(a: DataFrame, b: DataFrame, cols: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Minimum, maximum and quantiles of the same columns in two tables."""
    both = (
        long_form(a, cols).withColumn("side", F.lit("a")).unionByName(long_form(b, cols).withColumn("side", F.lit("b")))
    )
    keys = ["side", "column_name"]
    ends = both.groupBy(*keys).agg(F.min("value").alias("min"), F.max("value").alias("max"))
    return ends.join(quantile_columns(both, "value", probs, keys), keys)


def group_quantile_profile(
    df: DataFrame, by: Sequence[str], col: str, probs: dict[str, float], medians: dict[str, str] | None = None
) -> DataFrame:
    """Per group: row count, minimum, maximum, quantiles of ``col`` and medians of further columns."""
    basic = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("min"), F.max(col).alias("max"))
    wanted = {n: (col, p) for n, p in probs.items()} | {n: (c, 0.5) for n, c in (medians or {}).items()}
    return null_safe_join(basic, quantile_table(df, wanted, by), by, "left")


def fitted_line(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least-squares line in one pass: one row ``(slope, intercept)``."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def detrend(df: DataFrame, y: str, x: str, name: str = "residual") -> DataFrame:
    line = fitted_line(df, y, x).select(F.struct("slope", "intercept").alias("l")).scalar()
    return (
        df.withColumn("_l", line)
        .withColumn(name, F.col(y) - (F.col("_l.slope") * F.col(x) + F.col("_l.intercept")))
        .drop("_l")
    )


def detrended_profile(df: DataFrame, y: str, x: str, k: int, probs: dict[str, float]) -> DataFrame:
    return quantile_columns(qcut(detrend(df, y, x), x, k), "residual", probs, ["bin"])


def _missing_patterns(named: DataFrame, cols: Sequence[str]) -> list[list[str]]:
    """Columns that lack a value in the same rows, by the count and the sum of row hashes of those rows."""
    row = F.xxhash64(*named.columns).cast("decimal(20,0)")
    lacks = {c: nan_to_null(F.col(c).cast("double")).isNull() for c in cols}
    found = named.agg(*[F.struct(F.count_if(m).alias("n"), F.sum(F.when(m, row)).alias("h")).alias(c) for c, m in lacks.items()]).first()
    groups: dict[tuple, list[str]] = {}
    for c in cols:
        groups.setdefault(tuple(found[c]), []).append(c)
    return list(groups.values())


def spearman(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Rank correlation of each column with ``target``, ties at their average rank.

    Both are ranked over the rows in which both are there (neither null nor NaN); a column without such rows has no row
    here, and one without spread a null.  The target is ranked once for all columns that lack a value in the same rows, so
    once if none does.  A column's ranks are needed only per distinct value, and the covariance only the sum of target
    ranks per distinct value, so rows are pre-aggregated before they move.
    """
    named = df.select(F.col(target).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in cols])
    named = materialize(named.where(nan_to_null("_y").isNotNull()), "pairs")
    counts = None
    for alike in _missing_patterns(named, cols):
        rows = named.where(nan_to_null(alike[0]).isNotNull()).select("_y", *alike)
        ranks = average_ranks(rows, "_y").select("_y", F.col("avg_rank").alias("_ry"))
        part = long_form(rows.join(ranks, "_y"), alike, ["_ry"]).groupBy("column_name", "value").agg(
            F.count(F.lit(1)).alias("n"), F.sum("_ry").alias("s"), F.sum(F.col("_ry") * F.col("_ry")).alias("s2")
        )
        counts = part if counts is None else counts.unionByName(part)
    ranked = positions(materialize(counts, "values"), "value", "n", ["column_name"]).withColumn(
        "rx", F.col("before") + (F.col("n") + 1) / 2.0
    )
    n, rx = F.col("n"), F.col("rx")
    sums = ranked.groupBy("column_name").agg(
        F.sum("n").alias("m"),
        F.sum(rx * n).alias("sx"),
        F.sum("s").alias("sy"),
        F.sum(rx * rx * n).alias("sxx"),
        F.sum("s2").alias("syy"),
        F.sum(rx * F.col("s")).alias("sxy"),
    )
    m = F.col("m")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / m
    spread = F.sqrt((F.col("sxx") - F.col("sx") ** 2 / m) * (F.col("syy") - F.col("sy") ** 2 / m))
    return sums.select("column_name", F.try_divide(cov, spread).alias("rho")).orderBy(
        F.desc(F.abs("rho")), "column_name"
    )


def duplicate_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each group of equal rows.  Counted per distinct row, so copies never meet in one task."""
    return (
        df.groupBy(*cols)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))
    )


def normalised_share(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Share of every value (null included) within its group."""
    counts = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    return null_safe_join(counts, totals, by).withColumn("share", F.col("n") / F.col("_total")).drop("_total")
