"""Cleaning and feature derivation: row-local expressions, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsieve.functions.expr import as_col, flag, nan_to_null
from claimsieve.sources.schemas import CATEGORICAL, NUMERIC


def drop_embedded_header(df: DataFrame, col: str, token: str) -> DataFrame:
    """Drop rows that repeat the variable names; rows whose sentinel column is null stay."""
    return df.where(~F.col(col).eqNullSafe(token))


def count_embedded_header(df: DataFrame, col: str, token: str) -> DataFrame:
    hit = F.col(col).eqNullSafe(token)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(hit).alias("n_removed"))


def to_double(c: Column | str) -> Column:
    """Bad text, an empty cell and NaN all become null."""
    return nan_to_null(as_col(c).try_cast("double"))


def coerce(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_double(c) for c in cols})


def coercion_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: values present before the cast, and how many of them could not be cast.  One pass."""
    measures = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count(F.col(c)).alias("n_present"),
            F.count_if(F.col(c).isNotNull() & to_double(c).isNull()).alias("n_failed"),
        )
        for c in cols
    ]
    return df.agg(F.array(*measures).alias("m")).select(F.inline("m"))


def zero_negative(df: DataFrame, col: str, flag_name: str) -> DataFrame:
    """The flag is taken before the value is replaced, so always start from the raw value."""
    return df.withColumns({flag_name: flag(F.col(col) < 0), col: F.when(F.col(col) < 0, 0.0).otherwise(F.col(col))})


def fill_categorical(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    return df.fillna(defaults)


def band_flag(c: Column | str, lo: float, hi: float) -> Column:
    """1 inside the closed band."""
    return flag(as_col(c).between(lo, hi))


def signed_log(df: DataFrame, col: str, flag_name: str, log_name: str) -> DataFrame:
    return df.withColumns({flag_name: flag(F.col(col) < 0), log_name: F.log1p(F.abs(col))})


def negative_flags(df: DataFrame, cols: Sequence[str], suffix: str = "_negative") -> DataFrame:
    return df.withColumns({c + suffix: flag(F.col(c) < 0) for c in cols})


def clipped_log(df: DataFrame, cols: Sequence[str], suffix: str = "_log1p") -> DataFrame:
    return df.withColumns({c + suffix: F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in cols})


def floor_flag(df: DataFrame, col: str, floor: float = 100.0, eps: float = 0.001) -> DataFrame:
    return df.withColumns({col + "_log1p": F.log1p(col), col + "_at_floor": flag(F.col(col) <= floor + eps)})


def as_category(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def derive_target(df: DataFrame, claim: str = "claim_amount", payout: str = "payout") -> DataFrame:
    gap = F.col(payout) - F.col(claim)
    return df.withColumns({"gap": gap, "excess": -gap, "ratio": F.try_divide(F.col(payout), F.col(claim))})


def require_not_null(df: DataFrame, col: str) -> DataFrame:
    """Fail the job that reads ``df`` on the first null in ``col``; checked in the same pass, no extra scan."""
    message = F.lit(f"column {col} has a value that could not be converted")
    checked = F.when(F.col(col).isNull(), F.raise_error(message).cast(df.schema[col].dataType)).otherwise(F.col(col))
    return df.withColumn(col, checked)


def clean(
    df: DataFrame,
    saturation: tuple[float, float] = (490.0, 500.0),
    claim_floor: float = 100.0,
    defaults: dict[str, str] | None = None,
) -> DataFrame:
    """Every cleaning step in order, one projection over raw claims.  Adds the row-local derived columns."""
    steps = [
        lambda d: coerce(d, NUMERIC),
        lambda d: zero_negative(d, "protect_amount", "protect_negative"),
        lambda d: fill_categorical(d, defaults or {"abnormal_reason": "NoReport", "source_channel": "Unknown"}),
        lambda d: d.withColumn("overtime_saturated", band_flag("overtime", *saturation)),
        lambda d: signed_log(d, "contact_delay", "contact_delay_negative", "contact_delay_logabs"),
        lambda d: negative_flags(d, ["start_accident_rate", "end_accident_rate"]),
        lambda d: clipped_log(
            d,
            [
                "start_volume",
                "end_volume",
                "start_accident_rate",
                "end_accident_rate",
                "start_claim_ratio",
                "end_claim_ratio",
                "protect_amount",
            ],
        ),
        lambda d: floor_flag(d, "claim_amount", claim_floor),
        lambda d: as_category(d, CATEGORICAL),
    ]
    return reduce(lambda d, step: step(d), steps, df)
