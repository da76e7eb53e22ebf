"""Raw claims to the feature tables of history and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame

from claimsieve.operators.clean import clean, derive_target, require_not_null
from claimsieve.operators.encode import fit_frequencies, freq_encode
from claimsieve.sources.claims import scoring
from pyspark.sql import functions as F

FREQUENCY_KEYS = {
    "start_city": ["start_city"],
    "end_city": ["end_city"],
    "consigner_id": ["consigner_id"],
    "receiver_id": ["receiver_id"],
    "abnormal_reason": ["abnormal_reason"],
    "goods_category": ["goods_category"],
    "city_pair": ["start_city", "end_city"],
}

NUMERIC_FEATURES = [
    "protect_amount",
    "protect_amount_log1p",
    "protect_negative",
    "overtime",
    "overtime_saturated",
    "contact_delay",
    "contact_delay_negative",
    "contact_delay_logabs",
    "claim_amount",
    "claim_amount_log1p",
    "claim_amount_at_floor",
    "start_volume",
    "start_volume_log1p",
    "start_accident_rate",
    "start_accident_rate_log1p",
    "start_accident_rate_negative",
    "start_claim_ratio",
    "start_claim_ratio_log1p",
    "end_volume",
    "end_volume_log1p",
    "end_accident_rate",
    "end_accident_rate_log1p",
    "end_accident_rate_negative",
    "end_claim_ratio",
    "end_claim_ratio_log1p",
    *[f"{k}_freq" for k in FREQUENCY_KEYS],
]


def feature_tables(claims: DataFrame, scope: str = "union") -> tuple[DataFrame, DataFrame]:
    """``(history, scoring)`` with every derived column.

    Both sides are cleaned in one projection and share one frequency dictionary, fitted on both tables
    (``scope='union'``) or on history alone (``scope='train'``).
    """
    cleaned = clean(claims)
    is_history = F.col("dataset") == "history"
    dictionary = fit_frequencies(cleaned.where(is_history), cleaned.where(~is_history), FREQUENCY_KEYS, scope)
    encoded = freq_encode(cleaned, dictionary, FREQUENCY_KEYS, default={"city_pair": 1.0})
    train = derive_target(require_not_null(encoded.where(is_history), "payout"))
    return train, scoring(encoded)
