"""Queries over the cleaning and feature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimsieve.catalog.common import hist, raw_copy, round_doubles, score
from claimsieve.catalog.registry import register
from claimsieve.catalog.sqltext import SCORE, with_claims
from claimsieve.functions.expr import rounded
from claimsieve.operators import clean as C
from claimsieve.plans.features import feature_tables
from claimsieve.sources.claims import order_claims
from claimsieve.sources.schemas import CATEGORICAL, IDS, NUMERIC


@register(
    "drop_header_rows",
    with_claims(
        "select dataset, count(*) + 1 as n_rows, cast(1 as bigint) as n_removed, count(*) as n_kept "
        "from claims group by dataset"
    ),
)
def drop_header_rows(spark, sf_dir):
    out = None
    for name, df in (("history", hist(spark, sf_dir)), ("scoring", score(spark, sf_dir))):
        raw = raw_copy(df)
        kept = C.drop_embedded_header(raw, "route_type", "route_type").agg(F.count(F.lit(1)).alias("n_kept")).scalar()
        one = C.count_embedded_header(raw, "route_type", "route_type").select(
            F.lit(name).alias("dataset"), "n_rows", "n_removed", kept.alias("n_kept")
        )
        out = one if out is None else out.unionByName(one)
    return out


@register(
    "coerce_numeric",
    with_claims(
        " union all ".join(
            f"select '{c}' as column_name, count({c}) + 1 as n_present, cast(1 as bigint) as n_failed from claims"
            for c in NUMERIC
        )
    ),
)
def coerce_numeric(spark, sf_dir):
    return C.coercion_report(raw_copy(order_claims(spark, sf_dir)), NUMERIC)


@register(
    "neg_to_zero_flag",
    with_claims(
        "select claim_key, cast(protect_amount < 0 as int) as protect_negative, "
        "case when protect_amount < 0 then 0.0 else protect_amount end::double as protect_amount from claims"
    ),
)
def neg_to_zero_flag(spark, sf_dir):
    df = order_claims(spark, sf_dir).select("claim_key", "protect_amount")
    return C.zero_negative(df, "protect_amount", "protect_negative")


@register(
    "fill_categorical",
    with_claims(
        "select claim_key, coalesce(abnormal_reason,'NoReport') as abnormal_reason, "
        "coalesce(source_channel,'Unknown') as source_channel from claims"
    ),
)
def fill_categorical(spark, sf_dir):
    df = order_claims(spark, sf_dir).select("claim_key", "abnormal_reason", "source_channel")
    return C.fill_categorical(df, {"abnormal_reason": "NoReport", "source_channel": "Unknown"})


@register(
    "saturation_flag",
    with_claims("select claim_key, overtime, cast(overtime between 490 and 500 as int) as overtime_saturated from claims"),
)
def saturation_flag(spark, sf_dir):
    return order_claims(spark, sf_dir).select(
        "claim_key", "overtime", C.band_flag("overtime", 490, 500).alias("overtime_saturated")
    )


@register(
    "signed_log_abs",
    with_claims(
        "select claim_key, contact_delay, cast(contact_delay < 0 as int) as contact_delay_negative, "
        "round(ln(1 + abs(contact_delay)), 6) as contact_delay_logabs from claims"
    ),
)
def signed_log_abs(spark, sf_dir):
    df = order_claims(spark, sf_dir).select("claim_key", "contact_delay")
    return round_doubles(C.signed_log(df, "contact_delay", "contact_delay_negative", "contact_delay_logabs"))


@register(
    "neg_flags",
    with_claims(
        "select claim_key, cast(start_accident_rate < 0 as int) as start_accident_rate_negative, "
        "cast(end_accident_rate < 0 as int) as end_accident_rate_negative from claims"
    ),
)
def neg_flags(spark, sf_dir):
    cols = ["start_accident_rate", "end_accident_rate"]
    return C.negative_flags(order_claims(spark, sf_dir).select("claim_key", *cols), cols).drop(*cols)


CLIPPED = [
    "start_volume",
    "end_volume",
    "start_accident_rate",
    "end_accident_rate",
    "start_claim_ratio",
    "end_claim_ratio",
    "protect_amount",
]


@register(
    "clip_log1p",
    with_claims(
        "select claim_key, "
        + ", ".join(f"round(ln(1 + greatest({c}, 0)), 6) as {c}_log1p" for c in CLIPPED)
        + " from claims"
    ),
)
def clip_log1p(spark, sf_dir):
    df = order_claims(spark, sf_dir).select("claim_key", *CLIPPED)
    return round_doubles(C.clipped_log(df, CLIPPED).drop(*CLIPPED))


@register(
    "claim_floor",
    with_claims(
        "select claim_key, round(ln(1 + claim_amount), 6) as claim_amount_log1p, "
        "cast(claim_amount <= 100.001 as int) as claim_amount_at_floor from claims"
    ),
)
def claim_floor(spark, sf_dir):
    df = order_claims(spark, sf_dir).select("claim_key", "claim_amount")
    return round_doubles(C.floor_flag(df, "claim_amount").drop("claim_amount"))


@register(
    "cast_categories",
    with_claims("select claim_key, " + ", ".join(f"cast({c} as varchar) as {c}" for c in CATEGORICAL) + " from claims"),
)
def cast_categories(spark, sf_dir):
    return C.as_category(order_claims(spark, sf_dir).select("claim_key", *CATEGORICAL), CATEGORICAL)


@register(
    "derive_target",
    with_claims(
        "select claim_key, round(payout - claim_amount, 6) as gap, round(claim_amount - payout, 6) as excess, "
        "round(payout / claim_amount, 6) as ratio from hist"
    ),
)
def derive_target(spark, sf_dir):
    df = hist(spark, sf_dir).select("claim_key", "claim_amount", "payout")
    return round_doubles(C.derive_target(df).drop("claim_amount", "payout"))


@register(
    "assert_not_null",
    with_claims("select count(*) as n_rows, round(sum(payout), 2) as total_payout from hist"),
)
def assert_not_null(spark, sf_dir):
    raw = C.drop_embedded_header(raw_copy(hist(spark, sf_dir)), "route_type", "route_type")
    checked = C.require_not_null(C.coerce(raw, ["payout"]), "payout")
    return checked.agg(F.count("payout").alias("n_rows"), rounded(F.sum("payout"), 2).alias("total_payout"))


def _feature_sql() -> str:
    numeric = [c for c in NUMERIC if c != "protect_amount"]
    cats = {
        "abnormal_reason": "coalesce(abnormal_reason,'NoReport')",
        "source_channel": "coalesce(source_channel,'Unknown')",
    }
    cols = ["claim_key", "dataset", *IDS]
    cols += [f"cast({c} as double) as {c}" for c in numeric]
    cols += [f"{cats.get(c, f'cast({c} as varchar)')} as {c}" for c in CATEGORICAL]
    cols += [
        "case when protect_amount < 0 then 0 else protect_amount end::double as protect_amount",
        "cast(protect_amount < 0 as int) as protect_negative",
        "cast(overtime between 490 and 500 as int) as overtime_saturated",
        "cast(contact_delay < 0 as int) as contact_delay_negative",
        "round(ln(1 + abs(contact_delay)), 6) as contact_delay_logabs",
        "cast(start_accident_rate < 0 as int) as start_accident_rate_negative",
        "cast(end_accident_rate < 0 as int) as end_accident_rate_negative",
        *[f"round(ln(1 + greatest({c}, 0)), 6) as {c}_log1p" for c in CLIPPED],
        "round(ln(1 + claim_amount), 6) as claim_amount_log1p",
        "cast(claim_amount <= 100.001 as int) as claim_amount_at_floor",
        *[f"cast(count(*) over (partition by {c}) as double) as {c}_freq" for c in IDS],
        "cast(count(*) over (partition by abnormal_reason) as double) as abnormal_reason_freq",
        "cast(count(*) over (partition by goods_category) as double) as goods_category_freq",
        "cast(count(*) over (partition by start_city, end_city) as double) as city_pair_freq",
        "case when dataset='history' then payout end as payout",
        "case when dataset='history' then round(payout - claim_amount, 6) end as gap",
        "case when dataset='history' then round(claim_amount - payout, 6) end as excess",
        "case when dataset='history' then round(payout / claim_amount, 6) end as ratio",
    ]
    return with_claims("select " + ", ".join(cols) + " from claims")


@register("clean_features", _feature_sql())
def clean_features(spark, sf_dir):
    train, target = feature_tables(order_claims(spark, sf_dir))
    return round_doubles(train.unionByName(target, allowMissingColumns=True))
