"""Queries over the profiling, binning and histogram operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimsieve.catalog.common import LABEL_NUMERIC, hist, narrow, round_doubles, score
from claimsieve.catalog.registry import register
from claimsieve.catalog.sqltext import SCORE, qcut_cte, with_claims
from claimsieve.functions.expr import rounded
from claimsieve.operators import binning as B
from claimsieve.operators import profile as P
from claimsieve.operators import sketches as S
from claimsieve.operators.order import average_ranks, exact_quantiles
from claimsieve.session import materialize
from claimsieve.sources.claims import order_claims
from claimsieve.sources.schemas import NUMERIC

COLUMN_TYPES = {
    "claim_key": "bigint", "dataset": "string", "route_type": "string", "is_c2c": "int", "is_fresh": "int",
    "protect_amount": "double", "start_city": "int", "end_city": "int", "consigner_id": "bigint",
    "receiver_id": "bigint", "is_internal": "int", "overtime": "int", "abnormal_reason": "string",
    "source_channel": "string", "contact_delay": "int", "goods_category": "string", "goods_level": "int",
    "bc_source": "string", "customer_role": "string", "start_volume": "bigint", "start_accident_rate": "double",
    "start_claim_ratio": "double", "end_volume": "bigint", "end_accident_rate": "double",
    "end_claim_ratio": "double", "claim_amount": "double", "payout": "double",
}


def q(col: str, prob: float, digits: int = 6) -> str:
    return f"round(quantile_cont({col}, {prob!r}), {digits})"


@register(
    "profile_missing",
    with_claims(
        " union all ".join(
            f"select '{c}' as column_name, '{t}' as dtype, count(*) - count({c}) as n_missing, "
            f"round(100.0::double * (count(*) - count({c})) / count(*), 6) as pct_missing from claims"
            for c, t in COLUMN_TYPES.items()
        )
    ),
)
def profile_missing(spark, sf_dir):
    return round_doubles(P.profile_missing(order_claims(spark, sf_dir)))


@register(
    "profile_numeric",
    with_claims(
        " union all ".join(
            f"select '{c}' as column_name, count({c}) as n, round(avg({c}), 4) as mean, "
            f"round(stddev_samp({c}), 4) as std, cast(min({c}) as double) as min, cast(max({c}) as double) as max, "
            f"{q(c, .25)} as q25, {q(c, .5)} as q50, {q(c, .75)} as q75 from hist"
            for c in [*NUMERIC, "payout"]
        )
    ),
)
def profile_numeric(spark, sf_dir):
    return round_doubles(P.profile_numeric(narrow(spark, sf_dir, *NUMERIC, "payout"), [*NUMERIC, "payout"]), mean=4, std=4)


@register(
    "value_counts",
    with_claims(
        "select abnormal_reason as value, count(*) as n, (select count(distinct abnormal_reason) from hist) as n_distinct "
        "from hist group by 1 order by n desc, value nulls last limit 15"
    ),
)
def value_counts(spark, sf_dir):
    return P.value_counts(hist(spark, sf_dir), "abnormal_reason")


KEYED = ["start_city", "end_city", "consigner_id", "receiver_id", "abnormal_reason", "goods_category"]


@register(
    "approx_distinct",
    with_claims(" union all ".join(f"select '{c}' as column_name, count({c}) as n, count(distinct {c}) as n_exact, true as within_error from hist" for c in KEYED)),
)
def approx_distinct(spark, sf_dir):
    """Distinct values from sketches of each part, written and added up, against the exact counts: within four standard errors."""
    df = hist(spark, sf_dir).select("claim_key", *KEYED)
    parts = materialize(S.distinct_sketches(df, KEYED, F.col("claim_key") % 7), "sketches")
    exact = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.count_distinct(c).alias("n_exact")) for c in KEYED])))
    off = F.abs(F.col("n_distinct") - F.col("n_exact")) <= F.ceil(4 * S.distinct_error() * F.col("n_exact"))
    return S.merged_distinct(parts).join(exact, "column_name").select("column_name", "n", "n_exact", off.alias("within_error"))


GAP_PROBS = [0, 0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.85, 0.9, 0.95, 0.97, 0.98, 0.99, 0.999, 1]


@register(
    "quantile_vector",
    with_claims(
        " union all ".join(
            f"select {i}::int as idx, {p!r}::double as prob, {q('payout - claim_amount', p)} as q from hist"
            for i, p in enumerate(GAP_PROBS)
        )
    ),
)
def quantile_vector(spark, sf_dir):
    df = hist(spark, sf_dir).select((F.col("payout") - F.col("claim_amount")).alias("gap"))
    return round_doubles(exact_quantiles(df, "gap", GAP_PROBS))


PREDICATES = {
    "gap_positive": "payout - claim_amount > 0",
    "gap_zero": "payout - claim_amount = 0",
    "payout_above_claim": "payout > claim_amount",
    "payout_not_positive": "payout <= 0",
    "protect_negative": "protect_amount < 0",
    "protect_sentinel": "protect_amount = -1",
    "overtime_saturated": "overtime between 490 and 500",
    "contact_negative": "contact_delay < 0",
    "contact_far": "contact_delay > 200",
    "start_rate_negative": "start_accident_rate < 0",
    "excess_small": "excess <= 1000",
    "reason_returned": "abnormal_reason = 'R'",
}


@register(
    "predicate_rates",
    with_claims(
        " union all ".join(
            f"select '{n}' as predicate, count(*) filter (where {p}) as n, "
            f"round(100.0::double * count(*) filter (where {p}) / count(*), 6) as pct from hist"
            for n, p in PREDICATES.items()
        )
    ),
)
def predicate_rates(spark, sf_dir):
    return round_doubles(P.predicate_rates(hist(spark, sf_dir), {n: F.expr(p) for n, p in PREDICATES.items()}))


RANGE_COLUMNS = ["start_volume", "end_volume", "start_accident_rate", "end_accident_rate"]
RANGE_PROBS = {"q0": 0.0, "q50": 0.5, "q90": 0.9, "q99": 0.99, "q100": 1.0}


@register(
    "range_compare",
    with_claims(
        " union all ".join(
            f"select '{s}' as side, '{c}' as column_name, cast(min({c}) as double) as min, cast(max({c}) as double) as max, "
            + ", ".join(f"{q(c, p)} as {n}" for n, p in RANGE_PROBS.items())
            + f" from {t}"
            for s, t in (("a", "hist"), ("b", "score"))
            for c in RANGE_COLUMNS
        ),
        SCORE,
    ),
)
def range_compare(spark, sf_dir):
    return round_doubles(P.compare_ranges(hist(spark, sf_dir), score(spark, sf_dir), RANGE_COLUMNS, RANGE_PROBS))


BIN_PROBS = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q97": 0.97}


def _profile_sql(src: str, by: str, col: str, probs: dict, extra: str = "") -> str:
    quantiles = ", ".join(f"{q(col, p)} as {n}" for n, p in probs.items())
    return (
        f"select {by}, count(*) as n, round(min({col}), 6) as min, round(max({col}), 6) as max, {quantiles}{extra} "
        f"from {src} group by {by}"
    )


@register(
    "bin_profile",
    with_claims(
        _profile_sql("b10", "bin", "excess", BIN_PROBS, f", {q('payout', .5)} as payout_median"),
        qcut_cte("b10", "hist", "payout", 10),
    ),
)
def bin_profile(spark, sf_dir):
    binned = B.qcut(narrow(spark, sf_dir, "payout", "excess"), "payout", 10)
    return round_doubles(
        P.group_quantile_profile(binned, ["bin"], "excess", BIN_PROBS, {"payout_median": "payout"})
    )


RATIO_PROBS = {"q50": 0.5, "q75": 0.75, "q85": 0.85, "q90": 0.9, "q95": 0.95, "q97": 0.97, "q98": 0.98, "q99": 0.99, "q997": 0.997}


@register(
    "ratio_profile",
    with_claims(
        _profile_sql("rated", "bin", "ratio", RATIO_PROBS),
        qcut_cte("b10", "hist", "payout", 10),
        "rated as (select bin, payout / (payout + excess) as ratio from b10)",
    ),
)
def ratio_profile(spark, sf_dir):
    """Quantiles of the paid share of the claim by payout decile: level rows speak for a rule on the ratio."""
    binned = B.qcut(narrow(spark, sf_dir, "payout", "excess"), "payout", 10)
    rated = binned.withColumn("ratio", F.try_divide(F.col("payout"), F.col("payout") + F.col("excess")))
    return round_doubles(P.group_quantile_profile(rated, ["bin"], "ratio", RATIO_PROBS))


SLICE_PROBS = {"q50": 0.5, "q80": 0.8, "q85": 0.85, "q90": 0.9, "q95": 0.95, "q97": 0.97, "q99": 0.99}


@register(
    "slice_profile",
    with_claims(
        _profile_sql("sliced", "slice", "excess", SLICE_PROBS),
        "sliced as (select *, cast(ceil(payout / 1000.0) as int) - 1 as slice from hist where payout > 0)",
    ),
)
def slice_profile(spark, sf_dir):
    p = F.col("payout")
    sliced = hist(spark, sf_dir).where(p > 0).withColumn("slice", F.ceil(p / 1000.0).cast("int") - 1)
    return round_doubles(P.group_quantile_profile(sliced, ["slice"], "excess", SLICE_PROBS))


@register(
    "category_profile",
    with_claims(
        f"select goods_category, count(*) as n, {q('payout', .5)} as payout_median, {q('claim_amount', .5)} as claim_median "
        "from hist group by goods_category"
    ),
)
def category_profile(spark, sf_dir):
    out = P.group_quantile_profile(
        narrow(spark, sf_dir, "goods_category", "payout", "claim_amount"),
        ["goods_category"],
        "payout", {"payout_median": 0.5}, {"claim_median": "claim_amount"}
    )
    return round_doubles(out.drop("min", "max")).orderBy(F.desc("payout_median"))


@register(
    "equal_width_hist",
    with_claims(
        """select cast(i as int) as bin, round(case when i = 0 then lo - (hi - lo) * 0.001 else lo + (hi - lo) * i / 20 end, 6) as lo,
  round(lo + (hi - lo) * (i + 1) / 20, 6) as hi, count(x) as n
from r, generate_series(0, 19) g(i) left join v on x <= lo + (hi - lo) * (i + 1) / 20
  and x > case when i = 0 then lo - (hi - lo) * 0.001 else lo + (hi - lo) * i / 20 end
group by all""",
        "v as (select protect_amount as x from hist where protect_amount < 0)",
        "r as (select min(x) as lo, max(x) as hi from v)",
    ),
)
def equal_width_hist(spark, sf_dir):
    negative = hist(spark, sf_dir).where("protect_amount < 0")
    return round_doubles(B.equal_width_histogram(negative, "protect_amount", 20))


NUMPY_HISTS = {
    "excess": ("excess", "", "", 250.0, 60),
    "excess_over_payout": ("{d}", "excess", "payout", 0.05, 100),
    "payout_ratio": ("{d}", "payout", "(payout + excess)", 0.02, 50),
    "log_excess": ("ln(1 + excess)", "", "", 0.2, 60),
}


@register(
    "numpy_hist",
    with_claims(
        "select measure, cast(i as int) as bin, case when i >= 0 then round(i * w, 6) end as lo, "
        "case when i < k then round((i + 1) * w, 6) end as hi, count(x) as n "
        "from spec, generate_series(-1, 100) g(i) left join v on v.m = measure "
        "and case when i = -1 then x < 0 when i = k then x > k * w "
        "else x >= i * w and (x < (i + 1) * w or (i = k - 1 and x = k * w)) end where i <= k group by all",
        "spec as ("
        + " union all ".join(f"select '{n}' as measure, {w}::double as w, {k} as k" for n, (_, _, _, w, k) in NUMPY_HISTS.items())
        + ")",
        "v as (" + " union all ".join(f"select '{n}' as m, {e.format(d=f'({a} / nullif({b}, 0))')} as x from hist" for n, (e, a, b, _, _) in NUMPY_HISTS.items()) + ")",
    ),
)
def numpy_hist(spark, sf_dir):
    df, out = narrow(spark, sf_dir, "payout", "excess"), None
    for name, (expr, a, b, width, k) in NUMPY_HISTS.items():
        values = df.select(F.expr(expr.format(d=f"try_divide({a}, {b})")).alias("x"))
        one = B.histogram(values, "x", [i * width for i in range(k + 1)], closed="left", outside=True).withColumn("measure", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return round_doubles(out)


@register(
    "density_hist",
    with_claims(
        """select cast(i as int) as bin, round(i * 625.0::double, 6) as lo, round((i + 1) * 625.0::double, 6) as hi,
  round(count(*) filter (where side = 'a') / (any_value(na) * 625.0::double) * 1e6, 6) as density_a,
  round(count(*) filter (where side = 'b') / (any_value(nb) * 625.0::double) * 1e6, 6) as density_b
from generate_series(0, 63) g(i) cross join sizes left join v on x >= i * 625.0 and (x < (i + 1) * 625.0 or (i = 63 and x = 40000))
group by i""",
        SCORE,
        "gap as (select median(excess) as g from hist)",
        "pred as (select greatest(claim_amount - g, 0) as payout_hat from score, gap)",
        "v as (select 'a' as side, greatest(0, least(40000, payout)) as x from hist "
        "union all select 'b', greatest(0, least(40000, payout_hat)) from pred)",
        "sizes as (select (select count(*) from hist) as na, (select count(*) from pred) as nb)",
    ),
)
def density_hist(spark, sf_dir):
    from claimsieve.operators.order import quantile_scalar

    train = narrow(spark, sf_dir, "payout", "excess")
    gap = quantile_scalar(train, "excess")
    predicted = (
        score(spark, sf_dir)
        .withColumn("_g", gap)
        .select(F.greatest(F.col("claim_amount") - F.col("_g"), F.lit(0.0)).alias("payout_hat"))
    )
    out = B.density_histogram(train, predicted, "payout", "payout_hat", [i * 625.0 for i in range(65)])
    return out.select(
        "bin", "lo", "hi", *[rounded(F.col(c) * 1e6).alias(c) for c in ("density_a", "density_b")]
    )


DETREND_PROBS = {"q85": 0.85, "q95": 0.95, "q97": 0.97, "q99": 0.99}


@register(
    "ols_detrend",
    with_claims(
        "select bin, " + ", ".join(f"{q('residual', p, 4)} as {n}" for n, p in DETREND_PROBS.items()) + " from resid group by bin",
        qcut_cte("b10", "hist", "payout", 10),
        "line as (select regr_slope(excess, payout) as k, regr_intercept(excess, payout) as b from hist)",
        "resid as (select bin, excess - (k * payout + b) as residual from b10, line)",
    ),
)
def ols_detrend(spark, sf_dir):
    return round_doubles(P.detrended_profile(narrow(spark, sf_dir, "payout", "excess"), "excess", "payout", 10, DETREND_PROBS), 4)


@register(
    "spearman",
    with_claims(
        " union all ".join(f"select '{c}' as column_name, round(corr(r_{c}, r_payout), 6) as rho from ranked" for c in LABEL_NUMERIC),
        "ranked as (select "
        + ", ".join(
            f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double as r_{c}"
            for c in [*LABEL_NUMERIC, "payout"]
        )
        + " from hist)",
    ),
)
def spearman(spark, sf_dir):
    return round_doubles(P.spearman(narrow(spark, sf_dir, *LABEL_NUMERIC, "payout"), LABEL_NUMERIC, "payout"))


@register(
    "qcut",
    with_claims(
        " union all ".join(f"select {k}::int as k, claim_key, bin from b{k}" for k in (20, 10, 8)),
        *[qcut_cte(f"b{k}", "hist", "payout", k) for k in (20, 10, 8)],
    ),
)
def qcut(spark, sf_dir):
    df = narrow(spark, sf_dir, "claim_key", "payout")
    out = None
    for k in (20, 10, 8):
        one = B.qcut(df, "payout", k).select(F.lit(k).alias("k"), "claim_key", "bin")
        out = one if out is None else out.unionByName(one)
    return out


DUPLICATE_COLUMNS = ["l_orderkey", "l_linenumber"]


@register(
    "duplicates",
    "select 'claims' as source, count(*) as n_rows, cast(0 as bigint) as n_duplicates from ("
    + with_claims("select * from claims")
    + ") union all select 'lines', count(*), count(*) - count(distinct (l_orderkey, l_linenumber)) from lineitem",
)
def duplicates(spark, sf_dir):
    claims = order_claims(spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a = P.duplicate_rows(claims, claims.columns).withColumn("source", F.lit("claims"))
    b = P.duplicate_rows(lines, DUPLICATE_COLUMNS).withColumn("source", F.lit("lines"))
    return a.unionByName(b)


@register(
    "normalised_share",
    with_claims(
        "select dataset, source_channel, count(*) as n, "
        "round(count(*)::double / sum(count(*)) over (partition by dataset), 6) as share from claims group by 1, 2"
    ),
)
def normalised_share(spark, sf_dir):
    return round_doubles(P.normalised_share(order_claims(spark, sf_dir), ["dataset"], "source_channel"))


@register(
    "avg_rank",
    with_claims(
        "select distinct contact_delay, count(*) over (partition by contact_delay) as n, "
        "rank() over (order by contact_delay) + (count(*) over (partition by contact_delay) - 1) / 2.0::double as avg_rank from hist"
    ),
)
def avg_rank(spark, sf_dir):
    return average_ranks(hist(spark, sf_dir), "contact_delay")
