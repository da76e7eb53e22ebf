"""Queries over splits, baselines, imbalance treatments and metrics, on predictions SQL can reproduce."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimsieve.catalog.common import hist, round_doubles, score
from claimsieve.catalog.registry import register
from claimsieve.catalog.rules import B20, LINEAR, NODES, POWER, base
from claimsieve.catalog.sqltext import SCORE, qcut_cte, with_claims
from claimsieve.functions.expr import argmax
from claimsieve.operators import classify as N
from claimsieve.operators import folds as W
from claimsieve.operators import regress as G
from claimsieve.operators import rule as R
from claimsieve.operators.binning import qcut
from claimsieve.operators.order import quantile_columns
from claimsieve.session import materialize

LABELLED = [B20, NODES, POWER, LINEAR]
ORDER = "md5(claim_key || '|2025')"


def history_and_rule(spark, sf_dir):
    """Key, claim amount, payout and excess of history, and the linear rule on it, each written once."""
    df = materialize(hist(spark, sf_dir).select("claim_key", "claim_amount", "payout", "excess"), "claims")
    return df, materialize(R.linear_rule(df), "rule")


def labelled(spark, sf_dir, known=None):
    """Key, claim amount, payout, excess and rule label of history; ``known`` is :func:`history_and_rule`, if made before."""
    df, rule = known or history_and_rule(spark, sf_dir)
    return materialize(R.apply_rule(df, rule), "labels")


@register("kfold", with_claims(f"select claim_key, cast((row_number() over (order by {ORDER}) - 1) % 5 as int) as fold from hist"))
def kfold(spark, sf_dir):
    return W.kfold(hist(spark, sf_dir).select("claim_key"))


@register(
    "stratified_kfold",
    with_claims(
        f"select claim_key, risk_class, cast((row_number() over (partition by risk_class order by {ORDER}) - 1) % 5 as int) as fold "
        "from labelled",
        *LABELLED,
    ),
)
def stratified_kfold(spark, sf_dir):
    return W.stratified_kfold(labelled(spark, sf_dir).select("claim_key", "risk_class"), "risk_class")


@register(
    "holdout",
    with_claims(
        f"select claim_key, cast(row_number() over (order by {ORDER}) - 1 < ceil(0.2::double * count(*) over ()) as int) as is_holdout from hist"
    ),
)
def holdout(spark, sf_dir):
    return W.holdout(hist(spark, sf_dir).select("claim_key"))


METRICS_SQL = """select count(*) as n, round(avg(e), 4) as mae, round(sqrt(avg(e * e)), 4) as rmse,
  round(100 * avg(e / payout), 4) as mape_all, round(100 * avg(e / payout) filter (where payout >= 1), 4) as mape_ge1,
  round(100 * sum(e) / sum(payout), 4) as wape
from (select payout, abs(payout - greatest(payout_hat, 0)) as e from pred)"""


@register(
    "regression_metrics",
    with_claims(
        METRICS_SQL.replace("select count(*)", "select fold, count(*)", 1).replace("select payout,", "select fold, payout,")
        + " group by fold",
        "pred as (select payout, claim_amount - (select median(excess) from hist) as payout_hat, "
        f"cast((row_number() over (order by {ORDER}) - 1) % 5 as int) as fold from hist)",
    ),
)
def regression_metrics(spark, sf_dir):
    df = materialize(hist(spark, sf_dir).select("claim_key", "claim_amount", "payout", "excess"), "claims")
    return round_doubles(G.regression_metrics(W.kfold(G.gap_baseline(df)), by=["fold"]), 4)


@register(
    "median_baseline",
    with_claims(METRICS_SQL, "pred as (select payout, (select median(payout) from hist) as payout_hat from hist)"),
)
def median_baseline(spark, sf_dir):
    df = hist(spark, sf_dir).select("claim_key", "claim_amount", "payout", "excess")
    return round_doubles(G.regression_metrics(G.median_baseline(df)), 4)


@register(
    "loglog_baseline",
    with_claims(
        METRICS_SQL,
        "line as (select regr_intercept(ln(payout), ln(claim_amount)) as a, regr_slope(ln(payout), ln(claim_amount)) as b from hist)",
        "pred as (select payout, exp(a + b * ln(claim_amount)) as payout_hat from hist, line)",
    ),
)
def loglog_baseline(spark, sf_dir):
    df = hist(spark, sf_dir).select("claim_key", "claim_amount", "payout", "excess")
    return round_doubles(G.regression_metrics(G.loglog_baseline(df)), 4)


@register(
    "median_gap_baseline",
    with_claims(
        "select round(avg(abs(excess - g)), 4) as mae, round(any_value(g), 6) as median_excess from hist, (select median(excess) as g from hist)"
    ),
)
def median_gap_baseline(spark, sf_dir):
    df = hist(spark, sf_dir).select("claim_amount", "payout", "excess")
    predicted = G.gap_baseline(df)
    out = predicted.agg(
        F.avg(F.abs(F.col("payout") - F.col("payout_hat"))).alias("mae"),
        F.max(F.col("claim_amount") - F.col("payout_hat")).alias("median_excess"),
    )
    return round_doubles(out, 4, median_excess=6)


@register(
    "freeze_trees",
    with_claims(
        "select cast(least(2000, greatest(100, floor(floor(median(best_iteration)) * 1.2))) as int) as n_trees from it",
        f"f as (select excess, cast((row_number() over (order by {ORDER}) - 1) % 5 as int) as fold from hist)",
        "it as (select fold, count(*) filter (where excess > 5000) as best_iteration from f group by fold)",
    ),
)
def freeze_trees(spark, sf_dir):
    folds = W.kfold(hist(spark, sf_dir).select("claim_key", "excess"))
    iterations = folds.groupBy("fold").agg(F.count_if(F.col("excess") > 5000).alias("best_iteration"))
    return G.freeze_trees(iterations)


@register(
    "class_weights",
    with_claims(
        "select risk_class, count(*) as n, round((select count(*) from labelled)::double / (3 * count(*)), 6) as weight "
        "from labelled group by risk_class",
        *LABELLED,
    ),
)
def class_weights(spark, sf_dir):
    weighted = N.balanced_weights(labelled(spark, sf_dir).select("claim_key", "risk_class"))
    return round_doubles(
        weighted.groupBy("risk_class").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))
    )


@register(
    "oversample",
    with_claims(
        """select claim_key, risk_class, cast(unnest(range(1, 2 + extra // own + (o < extra % own)::int)) as int) as copy from sized""",
        *LABELLED,
        "counted as (select claim_key, risk_class, count(*) over (partition by risk_class) as own, "
        f"row_number() over (partition by risk_class order by {ORDER}) - 1 as o, "
        "count(*) filter (where risk_class = 0) over () as n0 from labelled)",
        "sized as (select *, case when risk_class = 0 then 0 else greatest(cast(round_even(n0 * 0.5, 0) as bigint) - own, 0) end as extra from counted)",
    ),
)
def oversample(spark, sf_dir):
    return N.oversample(labelled(spark, sf_dir).select("claim_key", "risk_class"), {1: 0.5, 2: 0.5})


PROBABILITIES = """
proba as (select claim_key, risk_class, payout / claim_amount as p0, (1 - payout / claim_amount) * 0.75 as p1,
    (1 - payout / claim_amount) * 0.25 as p2 from labelled),
pri as (select count(*) filter (where risk_class = 0)::double / count(*) as c0, count(*) filter (where risk_class = 1)::double / count(*) as c1,
    count(*) filter (where risk_class = 2)::double / count(*) as c2 from labelled),
raw as (select claim_key, risk_class, w, p0 / pow(c0, w) as q0, p1 / pow(c1, w) as q1, p2 / pow(c2, w) as q2
    from proba, pri, (values (0.25::double), (0.5), (1.0)) ws(w)),
corr as (select *, case when q0 >= q1 and q0 >= q2 then 0 when q1 >= q2 then 1 else 2 end as predicted, q0 + q1 + q2 as t from raw)"""


def probabilities(df):
    """A probability table both engines compute alike: the paid share for class 0, the rest split 3 to 1."""
    r = F.col("payout") / F.col("claim_amount")
    return df.withColumn("probability", F.array(r, (1 - r) * 0.75, (1 - r) * 0.25))


@register(
    "prior_correction",
    with_claims(
        "select w, claim_key, round(q0 / t, 6) as p0, round(q1 / t, 6) as p1, round(q2 / t, 6) as p2, cast(predicted as int) as predicted from corr",
        *LABELLED,
        PROBABILITIES,
    ),
)
def prior_correction(spark, sf_dir):
    df = labelled(spark, sf_dir)
    table = probabilities(df)
    priors = N.class_priors(df)
    out = None
    for w in (0.25, 0.5, 1.0):
        one = N.prior_correct(table, priors, w).select(
            F.lit(w).alias("w"),
            "claim_key",
            *[F.get("corrected", F.lit(k)).alias(f"p{k}") for k in N.CLASSES],
            "predicted",
        )
        out = one if out is None else out.unionByName(one)
    return round_doubles(out)


PREDICTED = f"""
scored as (select claim_key, risk_class, cast(predicted as int) as predicted,
    cast((row_number() over (partition by risk_class order by {ORDER}) - 1) % 5 as int) as fold from corr where w = 1.0)"""
GIVEN = [*LABELLED, PROBABILITIES, PREDICTED]


def predicted(spark, sf_dir, known=None):
    df = labelled(spark, sf_dir, known)
    return materialize(
        W.stratified_kfold(
            N.prior_correct(probabilities(df), N.class_priors(df), 1.0).select("claim_key", "risk_class", "predicted"),
            "risk_class",
        ),
        "predicted",
    )


@register(
    "confusion",
    with_claims(
        "select cast(t as int) as true_class, "
        + ", ".join(f"count(claim_key) filter (where predicted = {p}) as pred_{p}" for p in N.CLASSES)
        + " from (values (0), (1), (2)) v(t) left join scored on risk_class = t group by t",
        *GIVEN,
    ),
)
def confusion(spark, sf_dir):
    return N.confusion(predicted(spark, sf_dir))


def _metric_sql(src: str, by: str = "") -> str:
    g, c = (f"group by {by}", f"{by}, ") if by else ("", "")
    parts = [
        f"""select {c}{k} as risk_class, count(*) filter (where risk_class = {k} and predicted = {k}) as tp,
  count(*) filter (where risk_class = {k}) as t, count(*) filter (where predicted = {k}) as p,
  count(*) filter (where risk_class = predicted) as hits, count(*) as n from {src} {g}"""
        for k in N.CLASSES
    ]
    over = f"partition by {by}" if by else ""
    return f"""
cm as ({" union all ".join(parts)}),
per_class as (select {c}cast(risk_class as int) as risk_class, coalesce(tp::double / nullif(p, 0), 0) as precision,
  coalesce(tp::double / nullif(t, 0), 0) as recall, coalesce(2.0::double * tp / nullif(t + p, 0), 0) as f1, t as support,
  hits::double / n as accuracy, avg(coalesce(2.0::double * tp / nullif(t + p, 0), 0)) over ({over}) as macro_f1 from cm)"""


CLASS_METRICS = (
    "select risk_class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support, "
    "round(accuracy, 6) as accuracy, round(macro_f1, 6) as macro_f1 from per_class"
)


@register("class_metrics", with_claims(CLASS_METRICS, *GIVEN, _metric_sql("scored")))
def class_metrics(spark, sf_dir):
    return round_doubles(N.class_metrics(predicted(spark, sf_dir)))


@register(
    "fold_summary",
    with_claims(
        "select round(avg(macro_f1), 6) as macro_f1_mean, round(stddev_pop(macro_f1), 6) as macro_f1_std, "
        "round(avg(accuracy), 6) as accuracy_mean, round(avg(recall), 6) as severe_recall_mean from per_class where risk_class = 2",
        *GIVEN,
        _metric_sql("scored", "fold"),
    ),
)
def fold_summary(spark, sf_dir):
    return round_doubles(N.fold_summary(predicted(spark, sf_dir)))


@register(
    "majority_baseline",
    with_claims(
        CLASS_METRICS, *LABELLED, "const as (select risk_class, 0 as predicted from labelled)", _metric_sql("const")
    ),
)
def majority_baseline(spark, sf_dir):
    return round_doubles(N.majority_baseline(labelled(spark, sf_dir)))


ROUTE_B = """
pb as (select claim_key, risk_class, greatest(claim_amount - (select median(excess) from hist), 0) as p_hat, claim_amount from labelled),
ub as (select *, greatest(claim_amount - p_hat, 0) as u_hat from pb),
route as (select claim_key, risk_class, cast(case when floor(u_hat * 1e6 + 0.5) <= floor((alpha1 + beta1 * greatest(p_hat, 1e-9)) * 1e6 + 0.5) then 0
    when floor(u_hat * 1e6 + 0.5) <= floor((alpha2 + beta2 * greatest(p_hat, 1e-9)) * 1e6 + 0.5) then 1 else 2 end as int) as predicted
    from ub, rule)"""


def route_b_given(spark, sf_dir, known=None):
    from claimsieve.plans.score import route_b

    df, rule = known or history_and_rule(spark, sf_dir)
    truth = R.apply_rule(df, rule).select("claim_key", "risk_class")
    return route_b(G.gap_baseline(df, clamp=True), rule).join(truth, "claim_key")


@register("route_b", with_claims("select claim_key, risk_class, predicted from route", *LABELLED, ROUTE_B))
def route_b_query(spark, sf_dir):
    return route_b_given(spark, sf_dir).select("claim_key", "risk_class", "predicted")


@register(
    "route_compare_given",
    with_claims(
        "select route, " + CLASS_METRICS.removeprefix("select "), *GIVEN, ROUTE_B,
        "routes as (select 'A' as route, risk_class, predicted from scored union all select 'B', risk_class, predicted from route)",
        _metric_sql("routes", "route"),
    ),
)
def route_compare_given(spark, sf_dir):
    """Corrected probabilities against the baseline payout and the rule, on the same claims."""
    known = history_and_rule(spark, sf_dir)
    return round_doubles(N.compare_routes({"A": predicted(spark, sf_dir, known), "B": route_b_given(spark, sf_dir, known)}))


def _schemes_given(spark, sf_dir):
    """Three schemes' predictions on the folds of the first: corrected probabilities, the rule at the baseline payout, class 0."""
    known = history_and_rule(spark, sf_dir)
    first = predicted(spark, sf_dir, known)
    via_rule = first.drop("predicted").join(route_b_given(spark, sf_dir, known).select("claim_key", "predicted"), "claim_key")
    schemes = {"corrected": first, "rule": via_rule, "majority": first.withColumn("predicted", F.lit(0))}
    named = [df.select(F.lit(i).alias("ordinal"), F.lit(n).alias("scheme"), "risk_class", "predicted", "fold") for i, (n, df) in enumerate(schemes.items())]
    return materialize(named[0].unionByName(named[1]).unionByName(named[2]), "schemes")


SCHEMES_SQL = [
    *GIVEN,
    ROUTE_B,
    "schemes as (select 0 as ordinal, 'corrected' as scheme, risk_class, predicted, fold from scored "
    "union all select 1, 'rule', risk_class, r.predicted, fold from scored join (select claim_key, predicted from route) r using (claim_key) "
    "union all select 2, 'majority', risk_class, 0, fold from scored)",
    _metric_sql("schemes", "ordinal, scheme, fold"),
    _metric_sql("schemes", "ordinal, scheme").replace("cm as (", "cm2 as (").replace("from cm)", "from cm2)").replace("per_class as", "pooled as"),
    """report as (select f.ordinal, f.scheme, round(avg(f.macro_f1), 6) as macro_f1_mean, round(stddev_pop(f.macro_f1), 6) as macro_f1_std,
  round(avg(f.accuracy), 6) as accuracy_mean, round(avg(f.recall), 6) as severe_recall_mean, round(any_value(p.precision), 6) as severe_precision,
  round(any_value(p.f1), 6) as severe_f1 from per_class f join pooled p on p.ordinal = f.ordinal and p.risk_class = 2 where f.risk_class = 2 group by f.ordinal, f.scheme)""",
]


@register("scheme_report", with_claims("select * from report", *SCHEMES_SQL))
def scheme_report(spark, sf_dir):
    return round_doubles(N.scheme_report(_schemes_given(spark, sf_dir)))


@register("best_scheme_given", with_claims("select * from report order by macro_f1_mean desc, ordinal limit 1", *SCHEMES_SQL))
def best_scheme_given(spark, sf_dir):
    return round_doubles(N.best_scheme(N.scheme_report(_schemes_given(spark, sf_dir))))


SHARES = [i / 20 for i in range(1, 21)]


@register(
    "topk_baselines",
    with_claims(
        "select config, share, n, round(mae, 4) as mae, round(rmse, 4) as rmse, round(mape_all, 4) as mape_all, "
        "round(mape_ge1, 4) as mape_ge1, round(wape, 4) as wape from scores order by mae, config limit 3",
        "shares as (select * from (values " + ", ".join(f"({i}, {s!r}::double)" for i, s in enumerate(SHARES)) + ") v(config, share))",
        "errors as (select config, share, payout, abs(payout - claim_amount * share) as e from hist, shares)",
        "scores as (select config, share, count(*) as n, avg(e) as mae, sqrt(avg(e * e)) as rmse, 100 * avg(e / payout) as mape_all, "
        "100 * avg(e / payout) filter (where payout >= 1) as mape_ge1, 100 * sum(e) / sum(payout) as wape from errors group by config, share)",
    ),
)
def topk_baselines(spark, sf_dir):
    """The best three of 20 constant shares of the claim."""
    from claimsieve.plans.modelling import topk

    scored = G.regression_metrics(G.share_baselines(hist(spark, sf_dir).select("claim_amount", "payout"), SHARES), by=["config", "share"])
    return round_doubles(topk(scored, "mae", 3), 4)


@register(
    "summary_given",
    with_claims(
        "select count(*) as n, round(avg(p), 6) as mean, round(median(p), 6) as median, round(min(p), 6) as min, round(max(p), 6) as max "
        "from (select greatest(claim_amount - g, 0) as p from score, (select median(excess) as g from hist))",
        SCORE,
    ),
)
def summary_given(spark, sf_dir):
    """Summary of the new claims' baseline payouts."""
    from claimsieve.operators.report import prediction_summary

    train = hist(spark, sf_dir).select("claim_amount", "payout", "excess")
    return round_doubles(prediction_summary(materialize(G.gap_baseline(train, score(spark, sf_dir).select("claim_amount"), clamp=True), "payouts")))


@register(
    "binned_error",
    with_claims(
        "select bin, count(*) as n, round(median(payout), 6) as payout_median, round(median(payout_hat - payout), 6) as bias_median, "
        "round(avg(abs(payout_hat - payout)), 4) as mae from b8 group by bin",
        "pred as (select claim_key, payout, claim_amount - (select median(excess) from hist) as payout_hat from hist)",
        qcut_cte("b8", "pred", "payout", 8),
    ),
)
def binned_error_query(spark, sf_dir):
    from claimsieve.operators.report import binned_error

    df = materialize(hist(spark, sf_dir).select("claim_key", "claim_amount", "payout", "excess"), "claims")
    return round_doubles(binned_error(G.gap_baseline(df)), mae=4)


@register(
    "confusion_row_norm",
    with_claims(
        "select t::int as true_class, p::int as pred_class, count(claim_key) as n, "
        "round(count(claim_key)::double / sum(count(claim_key)) over (partition by t), 6) as share "
        "from (values (0), (1), (2)) a(t) cross join (values (0), (1), (2)) b(p) left join scored on risk_class = t and predicted = p group by t, p",
        *GIVEN,
    ),
)
def confusion_row_norm(spark, sf_dir):
    return round_doubles(N.row_normalised(N.confusion_long(predicted(spark, sf_dir))))
