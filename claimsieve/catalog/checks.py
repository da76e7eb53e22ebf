"""Queries over quality checks, sensitivity tables and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimsieve.catalog.common import hist, narrow, raw_copy, round_doubles, score
from claimsieve.catalog.evaluation import LABELLED, ORDER, labelled
from claimsieve.catalog.registry import register
from claimsieve.catalog.rules import B10, B20, CELLS, DENSITY, FULL, LINEAR, NODES, POWER, base
from claimsieve.catalog.sqltext import SCORE, with_claims
from claimsieve.functions.expr import rounded
from claimsieve.operators import density as D
from claimsieve.operators import quality as Q
from claimsieve.operators import report as V
from claimsieve.operators import rule as R
from claimsieve.operators import sketches as S
from claimsieve.operators.order import positions, quantile_scalar
from claimsieve.plans.estimate import frozen, with_density
from claimsieve.plans.features import feature_tables
from claimsieve.plans.sensitivity import tau_sensitivity
from claimsieve.session import materialize
from claimsieve.sources.claims import history, order_claims, scoring
from claimsieve.sources.files import fill_template


def ordered_template(df):
    """``(ordinal, id)`` in key order; the ordinal is a distributed rank."""
    keys = df.groupBy(F.col("claim_key").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return positions(keys, "id", "n").select(F.col("before").alias("ordinal"), "id")


def filled_result(spark, sf_dir):
    """Scoring claims, their template, and the result filled from the gap baseline and the linear rule."""
    from claimsieve.operators.regress import gap_baseline
    from claimsieve.plans.score import route_b

    both = materialize(order_claims(spark, sf_dir).select("claim_key", "dataset", "claim_amount", "payout"), "claims")
    train, target = history(both).drop("dataset"), scoring(both).drop("dataset")
    rule = materialize(R.linear_rule(train), "rule")
    predictions = route_b(gap_baseline(train, target, clamp=True), rule, name="risk_class")
    template = materialize(ordered_template(target), "template")
    filled = fill_template(template, predictions.withColumnRenamed("claim_key", "id"))
    result = materialize(filled.select("ordinal", "id", "payout", "risk_label"), "result")
    claims = template.join(target.withColumnRenamed("claim_key", "id"), "id")
    return result, template, claims, predictions, train, rule


SCORED = """
sb as (select claim_key, claim_amount, greatest(claim_amount - (select median(excess) from hist), 0) as p_hat from score),
su as (select *, greatest(claim_amount - p_hat, 0) as u_hat from sb),
sl as (select claim_key, claim_amount, p_hat,
    case when floor(u_hat * 1e6 + 0.5) <= floor((alpha1 + beta1 * greatest(p_hat, 1e-9)) * 1e6 + 0.5) then 0
    when floor(u_hat * 1e6 + 0.5) <= floor((alpha2 + beta2 * greatest(p_hat, 1e-9)) * 1e6 + 0.5) then 1 else 2 end as risk_class from su, rule)"""
SCORED_CTES = [SCORE, *LABELLED, SCORED]


@register(
    "fill_template",
    with_claims(
        "select claim_key as id, round_even(p_hat * 100, 0) / 100 as payout, "
        "case risk_class when 0 then '合理诉求' when 1 then '诉求偏高' else '严重超额' end as risk_label from sl",
        *SCORED_CTES,
    ),
)
def fill_template_query(spark, sf_dir):
    return filled_result(spark, sf_dir)[0].select("id", "payout", "risk_label")


def _verdict(name: str, ok: str, detail: str, src: str) -> str:
    return f"select '{name}' as check_id, case when {ok} then 'PASS' else 'FAIL' end as status, cast({detail} as varchar) as detail from {src}"


@register(
    "check_result",
    with_claims(
        " union all ".join(
            [
                _verdict("shape", "true", "count(*)", "sl"),
                *[_verdict(n, "true", "0", "(select 1)") for n in ("ids_as_template", "ids_as_claims", "no_nulls", "labels_in_domain")],
                _verdict("payout_not_negative", "count(*) filter (where p_hat < 0) = 0", "count(*) filter (where p_hat < 0)", "sl"),
                _verdict(
                    "payout_within_claim",
                    "count(*) filter (where round_even(p_hat * 100, 0) / 100 > claim_amount) = 0",
                    "count(*) filter (where round_even(p_hat * 100, 0) / 100 > claim_amount)",
                    "sl",
                ),
            ]
        ),
        *SCORED_CTES,
    ),
)
def check_result(spark, sf_dir):
    result, template, claims, *_ = filled_result(spark, sf_dir)
    return Q.check_result(result, template, claims)


def _share_sql(prefix: str, src: str) -> str:
    p0 = "100.0::double * count(*) filter (where risk_class = 0) / count(*)"
    p2 = "100.0::double * count(*) filter (where risk_class = 2) / count(*)"
    return " union all ".join(
        [
            _verdict(f"{prefix}_class_0_floor", f"{p0} >= 85", f"printf('%.2f', {p0})", src),
            _verdict(f"{prefix}_class_2_cap", f"{p2} < 3", f"printf('%.2f', {p2})", src),
        ]
    )


@register(
    "check_shares",
    with_claims(_share_sql("history", "labelled") + " union all " + _share_sql("scoring", "sl"), *SCORED_CTES),
)
def check_shares(spark, sf_dir):
    *_, predictions, train, rule = filled_result(spark, sf_dir)
    return Q.check_shares(R.apply_rule(train, rule), "history").unionByName(Q.check_shares(predictions, "scoring"))


def seeded(checks):
    """The same checks on data with planted defects, under names of their own."""
    return checks.withColumn("check_id", F.concat("check_id", F.lit("_seeded")))


@register(
    "check_relabel",
    with_claims(
        _verdict("relabel", "true", "0", "(select count(*) from hist)")
        + " union all "
        + _verdict("relabel_seeded", "count(*) filter (where claim_key % 97 = 0) = 0", "count(*) filter (where claim_key % 97 = 0)", "hist")
    ),
)
def check_relabel(spark, sf_dir):
    """On the stored labels, and on labels of which every 97th claim's is wrong."""
    df = narrow(spark, sf_dir, "claim_key", "route_type", "claim_amount", "payout", "excess")
    rule = materialize(R.linear_rule(df), "rule")
    labels = materialize(R.apply_rule(df, rule).select("claim_key", "risk_class"), "labels")
    wrong = labels.withColumn("risk_class", F.when(F.col("claim_key") % 97 == 0, (F.col("risk_class") + 1) % 3).otherwise(F.col("risk_class")))
    raw = raw_copy(df.drop("excess"))
    return Q.check_relabel(raw, labels, rule).unionByName(seeded(Q.check_relabel(raw, wrong, rule)))


_UPPER = "(alpha2 + beta2 * greatest(payout, 1e-9) > alpha1 - beta1 * greatest(payout, 1e-9))"  # the lower slope turned round
RULE_SHAPE = " union all ".join(
    [
        _verdict("slopes_positive", "beta1 > 0 and beta2 > 0", "printf('%.4f', least(beta1, beta2))", "rule"),
        _verdict("upper_above_lower", "count(*) filter (where t2 <= t1) = 0", "count(*) filter (where t2 <= t1)", "labelled"),
        _verdict("excess_positive", "count(*) filter (where excess <= 0) = 0", "count(*) filter (where excess <= 0)", "labelled"),
        _verdict("slopes_positive_seeded", "false", "printf('%.4f', least(-beta1, beta2))", "rule"),
        _verdict("upper_above_lower_seeded", f"count(*) filter (where not {_UPPER}) = 0", f"count(*) filter (where not {_UPPER})", "labelled, rule"),
        _verdict("excess_positive_seeded", "count(*) filter (where claim_key % 101 = 0) = 0", "count(*) filter (where claim_key % 101 = 0)", "labelled"),
    ]
)


@register("check_rule_shape", with_claims(RULE_SHAPE, *LABELLED))
def check_rule_shape(spark, sf_dir):
    """On the rule and its claims, and with a falling lower boundary and every 101st excess turned round."""
    df = hist(spark, sf_dir).select("claim_key", "payout", "excess")
    rule = materialize(R.linear_rule(df), "rule")
    turned = rule.withColumn("lower", F.col("lower").withField("beta", -F.col("lower.beta")))
    planted = df.withColumn("excess", F.when(F.col("claim_key") % 101 == 0, -F.col("excess")).otherwise(F.col("excess")))
    return Q.check_rule_shape(df, rule).unionByName(seeded(Q.check_rule_shape(planted, turned)))


REFIT = " union all ".join(
    _verdict(
        f"refit_{c}",
        "true",
        f"concat(regexp_replace(printf('%.2f', alpha{i}), '(\\d)(\\d{{3}})\\.', '\\1,\\2.'), '/', printf('%.3f', beta{i}))",
        "rule",
    )
    for i, c in ((1, "lower"), (2, "upper"))
)


@register("check_refit", with_claims(REFIT, *LABELLED))
def check_refit(spark, sf_dir):
    df = base(spark, sf_dir)
    nodes = R.node_quantiles(df, [0.86, 0.98])
    rule = frozen(R.candidates(R.curves(nodes, [1.0], isotonic=False), [0.86], [0.98]))
    return Q.check_refit(nodes, rule)


_LINE = "concat(regexp_replace(printf('%.2f', alpha{i}), '(\\d)(\\d{{3}})\\.', '\\1,\\2.'), '/', printf('%.3f', {beta}))"


@register(
    "check_sketched_refit",
    with_claims(
        " union all ".join(
            _verdict(f"sketched_{c}{name}", ok, _LINE.format(i=i, beta=f"beta{i}{by}"), "rule")
            for name, by, fails in (("", "", ()), ("_coefficient", " * 1.25", (1, 2)), ("_input", "", (1, 2)))
            for i, c in ((1, "lower"), (2, "upper"))
            for ok in ["false" if i in fails else "true"]
        ),
        *LABELLED,
    ),
)
def check_sketched_refit(spark, sf_dir):
    """The frozen boundaries against sketches of the claims; then with slopes a quarter larger, and with claims of which the
    excess has doubled, both of which must fail."""
    df = base(spark, sf_dir)
    nodes = R.node_quantiles(df, [0.86, 0.98])
    rule = materialize(frozen(R.candidates(R.curves(nodes, [1.0], isotonic=False), [0.86], [0.98])), "rule")
    steeper = rule.withColumns({c: F.col(c) * 1.25 for c in ("beta1", "beta2")})
    sketched = materialize(S.sketched_nodes(df, [0.86, 0.98]), "sketched")
    moved = S.sketched_nodes(df.withColumn("excess", F.col("excess") * 2), [0.86, 0.98])

    def named(checks, ending):
        return checks.withColumn("check_id", F.concat("check_id", F.lit(ending)))

    out = Q.check_sketched_refit(sketched, rule).unionByName(named(Q.check_sketched_refit(sketched, steeper), "_coefficient"))
    return out.unionByName(named(Q.check_sketched_refit(moved, rule), "_input"))


def figures(df):
    """Headline figures of a labelled table as ``(metric, value)``."""
    total = F.count(F.lit(1))
    rows = [
        ("rows", total.cast("double")),
        ("class_0_pct", F.count_if(F.col("risk_class") == 0) / total * 100),
        ("class_2_pct", F.count_if(F.col("risk_class") == 2) / total * 100),
        ("payout_total", F.sum("payout")),
    ]
    cells = [F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in rows]
    return df.agg(F.array(*cells).alias("m")).select(F.inline("m"))


FIGURES = """
fig as (select count(*)::double as n, 100.0::double * count(*) filter (where risk_class = 0) / count(*) as c0,
    100.0::double * count(*) filter (where risk_class = 2) / count(*) as c2, round(sum(payout), 4) as total from labelled)"""


@register(
    "reconcile_figures",
    with_claims(
        " union all ".join(
            [
                *[
                    _verdict(f"figure_{m}", "true", f"format('{{:,.4f}}', {c})", "fig")
                    for m, c in (("rows", "n"), ("class_0_pct", "c0"), ("class_2_pct", "c2"), ("payout_total", "total"))
                ],
                _verdict("figure_withdrawn", "false", "'missing'", "fig"),
            ]
        ),
        *LABELLED,
        FIGURES,
    ),
)
def reconcile_figures(spark, sf_dir):
    """Figures published from the labelled table against the same figures recomputed from its rule."""
    df = base(spark, sf_dir)
    rule = materialize(R.linear_rule(df), "rule")
    published = figures(labelled(spark, sf_dir)).select(
        "metric", F.round("value", 2).alias("published"), F.lit(0.01).alias("tolerance")
    )
    withdrawn = published.where("metric = 'rows'").withColumn("metric", F.lit("withdrawn"))
    return Q.reconcile(published.unionByName(withdrawn), figures(R.apply_rule(df, rule)))


@register(
    "clean_null_audit",
    with_claims(
        "select dataset, count(*) as n_rows, cast(0 as bigint) as n_null_cells from claims group by dataset"
    ),
)
def clean_null_audit(spark, sf_dir):
    train, target = feature_tables(materialize(order_claims(spark, sf_dir), "claims"))
    return Q.null_audit(train, "history").unionByName(Q.null_audit(target, "scoring"))


@register(
    "template_audit",
    with_claims(
        "select min(claim_key) as id_min, max(claim_key) as id_max, count(*) as n_rows, "
        "count(*) - count(distinct claim_key) as n_duplicates from score",
        SCORE,
    ),
)
def template_audit(spark, sf_dir):
    return Q.template_audit(score(spark, sf_dir).select(F.col("claim_key").alias("id")))


@register(
    "check_summary",
    with_claims(
        "select count(*) as n_checks, count(*) filter (where status = 'FAIL') as n_failed from ("
        + _share_sql("history", "labelled")
        + " union all "
        + RULE_SHAPE
        + ")",
        *LABELLED,
    ),
)
def check_summary(spark, sf_dir):
    df = base(spark, sf_dir)
    rule = materialize(R.linear_rule(df), "rule")
    checks = Q.check_shares(R.apply_rule(df, rule), "history").unionByName(Q.check_rule_shape(df, rule))
    return Q.check_summary(checks)


# ---- sensitivity -----------------------------------------------------------------------------------------------

TAU_SQL = """select c.tau1, c.tau2, round(pct_0, 4) as pct_0, round(pct_1, 4) as pct_1, round(pct_2, 4) as pct_2, n_severe,
  round(case when nd = nr then ratio end, 4) as ratio_02
from cand c join share using (candidate) join (select candidate, count(*) as nd, count(r) as nr, avg(r) as ratio from (
    select candidate, decile, case when count(*) filter (where k = 2) > 0 then max(density_sum / n) filter (where k = 0)
      / greatest(max(density_sum / n) filter (where k = 2), 1e-12) end as r from cells group by candidate, decile)
  group by candidate) using (candidate) where c.form = 'M2(g=1.0)'"""


@register("tau_sensitivity", with_claims(TAU_SQL, *FULL, DENSITY, CELLS))
def tau_sensitivity_query(spark, sf_dir):
    return round_doubles(tau_sensitivity(base(spark, sf_dir)), 4, tau1=6, tau2=6)


@register(
    "sensitivity_pivot",
    with_claims(
        "select c.tau1, "
        + ", ".join(f"round(max(pct_2) filter (where c.tau2 = {t}), 4) as tau2_{str(t).replace('.', '_')}" for t in R.TAUS_HIGH)
        + " from cand c join share using (candidate) where c.form = 'M2(g=1.0)' group by c.tau1",
        *FULL,
        DENSITY,
        CELLS,
    ),
)
def sensitivity_pivot(spark, sf_dir):
    table = tau_sensitivity(base(spark, sf_dir))
    return round_doubles(V.sensitivity_pivot(table, "pct_2", R.TAUS_HIGH), 4, tau1=6)


# ---- report tables ---------------------------------------------------------------------------------------------


@register(
    "thin_per_class",
    with_claims(
        "select claim_key, risk_class, payout, round(excess, 6) as excess from (select *, row_number() over ("
        f"partition by risk_class order by {ORDER}) as rn from labelled) where rn <= 500",
        *LABELLED,
    ),
)
def thin_per_class(spark, sf_dir):
    df = labelled(spark, sf_dir).select("claim_key", "risk_class", "payout", "excess")
    return round_doubles(V.thin_per_class(df, 500))


@register(
    "boundary_curve",
    with_claims(
        "select cast(i as int) as point, round(p, 3) as p, round(alpha1 + beta1 * p, 3) as t1, round(alpha2 + beta2 * p, 3) as t2 "
        "from (select i, 0.74 + (m - 0.74) * i / 299.0::double as p from (select max(payout) as m from hist), generate_series(0, 299) g(i)), rule",
        *LABELLED,
    ),
)
def boundary_curve(spark, sf_dir):
    df = base(spark, sf_dir)
    return round_doubles(V.boundary_curve(materialize(R.linear_rule(df), "rule"), 0.74, df), 3)


@register(
    "kde_curve",
    with_claims(
        """select b.risk_class, cast(i as int) as point, round(top * i / 599.0::double, 6) as x,
  round(avg(exp(-0.5 * ((top * i / 599.0::double - r) / h) * ((top * i / 599.0::double - r) / h))) / (any_value(h) * sqrt(2 * pi())), 12) as density
from bw b join refs using (risk_class), generate_series(0, 599) g(i), (select max(excess) as top from labelled) group by b.risk_class, i, top""",
        *LABELLED,
        "bw as (select risk_class, 0.9 * stddev_samp(excess) * pow(count(*), -0.2) as h from labelled group by risk_class)",
        "refs as (select risk_class, excess as r from labelled)",
    ),
)
def kde_curve(spark, sf_dir):
    df = materialize(labelled(spark, sf_dir).select("claim_key", "risk_class", "excess"), "labelled")
    curve = D.kde_curve(df, "risk_class", "excess", 0.0)
    return round_doubles(curve, density=12)
