"""Data-quality checks: ``(check_id, status, detail)`` rows.  Every check evaluates its predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimsieve.operators.clean import drop_embedded_header, to_double
from claimsieve.operators.rule import apply_rule
from claimsieve.sources.files import RISK_LABELS


def verdicts(facts: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Turn one row of facts into one row per check; an unknown predicate fails."""
    rows = [
        F.struct(
            F.lit(name).alias("check_id"),
            F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL").alias("status"),
            detail.cast("string").alias("detail"),
        )
        for name, (ok, detail) in checks.items()
    ]
    return facts.select(F.inline(F.array(*rows)))


def check_result(result: DataFrame, template: DataFrame, claims: DataFrame) -> DataFrame:
    """The filled result ``(ordinal, id, payout, risk_label)`` against its template and the scored claims.

    ``template`` is ``(ordinal, id)`` and ``claims`` ``(ordinal, id, claim_amount)``; the ordinal stands for row order.
    """
    r = result.select("ordinal", F.col("id").alias("r_id"), "payout", "risk_label", F.lit(1).alias("in_r"))
    t = template.select("ordinal", F.col("id").alias("t_id"), F.lit(1).alias("in_t"))
    c = claims.select("ordinal", F.col("id").alias("c_id"), "claim_amount", F.lit(1).alias("in_c"))
    joined = r.join(t, "ordinal", "full").join(c, "ordinal", "full")
    row = F.col("in_r") == 1
    facts = joined.agg(
        F.count("in_r").alias("n_r"),
        F.count("in_t").alias("n_t"),
        F.count_if(~F.col("r_id").eqNullSafe(F.col("t_id"))).alias("off_template"),
        F.count_if(~F.col("r_id").eqNullSafe(F.col("c_id"))).alias("off_claims"),
        F.count_if(row & (F.col("payout").isNull() | F.col("risk_label").isNull())).alias("n_null"),
        F.count_if(row & ~F.coalesce(F.col("risk_label").isin(*RISK_LABELS), F.lit(False))).alias("n_foreign"),
        F.count_if(row & (F.col("payout") < 0)).alias("n_negative"),
        F.count_if(row & (F.col("payout") > F.col("claim_amount"))).alias("n_above"),
    )
    zero = lambda c: (F.col(c) == 0, F.col(c))
    return verdicts(
        facts,
        {
            "shape": (F.col("n_r") == F.col("n_t"), F.col("n_r")),
            "ids_as_template": zero("off_template"),
            "ids_as_claims": zero("off_claims"),
            "no_nulls": zero("n_null"),
            "labels_in_domain": zero("n_foreign"),
            "payout_not_negative": zero("n_negative"),
            "payout_within_claim": zero("n_above"),
        },
    )


def check_shares(labelled: DataFrame, prefix: str, floor_0: float = 85.0, cap_2: float = 3.0) -> DataFrame:
    """Class limits of the task on one labelled table; an empty one fails both."""
    total = F.count(F.lit(1))
    facts = labelled.agg(
        (F.try_divide(F.count_if(F.col("risk_class") == 0), total) * 100).alias("p0"),
        (F.try_divide(F.count_if(F.col("risk_class") == 2), total) * 100).alias("p2"),
    )
    return verdicts(
        facts,
        {
            f"{prefix}_class_0_floor": (F.col("p0") >= floor_0, F.format_number("p0", 2)),
            f"{prefix}_class_2_cap": (F.col("p2") < cap_2, F.format_number("p2", 2)),
        },
    )


def check_relabel(raw: DataFrame, labels: DataFrame, rule: DataFrame) -> DataFrame:
    """Labels recomputed from the raw text columns against the stored ones, joined by key."""
    kept = drop_embedded_header(raw, "route_type", "route_type").select(
        F.col("claim_key").try_cast("bigint").alias("claim_key"),
        to_double("payout").alias("payout"),
        to_double("claim_amount").alias("claim_amount"),
    )
    again = apply_rule(kept.withColumn("excess", F.col("claim_amount") - F.col("payout")), rule)
    both = again.select("claim_key", F.col("risk_class").alias("again")).join(labels, "claim_key", "full")
    facts = both.agg(F.count_if(~F.col("again").eqNullSafe(F.col("risk_class"))).alias("n"))
    return verdicts(facts, {"relabel": (F.col("n") == 0, F.col("n"))})


def check_rule_shape(df: DataFrame, rule: DataFrame) -> DataFrame:
    """Increasing boundaries, the upper above the lower on every claim, and a positive excess everywhere."""
    facts = apply_rule(df, rule, keep_boundaries=True).agg(
        F.bool_and(F.col("t2") > F.col("t1")).alias("ordered"),
        F.count_if(~(F.col("t2") > F.col("t1"))).alias("n_crossed"),
        F.count_if(~(F.col("excess") > 0)).alias("n_not_positive"),
    )
    slopes = rule.select(F.struct(F.col("lower.beta").alias("b1"), F.col("upper.beta").alias("b2")).alias("s")).scalar()
    b1, b2 = F.col("_s.b1"), F.col("_s.b2")
    return verdicts(
        facts.withColumn("_s", slopes),
        {
            "slopes_positive": ((b1 > 0) & (b2 > 0), F.format_number(F.least(b1, b2), 4)),
            "upper_above_lower": (F.col("ordered"), F.col("n_crossed")),
            "excess_positive": (F.col("n_not_positive") == 0, F.col("n_not_positive")),
        },
    )


def _frozen_lines(frozen: DataFrame) -> DataFrame:
    """``curve, tau, alpha, beta`` of both boundaries."""
    config = frozen.select("tau1", "tau2", "alpha1", "beta1", "alpha2", "beta2")
    return config.select(
        F.inline(
            F.array(
                F.struct(F.lit("lower").alias("curve"), F.col("tau1").alias("tau"), F.col("alpha1").alias("alpha"), F.col("beta1").alias("beta")),
                F.struct(F.lit("upper").alias("curve"), F.col("tau2").alias("tau"), F.col("alpha2").alias("alpha"), F.col("beta2").alias("beta")),
            )
        )
    )


def check_refit(nodes: DataFrame, frozen: DataFrame, alpha_tol: float = 0.5, beta_tol: float = 0.05) -> DataFrame:
    """Linear boundaries re-estimated with the built-in regression aggregates against the frozen ones."""
    line = nodes.groupBy("tau").agg(F.regr_intercept("q", "node_p").alias("a"), F.regr_slope("q", "node_p").alias("b"))
    wanted = _frozen_lines(frozen)
    off_a, off_b = F.abs(F.col("a") - F.col("alpha")), F.abs(F.col("b") - F.col("beta"))
    ok = F.coalesce((off_a < alpha_tol) & (off_b < beta_tol), F.lit(False))
    return wanted.join(line, "tau", "left").select(
        F.concat(F.lit("refit_"), "curve").alias("check_id"),
        F.when(ok, "PASS").otherwise("FAIL").alias("status"),
        F.concat_ws("/", F.format_number("alpha", 2), F.format_number("beta", 3)).alias("detail"),
    )


def check_sketched_refit(sketched: DataFrame, frozen: DataFrame) -> DataFrame:
    """Frozen linear boundaries against those re-estimated from sketches of the claims (``sketches.sketched_nodes``).

    The tolerance of a coefficient is what the sketches' rank error can make of it: each node's error times its weight in
    the least-squares line."""
    keys = Window.partitionBy("tau")
    centred = sketched.withColumn("_d", F.col("node_p") - F.avg("node_p").over(keys)).withColumn("_s", F.sum(F.col("_d") * F.col("_d")).over(keys))
    slope = F.regr_slope("q", "node_p").over(keys)
    error = F.greatest(F.col("q_high") - F.col("q"), F.col("q") - F.col("q_low")) + F.abs(slope) * F.greatest(F.col("node_high") - F.col("node_p"), F.col("node_p") - F.col("node_low"))
    line = centred.withColumn("_e", error).groupBy("tau").agg(
        F.regr_intercept("q", "node_p").alias("a"), F.regr_slope("q", "node_p").alias("b"),
        F.sum(F.abs(F.try_divide(F.col("_d"), F.col("_s"))) * F.col("_e")).alias("tol_b"), F.avg("_e").alias("_e"), F.avg("node_p").alias("_m"),
    )
    line = line.withColumn("tol_a", F.col("_e") + F.col("tol_b") * F.abs("_m"))
    off_a, off_b = F.abs(F.col("a") - F.col("alpha")), F.abs(F.col("b") - F.col("beta"))
    ok = F.coalesce((off_a <= F.col("tol_a")) & (off_b <= F.col("tol_b")), F.lit(False))
    return _frozen_lines(frozen).join(line, "tau", "left").select(
        F.concat(F.lit("sketched_"), "curve").alias("check_id"), F.when(ok, "PASS").otherwise("FAIL").alias("status"),
        F.concat_ws("/", F.format_number("alpha", 2), F.format_number("beta", 3)).alias("detail"),
    )


def reconcile(published: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Published figures ``(metric, published, tolerance)`` against ``(metric, value)``; a missing value fails."""
    off = F.abs(F.col("published") - F.col("value"))
    return published.join(recomputed, "metric", "left").select(
        F.concat(F.lit("figure_"), "metric").alias("check_id"),
        F.when(F.coalesce(off <= F.col("tolerance"), F.lit(False)), "PASS").otherwise("FAIL").alias("status"),
        F.coalesce(F.format_number("value", 4), F.lit("missing")).alias("detail"),
    )


def null_audit(df: DataFrame, name: str) -> DataFrame:
    """Total null cells of a table in one pass."""
    cells = [F.count_if(F.col(c).isNull()) for c in df.columns]
    total = cells[0]
    for c in cells[1:]:
        total = total + c
    return df.agg(total.alias("n_null_cells"), F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("dataset"), "n_rows", "n_null_cells"
    )


def template_audit(df: DataFrame, key: str = "id") -> DataFrame:
    """Range and duplicates of the template's ids; counted per distinct id, so copies never meet in one task."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.min(key).alias("id_min"),
            F.max(key).alias("id_max"),
            F.sum("n").alias("n_rows"),
            F.sum(F.col("n") - 1).alias("n_duplicates"),
        )
    )


def check_summary(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count(F.lit(1)).alias("n_checks"), F.count_if(F.col("status") == "FAIL").alias("n_failed")
    )

