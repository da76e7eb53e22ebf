"""Queries over the rule estimation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimsieve.catalog.common import hist, round_doubles
from claimsieve.catalog.registry import register
from claimsieve.catalog.sqltext import qcut_cte, with_claims
from claimsieve.functions.expr import rounded
from claimsieve.operators import density as D
from claimsieve.operators import rule as R
from claimsieve.operators.binning import qcut
from claimsieve.plans.estimate import FROZEN_SCHEMA, estimate_rule, frozen, thawed, with_density
from claimsieve.session import materialize, scratch_path
from claimsieve.sources import files

TAUS = sorted({*R.TAUS_LOW, *R.TAUS_HIGH})
TAU_LIST = "[" + ", ".join(f"{t!r}::double" for t in TAUS) + "]"
PLAIN_TAUS = "[" + ", ".join(repr(t) for t in TAUS) + "]"

B20 = qcut_cte("b20", "hist", "payout", 20)
B10 = qcut_cte("b10", "hist", "payout", 10, "decile")
NODES = f"""
nodes as (select bin, median(payout) as node_p, count(*) as n, quantile_cont(excess, {PLAIN_TAUS}) as qs
  from b20 group by bin),
nq as (select bin, node_p, n, unnest({TAU_LIST}) as tau, unnest(qs) as q from nodes)"""
ISO = """
pooled as (select a.tau, a.bin as a, b.bin as b,
    sum(a.n * a.q) over w / sum(a.n) over w as unused, b.n, b.q from nq a join nq b on a.tau = b.tau and a.bin <= b.bin
    window w as (partition by a.tau, a.bin)),
seg as (select tau, a, b, sum(n * q) over w / sum(n) over w as m from pooled
    window w as (partition by tau, a order by b rows unbounded preceding)),
minb as (select i.tau, i.bin, i.node_p, s.a, min(s.m) as mm from nq i join seg s
    on s.tau = i.tau and s.a <= i.bin and s.b >= i.bin group by all),
iso as (select tau, bin, node_p, max(mm) as y from minb group by all)"""
POWER = """
xy as (select tau, g as gamma, form, pow(node_p, g) as x, q as y from nq,
    (values (1.0::double, 'M2(g=1.0)'), (1.2, 'M2(g=1.2)'), (1.5, 'M2(g=1.5)'), (2.0, 'M2(g=2.0)')) v(g, form)),
ls as (select tau, gamma, form, regr_intercept(y, x) as a, regr_slope(y, x) as b, sum(x * y) / sum(x * x) as o
    from xy group by all),
power as (select tau, gamma, form, case when a < 0 then 0 else a end as alpha, case when a < 0 then o else b end as beta from ls)"""
LINEAR = """
rule as (select lo.alpha as alpha1, lo.beta as beta1, hi.alpha as alpha2, hi.beta as beta2
    from power lo, power hi where lo.gamma = 1 and hi.gamma = 1 and lo.tau = 0.86 and hi.tau = 0.98),
labelled as (select hist.*, alpha1 + beta1 * greatest(payout, 1e-9) as t1, alpha2 + beta2 * greatest(payout, 1e-9) as t2,
    cast(case when floor(excess * 1e6 + 0.5) <= floor((alpha1 + beta1 * greatest(payout, 1e-9)) * 1e6 + 0.5) then 0
     when floor(excess * 1e6 + 0.5) <= floor((alpha2 + beta2 * greatest(payout, 1e-9)) * 1e6 + 0.5) then 1 else 2 end as int) as risk_class
    from hist, rule)"""
STEPS = """
ends as (select tau, bin, node_p as x1, y as y1, lag(node_p) over w as x0, lag(y) over w as y0,
    max(bin) over (partition by tau) as last_bin from iso window w as (partition by tau order by bin)),
m1 as (select h.claim_key, 'M1' as form, e.tau,
    case when e.x0 is null then e.y1 else e.y0 + (e.y1 - e.y0) * (h.payout - e.x0) / (e.x1 - e.x0) end as t
    from hist h join ends e on h.payout <= e.x1 and (e.x0 is null or h.payout > e.x0)
    union all select h.claim_key, 'M1', e.tau, e.y1 from hist h join ends e on e.bin = e.last_bin and h.payout > e.x1)"""
GRID = """
ts as (select * from m1 union all
    select claim_key, form, tau, alpha + beta * pow(greatest(payout, 1e-9), gamma) as t from hist, power),
cand as (select form, tau1, tau2, row_number() over (order by tau1, tau2, form) - 1 as candidate
    from (select distinct form from ts) f, (values (0.85::double), (0.86), (0.88), (0.9)) a(tau1),
      (values (0.97::double), (0.98), (0.99)) b(tau2)),
lab as (select cast(c.candidate as int) as candidate, lo.claim_key, case when floor(h.excess * 1e6 + 0.5) <= floor(lo.t * 1e6 + 0.5) then 0
      when floor(h.excess * 1e6 + 0.5) <= floor(hi.t * 1e6 + 0.5) then 1 else 2 end as k
    from cand c join ts lo on lo.form = c.form and lo.tau = c.tau1
      join ts hi on hi.form = c.form and hi.tau = c.tau2 and hi.claim_key = lo.claim_key
      join hist h on h.claim_key = lo.claim_key)"""
DENSITY = """
bw as (select decile, count(*) as n, stddev_samp(excess) as sd, 0.9 * stddev_samp(excess) * pow(count(*), -0.2) as h
    from b10 group by decile),
refs as (select decile, excess as r, count(*) over (partition by decile) as m from b10),
dens as (select b.claim_key, b.decile, b.excess, sum(exp(-0.5 * ((b.excess - refs.r) / bw.h) * ((b.excess - refs.r) / bw.h)))
      / (any_value(refs.m) * any_value(bw.h) * sqrt(2 * pi())) as density
    from b10 b join refs on refs.decile = b.decile join bw on bw.decile = b.decile group by b.claim_key, b.decile, b.excess)"""
CELLS = """
cells as (select candidate, decile, k, count(*) as n, min(excess) as u_min, max(excess) as u_max, sum(density) as density_sum
    from lab join dens using (claim_key) group by all),
share as (select candidate, 100.0::double * sum(n) filter (where k = 0) / sum(n) as pct_0,
    100.0::double * coalesce(sum(n) filter (where k = 1), 0) / sum(n) as pct_1,
    100.0::double * coalesce(sum(n) filter (where k = 2), 0) / sum(n) as pct_2,
    cast(coalesce(sum(n) filter (where k = 2), 0) as bigint) as n_severe from cells group by candidate),
pool as (select *, max(u_max) over w - min(u_min) over w as spread from cells window w as (partition by candidate, decile)),
comp as (select candidate, avg((u_max - u_min) / spread) filter (where k = 0 and n >= 10 and spread > 0) as compact_0,
    avg((u_max - u_min) / spread) filter (where k = 1 and n >= 10 and spread > 0) as compact_1,
    avg((u_max - u_min) / spread) filter (where k = 2 and n >= 10 and spread > 0) as compact_2 from pool group by candidate),
dmean as (select candidate, avg(density_sum / n) filter (where k = 0 and n >= 10) as density_0,
    avg(density_sum / n) filter (where k = 1 and n >= 10) as density_1,
    avg(density_sum / n) filter (where k = 2 and n >= 10) as density_2 from cells group by candidate),
ratios as (select candidate, avg(r) as ratio_02 from (select candidate, decile,
      max(density_sum / n) filter (where k = 0) / greatest(max(density_sum / n) filter (where k = 2), 1e-12) as r
    from cells group by candidate, decile) group by candidate)"""
MONO = """
span as (select min(payout) as lo, max(payout) as hi from hist),
pts as (select cast(i as int) as i, lo + (hi - lo) * i / 199.0::double as p from span, generate_series(0, 199) g(i)),
gts as (select pts.i, 'M1' as form, e.tau, case when e.x0 is null then e.y1
      else e.y0 + (e.y1 - e.y0) * (pts.p - e.x0) / (e.x1 - e.x0) end as t
    from pts join ends e on pts.p <= e.x1 and (e.x0 is null or pts.p > e.x0)
    union all select pts.i, 'M1', e.tau, e.y1 from pts join ends e on e.bin = e.last_bin and pts.p > e.x1
    union all select pts.i, form, tau, alpha + beta * pow(greatest(pts.p, 1e-9), gamma) from pts, power),
gpair as (select c.candidate, lo.i, lo.t as t1, hi.t as t2 from cand c join gts lo on lo.form = c.form and lo.tau = c.tau1
    join gts hi on hi.form = c.form and hi.tau = c.tau2 and hi.i = lo.i),
mono as (select candidate, cast(sum(v) as bigint) as mono_viol from (select candidate,
    cast(coalesce(t1 - lag(t1) over w < -1e-12, false) as int) + cast(coalesce(t2 - lag(t2) over w < -1e-12, false) as int)
    + cast(t2 <= t1 + 1e-12 as int) as v from gpair window w as (partition by candidate order by i)) group by candidate)"""

RULE_CTES = [B20, NODES, POWER]
FULL = [B20, B10, NODES, ISO.replace("sum(a.n * a.q) over w / sum(a.n) over w as unused, ", "").replace(
    "\n    window w as (partition by a.tau, a.bin)", "", 1), POWER, STEPS, GRID]
ISO_CTE = FULL[3]


def base(spark, sf_dir):
    """Key, payout and excess of history, written once: the rule queries pass over it several times."""
    return materialize(hist(spark, sf_dir).select("claim_key", "payout", "excess"), "claims")


@register("rule_nodes", with_claims("select bin, n, round(node_p, 6) as node_p from nodes", B20, NODES))
def rule_nodes(spark, sf_dir):
    return round_doubles(R.rule_nodes(base(spark, sf_dir)))


@register(
    "node_quantiles",
    with_claims("select bin, round(node_p, 6) as node_p, n, tau, round(q, 6) as q from nq", B20, NODES),
)
def node_quantiles(spark, sf_dir):
    return round_doubles(R.node_quantiles(base(spark, sf_dir), TAUS))


@register(
    "isotonic_fit",
    with_claims("select tau, cast(bin as int) as node, round(node_p, 6) as x, round(y, 2) as y from iso", B20, NODES, ISO_CTE),
)
def isotonic_fit(spark, sf_dir):
    fitted = R.isotonic_fit(R.node_quantiles(base(spark, sf_dir), TAUS))
    long = fitted.select("tau", F.posexplode(F.arrays_zip("xs", "ys")).alias("node", "z"))
    return round_doubles(long.select("tau", "node", F.col("z.xs").alias("x"), F.col("z.ys").alias("y")), y=2)


@register(
    "power_fit",
    with_claims("select tau, gamma, round(alpha, 4) as alpha, round(beta, 8) as beta from power", *RULE_CTES),
)
def power_fit(spark, sf_dir):
    return round_doubles(R.power_fit(R.node_quantiles(base(spark, sf_dir), TAUS)), alpha=4, beta=8)


@register(
    "label_rule",
    with_claims(
        "select claim_key, round(t1, 3) as t1, round(t2, 3) as t2, risk_class from labelled", *RULE_CTES, LINEAR
    ),
)
def label_rule(spark, sf_dir):
    df = base(spark, sf_dir)
    out = R.apply_rule(df, R.linear_rule(df), keep_boundaries=True)
    return round_doubles(out.select("claim_key", "t1", "t2", "risk_class"), 3)


@register(
    "rule_broadcast",
    with_claims(
        "select risk_class, count(*) as n, round(min(t1), 3) as t1_min, round(max(t2), 3) as t2_max from labelled group by 1",
        *RULE_CTES,
        LINEAR,
    ),
)
def rule_broadcast(spark, sf_dir):
    df = base(spark, sf_dir)
    out = R.apply_rule(df, R.linear_rule(df), keep_boundaries=True)
    return round_doubles(
        out.groupBy("risk_class").agg(
            F.count(F.lit(1)).alias("n"), F.min("t1").alias("t1_min"), F.max("t2").alias("t2_max")
        ),
        3,
    )


@register(
    "class_shares",
    with_claims(
        "select risk_class, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 4) as pct, "
        "case risk_class when 0 then 100.0::double * count(*) / sum(count(*)) over () >= 85 "
        "when 2 then 100.0::double * count(*) / sum(count(*)) over () < 3 else true end as within_limit "
        "from labelled group by risk_class",
        *RULE_CTES,
        LINEAR,
    ),
)
def class_shares(spark, sf_dir):
    df = base(spark, sf_dir)
    return round_doubles(R.class_shares(R.apply_rule(df, R.linear_rule(df))), 4)


@register(
    "class_profile",
    with_claims(
        "select risk_class, count(*) as n, round(max(excess), 6) as u_max, round(avg(payout), 4) as p_mean, "
        "round(100.0::double * count(*) / sum(count(*)) over (), 4) as pct, round(median(excess), 6) as u_med, "
        "round(quantile_cont(excess, 0.25), 6) as u_q25, round(quantile_cont(excess, 0.75), 6) as u_q75, "
        "round(median(payout), 6) as p_med from labelled group by risk_class",
        *RULE_CTES,
        LINEAR,
    ),
)
def class_profile(spark, sf_dir):
    df = base(spark, sf_dir)
    labelled = materialize(R.apply_rule(df, R.linear_rule(df)), "labels")
    return round_doubles(R.class_profile(labelled), p_mean=4, pct=4)


@register(
    "segment_interp",
    with_claims("select claim_key, round(t, 3) as t from m1 where tau = 0.98", B20, NODES, ISO_CTE, STEPS),
)
def segment_interp(spark, sf_dir):
    df = base(spark, sf_dir)
    nodes = R.isotonic_fit(R.node_quantiles(df, [0.98])).select("xs", "ys")
    located = R.locate(df.withColumn("_n", R.as_scalar(nodes)), F.col("_n.xs"), "payout")
    return round_doubles(located.select("claim_key", R.interpolate(F.col("_n.ys")).alias("t")), 3)


@register(
    "candidate_cross",
    with_claims(
        "select cast(c.candidate as int) as candidate, count(*) as n, round(avg(lo.t), 3) as t1_mean, round(avg(hi.t), 3) as t2_mean "
        "from cand c join ts lo on lo.form = c.form and lo.tau = c.tau1 "
        "join ts hi on hi.form = c.form and hi.tau = c.tau2 and hi.claim_key = lo.claim_key group by 1",
        *FULL,
    ),
)
def candidate_cross(spark, sf_dir):
    df = base(spark, sf_dir)
    crossed = R.with_candidates(df, materialize(R.rule_candidates(df), "rule-candidates"))
    return round_doubles(
        crossed.groupBy("candidate").agg(
            F.count(F.lit(1)).alias("n"), F.avg("t1").alias("t1_mean"), F.avg("t2").alias("t2_mean")
        ),
        3,
    )


GRID_SELECT = """select cand.candidate::int as candidate, cand.form, cand.tau1, cand.tau2, round(pct_0, 4) as pct_0,
  round(pct_1, 4) as pct_1, round(pct_2, 4) as pct_2, n_severe, mono_viol, round(compact_0, 6) as compact_0,
  round(compact_1, 6) as compact_1, round(compact_2, 6) as compact_2,
  coalesce(compact_0 < 1, true) and coalesce(compact_1 < 1, true) and coalesce(compact_2 < 1, true) as compact_ok,
  round(density_0, 10) as density_0, round(density_1, 10) as density_1, round(density_2, 10) as density_2,
  round(density_0 / greatest(density_2, 1e-12), 4) as ratio_02, round(density_0 / greatest(density_1, 1e-12), 4) as ratio_01
from cand join share using (candidate) join mono using (candidate) join comp using (candidate) join dmean using (candidate)"""


def _estimate(spark, sf_dir):
    return estimate_rule(hist(spark, sf_dir))


def _grid(spark, sf_dir):
    scored = materialize(with_density(base(spark, sf_dir)), "rule-density")
    return R.rule_grid(scored, materialize(R.rule_candidates(scored), "rule-candidates"))


@register("rule_grid", with_claims(GRID_SELECT, *FULL, DENSITY, CELLS, MONO))
def rule_grid(spark, sf_dir):
    digits = {c: 10 for c in ("density_0", "density_1", "density_2")}
    digits |= {c: 4 for c in ("pct_0", "pct_1", "pct_2", "ratio_02", "ratio_01")}
    return round_doubles(_grid(spark, sf_dir).drop("lower", "upper"), **digits)


@register("monotone_scan", with_claims("select candidate::int as candidate, mono_viol from mono", *FULL, MONO))
def monotone_scan(spark, sf_dir):
    df = base(spark, sf_dir)
    return R.monotone_violations(materialize(R.rule_candidates(df), "rule-candidates"), df)


def _labelled_deciles(spark, sf_dir, density=False):
    df = base(spark, sf_dir)
    binned = qcut(df, "payout", 10, "decile")
    if density:
        binned = with_density(df)
    labelled = R.apply_rule(binned, R.linear_rule(df)).withColumn("candidate", F.lit(0))
    measure = F.sum("density") if density else F.lit(None).cast("double")
    return labelled.groupBy("candidate", "decile", "risk_class").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("excess").alias("u_min"),
        F.max("excess").alias("u_max"),
        measure.alias("density_sum"),
    )


ONE_LABEL = """
lab as (select 0 as candidate, claim_key, risk_class as k from labelled)"""


@register(
    "compactness",
    with_claims(
        "select round(compact_0, 6) as compact_0, round(compact_1, 6) as compact_1, round(compact_2, 6) as compact_2, "
        "coalesce(compact_0 < 1, true) and coalesce(compact_1 < 1, true) and coalesce(compact_2 < 1, true) as compact_ok from comp",
        B20, B10, NODES, POWER, LINEAR, ONE_LABEL, DENSITY, CELLS,
    ),
)
def compactness(spark, sf_dir):
    return round_doubles(R.compactness(_labelled_deciles(spark, sf_dir)).drop("candidate"))


@register(
    "kde_bandwidth",
    with_claims("select decile, n, round(sd, 4) as sd, round(h, 4) as h from bw", B10, DENSITY.split("refs as")[0].rstrip(" ,\n")),
)
def kde_bandwidth(spark, sf_dir):
    binned = qcut(base(spark, sf_dir), "payout", 10, "decile")
    return round_doubles(D.bandwidth(binned), 4)


@register(
    "kde_at_samples",
    with_claims("select claim_key, decile, round(density, 12) as density from dens", B10, DENSITY),
)
def kde_at_samples(spark, sf_dir):
    scored = with_density(base(spark, sf_dir))
    return round_doubles(scored.select("claim_key", "decile", "density"), 12)


@register(
    "decile_pairs",
    with_claims(
        "select decile, count(*) as n, round(avg(density), 10) as mean_density, "
        "round(sum(density * bw.n * bw.h * sqrt(2 * pi())), 3) as pair_sum from dens join bw using (decile) group by decile",
        B10, DENSITY,
    ),
)
def decile_pairs(spark, sf_dir):
    binned = materialize(qcut(base(spark, sf_dir), "payout", 10, "decile"), "deciles")
    return round_doubles(D.pair_sums(binned), 10, pair_sum=3)


@register(
    "density_contrast",
    with_claims(
        "select 'mean_of_ratios' as mode, round(case when count(*) = count(r) then avg(r) end, 4) as ratio_02, null::double as ratio_01 "
        "from (select decile, max(density_sum / n) filter (where k = 0) / nullif(greatest(max(density_sum / n) filter (where k = 2), "
        "case when max(density_sum / n) filter (where k = 2) is null then 0 else 1e-12 end), 0) as r from cells group by decile) "
        "union all select 'ratio_of_means', round(density_0 / greatest(density_2, 1e-12), 4), "
        "round(density_0 / greatest(density_1, 1e-12), 4) from dmean",
        B20, B10, NODES, POWER, LINEAR, ONE_LABEL, DENSITY, CELLS,
    ),
)
def density_contrast(spark, sf_dir):
    cells = materialize(_labelled_deciles(spark, sf_dir, density=True), "cells")
    out = None
    for mode in ("ratio_of_means", "mean_of_ratios"):
        one = R.density_contrast(cells, mode).withColumn("mode", F.lit(mode))
        if mode == "mean_of_ratios":
            one = one.withColumn("ratio_01", F.lit(None).cast("double"))
        one = one.select("mode", "ratio_02", "ratio_01")
        out = one if out is None else out.unionByName(one)
    return round_doubles(out, 4)


PICK = """
grid as (select cand.candidate, cand.form, cand.tau1, cand.tau2, pct_0, pct_2, mono_viol, compact_0, compact_1, compact_2,
    density_0 / greatest(density_2, 1e-12) as ratio_02
    from cand join share using (candidate) join mono using (candidate) join comp using (candidate) join dmean using (candidate)),
ok as (select * from grid where pct_0 between 85.5 and 90 and pct_2 >= 1.5 and pct_2 < 3 and mono_viol = 0
    and coalesce(compact_0 < 1, true) and coalesce(compact_1 < 1, true) and coalesce(compact_2 < 1, true) and ratio_02 > 1.1),
chosen as (select * from ok where ratio_02 >= (select max(ratio_02) from ok) * 0.95
    order by starts_with(form, 'M2') desc, ratio_02 desc, candidate limit 1)"""
PICK_SELECT = """select (select count(*) from grid) as n_tried, (select count(*) from ok) as n_admissible,
  case when (select count(*) from ok) = 0 then 'no candidate meets the limits' else 'chosen' end as reason,
  form, tau1, tau2, round(pct_0, 4) as pct_0, round(pct_2, 4) as pct_2, round(ratio_02, 4) as ratio_02
from (values (1)) one(x) left join chosen on true"""


@register("constrained_pick", with_claims(PICK_SELECT, *FULL, DENSITY, CELLS, MONO, PICK))
def constrained_pick(spark, sf_dir):
    pick = R.pick_rule(materialize(_grid(spark, sf_dir), "rule-grid"))
    return round_doubles(
        pick.select("n_tried", "n_admissible", "reason", "form", "tau1", "tau2", "pct_0", "pct_2", "ratio_02"), 4
    )


FROZEN_SQL = """select c.form, c.tau1, c.tau2, lo.gamma, round(lo.alpha, 4) as alpha1, round(lo.beta, 6) as beta1,
  round(hi.alpha, 4) as alpha2, round(hi.beta, 6) as beta2
from chosen c left join power lo on lo.form = c.form and lo.tau = c.tau1 left join power hi on hi.form = c.form and hi.tau = c.tau2"""


@register("freeze_rule", with_claims(FROZEN_SQL, *FULL, DENSITY, CELLS, MONO, PICK))
def freeze_rule(spark, sf_dir):
    pick = R.pick_rule(materialize(_grid(spark, sf_dir), "rule-grid")).where("n_admissible > 0")
    path = scratch_path(spark, "rule")
    files.save_config(frozen(pick), path)
    config = files.load_config(spark, path, T.StructType.fromDDL(FROZEN_SCHEMA))
    return round_doubles(
        config.select("form", "tau1", "tau2", "gamma", "alpha1", "beta1", "alpha2", "beta2"), alpha1=4, alpha2=4
    )


@register(
    "rule_config",
    with_claims(
        "select 'M2(g=1.0)' as form, 0.86::double as tau1, 0.98::double as tau2, 1.0::double as gamma, round(alpha1, 4) as alpha1, "
        "round(beta1, 6) as beta1, round(alpha2, 4) as alpha2, round(beta2, 6) as beta2, "
        "(select count(*) from labelled where risk_class = 2) as n_severe from rule",
        *RULE_CTES,
        LINEAR,
    ),
)
def rule_config(spark, sf_dir):
    df = base(spark, sf_dir)
    path = scratch_path(spark, "rule")
    files.save_config(frozen(R.linear_rule(df)), path)
    config = files.load_config(spark, path, T.StructType.fromDDL(FROZEN_SCHEMA))
    severe = R.apply_rule(df, thawed(config)).agg(F.count_if(F.col("risk_class") == 2).alias("n")).scalar()
    out = config.select("form", "tau1", "tau2", "gamma", "alpha1", "beta1", "alpha2", "beta2")
    return round_doubles(out.withColumn("n_severe", severe), alpha1=4, alpha2=4)


@register(
    "estimate_rule",
    with_claims(
        """select lab.k::int as risk_class, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 4) as pct,
  case lab.k when 0 then 100.0::double * count(*) / sum(count(*)) over () >= 85
    when 2 then 100.0::double * count(*) / sum(count(*)) over () < 3 else true end as within_limit, any_value(chosen.form) as form
from lab join chosen using (candidate) group by lab.k""",
        *FULL,
        DENSITY,
        CELLS,
        MONO,
        PICK,
    ),
)
def estimate_rule_query(spark, sf_dir):
    est = _estimate(spark, sf_dir)
    form = est.pick.select("form").scalar()
    return round_doubles(R.class_shares(est.labels).withColumn("form", form), 4)
