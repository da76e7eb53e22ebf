"""Two-boundary risk rule: nodes, boundary fits, labels, candidate grid and choice.

``T1`` and ``T2`` are increasing curves of the payout.  A claim is class 0 up to ``T1``, class 1 up to ``T2``, else
class 2.  A curve is either a power form ``alpha + beta * p ** gamma`` or an isotonic node list with linear
interpolation.  Everything after the node table has a size fixed by parameters (20 nodes, 35 curves, 60 candidates),
whatever the number of claims.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimsieve.functions.expr import as_col, edge_rank, linspace, nan_to_null
from claimsieve.operators.binning import qcut
from claimsieve.operators.order import quantile_columns, quantile_table
from claimsieve.session import materialize

TAUS_LOW = (0.85, 0.86, 0.88, 0.9)
TAUS_HIGH = (0.97, 0.98, 0.99)
GAMMAS = (1.0, 1.2, 1.5, 2.0)
NODES = 20
DECILES = 10
COMPARE_DIGITS = 6


# ---- nodes -----------------------------------------------------------------------------------------------------


def rule_nodes(df: DataFrame, k: int = NODES, payout: str = "payout") -> DataFrame:
    """Per payout bin: median payout and number of claims."""
    binned = qcut(df, payout, k)
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).join(
        quantile_columns(binned, payout, {"node_p": 0.5}, ["bin"]), "bin"
    )


def node_quantiles(
    df: DataFrame, taus: Sequence[float], k: int = NODES, payout: str = "payout", excess: str = "excess"
) -> DataFrame:
    """Long node table ``(bin, node_p, n, tau, q)``: the excess quantiles of every payout bin in one pass.

    The binned two-column table feeds three passes and the node table feeds every fit, so both are written once.
    """
    binned = materialize(qcut(df.select(payout, excess), payout, k), "rule-bins")
    size = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    wanted = {"node_p": (payout, 0.5)} | {f"q{i}": (excess, float(t)) for i, t in enumerate(taus)}
    cells = F.array(
        *[F.struct(F.lit(float(t)).alias("tau"), F.col(f"q{i}").alias("q")) for i, t in enumerate(taus)]
    )
    nodes = (
        quantile_table(binned, wanted, ["bin"]).join(size, "bin").select("bin", "node_p", "n", F.inline(cells))
    )
    return materialize(nodes, "rule-nodes")


# ---- boundary fits ---------------------------------------------------------------------------------------------


def isotonic_fit(nodes: DataFrame) -> DataFrame:
    """Weighted increasing fit per ``tau``: ``(tau, xs, ys)``.

    Uses the min-max form of isotonic regression, ``max over a <= i of min over b >= i of the weighted mean of a..b``,
    on the bounded node array of one ``tau``.
    """
    packed = nodes.groupBy("tau").agg(F.array_sort(F.collect_list(F.struct("bin", "node_p", "n", "q"))).alias("v"))

    def running(f) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size("v")),
            lambda j: F.aggregate(F.slice("v", F.lit(1), j), F.lit(0.0), lambda acc, s: acc + f(s)),
        )

    sums = packed.withColumn("_w", running(lambda s: s["n"].cast("double"))).withColumn(
        "_s", running(lambda s: s["n"] * s["q"])
    )

    def mean(a: Column, b: Column) -> Column:
        weight = F.get("_w", b) - F.get("_w", a - 1)
        return (F.get("_s", b) - F.get("_s", a - 1)) / weight

    size = F.size("v")
    fitted = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.array_max(
            F.transform(
                F.sequence(F.lit(1), i),
                lambda a: F.array_min(F.transform(F.sequence(i, size), lambda b: mean(a, b))),
            )
        ),
    )
    return sums.select("tau", F.transform("v", lambda s: s["node_p"]).alias("xs"), fitted.alias("ys"))


def power_fit(nodes: DataFrame, gammas: Sequence[float] = GAMMAS, weight: str | None = None) -> DataFrame:
    """Least squares of the node quantile on ``p ** gamma``: ``(tau, gamma, alpha, beta)``.

    Unweighted unless ``weight`` names a column.  A negative intercept is replaced by a fit through the origin.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    x, y = F.pow("node_p", "gamma"), F.col("q")
    cells = nodes.withColumn("gamma", F.explode(F.array(*[F.lit(float(g)) for g in gammas])))
    cells = cells.select("tau", "gamma", x.alias("x"), y.alias("y"), w.cast("double").alias("w"))
    centre = Window.partitionBy("tau", "gamma")
    xc = F.col("x") - F.sum(F.col("w") * F.col("x")).over(centre) / F.sum("w").over(centre)
    yc = F.col("y") - F.sum(F.col("w") * F.col("y")).over(centre) / F.sum("w").over(centre)
    sums = (
        cells.withColumn("xc", xc)
        .withColumn("yc", yc)
        .groupBy("tau", "gamma")
        .agg(
            F.sum(F.col("w") * F.col("xc") * F.col("yc")).alias("sxy"),
            F.sum(F.col("w") * F.col("xc") * F.col("xc")).alias("sxx"),
            (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mx"),
            (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("my"),
            F.try_divide(F.sum(F.col("w") * F.col("x") * F.col("y")), F.sum(F.col("w") * F.col("x") * F.col("x"))).alias(
                "origin"
            ),
        )
    )
    slope = F.coalesce(F.try_divide(F.col("sxy"), F.col("sxx")), F.lit(0.0))
    alpha = F.col("my") - slope * F.col("mx")
    return sums.select(
        "tau",
        "gamma",
        F.when(alpha < 0, 0.0).otherwise(alpha).alias("alpha"),
        F.when(alpha < 0, F.col("origin")).otherwise(slope).alias("beta"),
    )


def curves(nodes: DataFrame, gammas: Sequence[float] = GAMMAS, isotonic: bool = True) -> DataFrame:
    """All boundary curves in one layout: ``(form, tau, gamma, alpha, beta, xs, ys)``."""
    power = power_fit(nodes, gammas).select(
        F.concat(F.lit("M2(g="), F.col("gamma").cast("string"), F.lit(")")).alias("form"),
        "tau",
        "gamma",
        "alpha",
        "beta",
        F.lit(None).cast("array<double>").alias("xs"),
        F.lit(None).cast("array<double>").alias("ys"),
    )
    if not isotonic:
        return power
    nothing = F.lit(None).cast("double")
    steps = isotonic_fit(nodes).select(
        F.lit("M1").alias("form"),
        "tau",
        nothing.alias("gamma"),
        nothing.alias("alpha"),
        nothing.alias("beta"),
        "xs",
        "ys",
    )
    return steps.unionByName(power)


def candidates(
    fitted: DataFrame, taus_low: Sequence[float] = TAUS_LOW, taus_high: Sequence[float] = TAUS_HIGH
) -> DataFrame:
    """Every (form, lower level, upper level) as one frozen-rule row with a stable ordinal."""
    curve = ["gamma", "alpha", "beta", "xs", "ys"]
    low = fitted.where(F.col("tau").isin(*taus_low)).select("form", F.col("tau").alias("tau1"), F.struct(*curve).alias("lower"))
    high = fitted.where(F.col("tau").isin(*taus_high)).select("form", F.col("tau").alias("tau2"), F.struct(*curve).alias("upper"))
    order = Window.partitionBy(F.lit(0)).orderBy("tau1", "tau2", "form")
    return low.join(high, "form").withColumn("candidate", F.row_number().over(order) - 1)


# ---- labels ----------------------------------------------------------------------------------------------------


def locate(df: DataFrame, xs: Column, x: str) -> DataFrame:
    """Add ``_seg`` and ``_frac``: the segment of ``x`` among sorted nodes and the position in it, clamped to 0..1.

    Found once per row and shared by every curve on the same nodes.
    """
    low, high = F.get(xs, F.col("_seg") - 1), F.get(xs, F.col("_seg"))
    inside = F.try_divide(F.col(x) - low, high - low)
    return df.withColumn(
        "_seg", F.greatest(F.lit(1), F.least(edge_rank(xs, x), F.size(xs) - 1))
    ).withColumn("_frac", F.greatest(F.lit(0.0), F.least(F.lit(1.0), inside)))


def interpolate(ys: Column) -> Column:
    """Piecewise linear at the position found by :func:`locate`, constant outside the nodes."""
    y0, y1 = F.get(ys, F.col("_seg") - 1), F.get(ys, F.col("_seg"))
    return y0 + (y1 - y0) * F.col("_frac")


def boundary(curve: Column, p: Column | str) -> Column:
    """Value of a curve struct at payout ``p``; isotonic curves use the columns of :func:`locate`."""
    power = curve["alpha"] + curve["beta"] * F.pow(F.greatest(as_col(p), F.lit(1e-9)), curve["gamma"])
    return F.when(curve["ys"].isNull(), power).otherwise(interpolate(curve["ys"]))


def comparable(c: Column | str) -> Column:
    """Rounded to ``COMPARE_DIGITS`` places as a whole number of units, so that ties between engines are stable."""
    return F.floor(as_col(c) * float(10**COMPARE_DIGITS) + 0.5)


def risk_class(t1: Column, t2: Column, u: Column) -> Column:
    """Class of a comparable excess under two comparable boundaries."""
    known = u.isNotNull() & t1.isNotNull() & t2.isNotNull()
    return F.when(known, F.when(u <= t1, 0).when(u <= t2, 1).otherwise(2))


def as_scalar(table: DataFrame) -> Column:
    """A one-row table as a scalar subquery: no join, evaluated once and inlined as a literal."""
    return table.select(F.struct(*table.columns).alias("row")).scalar()


def apply_rule(
    df: DataFrame, rule: DataFrame, payout: str = "payout", excess: str = "excess", keep_boundaries: bool = False
) -> DataFrame:
    """Add ``risk_class`` (and ``t1``, ``t2``) under a one-row frozen rule; row-local.  A missing or NaN payout or excess has
    no class."""
    ruled = df.withColumn("_rule", as_scalar(rule.select("lower", "upper"))).withColumn("_p", nan_to_null(payout))
    out = (
        locate(ruled, F.col("_rule.lower.xs"), "_p")
        .withColumn("t1", F.when(F.col("_p").isNotNull(), boundary(F.col("_rule.lower"), "_p")))
        .withColumn("t2", F.when(F.col("_p").isNotNull(), boundary(F.col("_rule.upper"), "_p")))
        .withColumn("risk_class", risk_class(comparable("t1"), comparable("t2"), comparable(nan_to_null(excess))))
    )
    return out.drop("_rule", "_p", "_seg", "_frac", *([] if keep_boundaries else ["t1", "t2"]))


def linear_rule(df: DataFrame, tau1: float = 0.86, tau2: float = 0.98, k: int = NODES) -> DataFrame:
    """One-row frozen rule of the linear form."""
    fitted = curves(node_quantiles(df, sorted({tau1, tau2}), k), [1.0], isotonic=False)
    return candidates(fitted, [tau1], [tau2])


# ---- candidate grid --------------------------------------------------------------------------------------------


def rule_candidates(
    df: DataFrame,
    taus_low: Sequence[float] = TAUS_LOW,
    taus_high: Sequence[float] = TAUS_HIGH,
    gammas: Sequence[float] = GAMMAS,
    isotonic: bool = True,
    k: int = NODES,
) -> DataFrame:
    taus = sorted({*taus_low, *taus_high})
    return candidates(curves(node_quantiles(df, taus, k), gammas, isotonic), taus_low, taus_high)


def packed_grid(grid: DataFrame) -> Column:
    """Scalar subquery ``(nodes, curves[], candidates[])``; a candidate names its two curves by position.

    Sixty candidates use only 35 different curves, and the isotonic ones share their nodes.
    """
    ends = grid.select(
        "candidate", F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.col(e).alias("curve")) for e in ("lower", "upper")])).alias("c")
    ).select("candidate", "c.end", "c.curve")
    distinct = ends.groupBy("curve").agg(F.collect_list(F.struct("end", "candidate")).alias("used_by"))
    numbered = distinct.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("curve")) - 1)
    curves_ = numbered.agg(
        F.max("curve.xs").alias("xs"),
        F.array_sort(F.collect_list(F.struct("pos", "curve"))).alias("curves"),
    )
    uses = numbered.select("pos", F.inline("used_by")).groupBy("candidate").agg(
        F.max(F.when(F.col("end") == "lower", F.col("pos"))).alias("i1"),
        F.max(F.when(F.col("end") == "upper", F.col("pos"))).alias("i2"),
    )
    cands = uses.agg(F.collect_list(F.struct("candidate", "i1", "i2")).alias("cands")).scalar()
    return curves_.select(F.struct("xs", "curves", cands.alias("cands")).alias("g")).scalar()


def with_candidates(df: DataFrame, grid: DataFrame, payout: str = "payout", excess: str = "excess") -> DataFrame:
    """Every claim under every candidate: ``(…, candidate, t1, t2, risk_class)``.

    The grid is a bounded value in a scalar subquery.  Each curve is evaluated once per claim; rows are expanded inside
    the task that reads them and callers aggregate before any shuffle.
    """
    located = locate(df.withColumn("_grid", packed_grid(grid)), F.col("_grid.xs"), payout)
    valued = located.withColumn("_t", F.transform("_grid.curves", lambda c: boundary(c["curve"], payout))).withColumn(
        "_u", comparable(excess)
    )
    return (
        valued.select(*df.columns, "_u", "_t", F.inline("_grid.cands"))
        .withColumn("t1", F.get("_t", F.col("i1")))
        .withColumn("t2", F.get("_t", F.col("i2")))
        .withColumn("risk_class", risk_class(comparable("t1"), comparable("t2"), F.col("_u")))
        .drop("_u", "_t", "i1", "i2")
    )


def candidate_cells(
    df: DataFrame, grid: DataFrame, payout: str = "payout", excess: str = "excess", density: str | None = "density"
) -> DataFrame:
    """The one aggregation all candidate measures come from: per (candidate, decile, class) count, range and density sum."""
    kept = [payout, excess, "decile"] + ([density] if density else [])
    expanded = with_candidates(df.select(*kept), grid, payout, excess)
    measure = F.sum(density) if density else F.lit(None).cast("double")
    return expanded.groupBy("candidate", "decile", "risk_class").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(excess).alias("u_min"),
        F.max(excess).alias("u_max"),
        measure.alias("density_sum"),
    )


CLASSES = (0, 1, 2)


def class_share_columns(cells: DataFrame) -> DataFrame:
    total = F.sum("n")
    return cells.groupBy("candidate").agg(
        *[(F.sum(F.when(F.col("risk_class") == k, F.col("n")).otherwise(0)) / total * 100).alias(f"pct_{k}") for k in CLASSES],
        F.sum(F.when(F.col("risk_class") == 2, F.col("n")).otherwise(0)).alias("n_severe"),
    )


def compactness(cells: DataFrame, min_n: int = 10) -> DataFrame:
    """Range of a class within a payout decile over the range of the decile, averaged over deciles, per class."""
    pool = Window.partitionBy("candidate", "decile")
    spread = F.max("u_max").over(pool) - F.min("u_min").over(pool)
    part = cells.withColumn("_r", F.when((spread > 0) & (F.col("n") >= min_n), (F.col("u_max") - F.col("u_min")) / spread))
    wide = part.groupBy("candidate").agg(
        *[F.avg(F.when(F.col("risk_class") == k, F.col("_r"))).alias(f"compact_{k}") for k in CLASSES]
    )
    ok = F.lit(True)
    for k in CLASSES:
        ok = ok & F.coalesce(F.col(f"compact_{k}") < 1, F.lit(True))
    return wide.withColumn("compact_ok", ok)


def density_contrast(cells: DataFrame, mode: str = "ratio_of_means", min_n: int = 10) -> DataFrame:
    """Mean kernel density per class and its ratios to the other classes.

    ``ratio_of_means``: means over deciles with at least ``min_n`` members, then one ratio.  ``mean_of_ratios``: the
    class 0 / class 2 ratio of every decile, then the mean; null if any decile lacks one of the classes.
    """
    tiny = F.lit(1e-12)
    mean = F.col("density_sum") / F.col("n")
    if mode == "ratio_of_means":
        member = F.when(F.col("n") >= min_n, mean)
        wide = cells.groupBy("candidate").agg(
            *[F.avg(F.when(F.col("risk_class") == k, member)).alias(f"density_{k}") for k in CLASSES]
        )
        return wide.withColumn("ratio_02", F.col("density_0") / F.greatest("density_2", tiny)).withColumn(
            "ratio_01", F.col("density_0") / F.greatest("density_1", tiny)
        )
    if mode != "mean_of_ratios":
        raise ValueError("mode must be 'ratio_of_means' or 'mean_of_ratios'")
    per_decile = cells.groupBy("candidate", "decile").agg(
        *[F.max(F.when(F.col("risk_class") == k, mean)).alias(f"d{k}") for k in (0, 2)]
    )
    ratio = F.when(F.col("d2").isNotNull(), F.col("d0") / F.greatest("d2", tiny))
    return per_decile.groupBy("candidate").agg(
        F.when(F.count(ratio) == F.count(F.lit(1)), F.avg(ratio)).alias("ratio_02")
    )


def monotone_violations(grid: DataFrame, df: DataFrame, payout: str = "payout", points: int = 200) -> DataFrame:
    """Per candidate: decreases of either boundary on an even payout grid plus points where ``T2 <= T1``."""
    ends = df.agg(F.struct(F.min(payout).alias("lo"), F.max(payout).alias("hi")).alias("ends")).scalar()
    p = grid.withColumn("_ends", ends).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    placed = p.select(
        "candidate",
        "_i",
        "lower",
        "upper",
        linspace(F.col("_ends.lo"), F.col("_ends.hi"), F.col("_i"), points).alias("_p"),
    )
    curve = locate(placed, F.col("lower.xs"), "_p").select(
        "candidate", "_i", boundary(F.col("lower"), "_p").alias("t1"), boundary(F.col("upper"), "_p").alias("t2")
    )
    step = Window.partitionBy("candidate").orderBy("_i")

    def falls(c: str) -> Column:
        return F.when(F.col(c) - F.lag(c).over(step) < -1e-12, 1).otherwise(0)

    crossing = F.when(F.col("t2") <= F.col("t1") + 1e-12, 1).otherwise(0)
    return (
        curve.withColumn("_v", falls("t1") + falls("t2") + crossing)
        .groupBy("candidate")
        .agg(F.sum("_v").alias("mono_viol"))
    )


def rule_grid(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Every candidate with its shares, monotonicity, compactness and density measures.

    ``df`` carries ``payout``, ``excess``, ``decile`` and ``density``; it is read once for all candidates.
    """
    cells = materialize(candidate_cells(df, grid), "rule-cells")  # at most 1,800 rows, read by three reports
    return (
        grid.join(class_share_columns(cells), "candidate")
        .join(monotone_violations(grid, df), "candidate")
        .join(compactness(cells), "candidate")
        .join(density_contrast(cells), "candidate")
    )


def admissible(grid: DataFrame) -> DataFrame:
    """Limits on the class shares, no monotonicity violation, compact classes, density contrast above 1.1."""
    return grid.where(
        F.col("pct_0").between(85.5, 90.0)
        & (F.col("pct_2") >= 1.5)
        & (F.col("pct_2") < 3.0)
        & (F.col("mono_viol") == 0)
        & F.col("compact_ok")
        & (F.col("ratio_02") > 1.1)
    )


def pick_rule(grid: DataFrame, slack: float = 0.05) -> DataFrame:
    """Best admissible candidate: within ``slack`` of the best density ratio, power forms first.

    Always one row; without an admissible candidate the rule columns are null and ``reason`` says so.
    """
    ok = admissible(grid)
    best = ok.agg(F.max("ratio_02").alias("m")).scalar()
    close = ok.withColumn("_best", best).where(F.col("ratio_02") >= F.col("_best") * (1 - slack)).drop("_best")
    chosen = close.orderBy(
        F.col("form").startswith("M2").desc(), F.col("ratio_02").desc(), F.col("candidate")
    ).limit(1)
    counts = grid.agg(F.count(F.lit(1)).alias("n_tried")).withColumn(
        "n_admissible", ok.agg(F.count(F.lit(1)).alias("n")).scalar()
    )
    reason = F.when(F.col("n_admissible") == 0, "no candidate meets the limits").otherwise("chosen")
    return (
        counts.withColumn("_chosen", as_scalar(chosen))
        .withColumn("reason", reason)
        .select("n_tried", "n_admissible", "reason", "_chosen.*")
    )


# ---- class reports ---------------------------------------------------------------------------------------------


def class_shares(labelled: DataFrame, floor_0: float = 85.0, cap_2: float = 3.0) -> DataFrame:
    """Count and share per class, and whether the class limits hold."""
    counts = labelled.groupBy("risk_class").agg(F.count(F.lit(1)).alias("n"))
    pct = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))) * 100
    within = F.when(F.col("risk_class") == 0, F.col("pct") >= floor_0).when(F.col("risk_class") == 2, F.col("pct") < cap_2)
    return counts.withColumn("pct", pct).withColumn("within_limit", F.coalesce(within, F.lit(True)))


def class_profile(labelled: DataFrame, payout: str = "payout", excess: str = "excess") -> DataFrame:
    basic = labelled.groupBy("risk_class").agg(
        F.count(F.lit(1)).alias("n"), F.max(excess).alias("u_max"), F.avg(payout).alias("p_mean")
    )
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))) * 100
    wanted = {"u_med": (excess, 0.5), "u_q25": (excess, 0.25), "u_q75": (excess, 0.75), "p_med": (payout, 0.5)}
    return basic.withColumn("pct", share).join(quantile_table(labelled, wanted, ["risk_class"]), "risk_class")
