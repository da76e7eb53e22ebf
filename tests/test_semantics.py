import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimsieve.functions.expr import argmax, edge_rank, half_even
from claimsieve.operators import classify as N
from claimsieve.operators import clean as C
from claimsieve.operators import rule as R
from claimsieve.operators.binning import equal_width_histogram, histogram, qcut
from claimsieve.operators.profile import duplicate_rows, spearman
from claimsieve.operators.regress import freeze_trees, regression_metrics


def frame(spark, values, name="v"):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"claim_key long, {name} double")


@pytest.mark.parametrize("k", [3, 8, 20])
def test_qcut_matches_pandas_with_ties(spark, k):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(400, 7.0), rng.exponential(50, 800).round(1), [0.0, 0.0, 1e9]])
    got = qcut(frame(spark, values), "v", k).toPandas().sort_values("claim_key").bin.to_numpy()
    want = pd.qcut(values, k, labels=False, duplicates="drop")
    assert (got == want).all()


def test_qcut_of_a_constant(spark):
    assert {r.bin for r in qcut(frame(spark, [3, 3, 3]), "v", 4).collect()} == {0}


def test_histogram_sides(spark):
    df = frame(spark, [0, 1, 1, 2, 3, 4, 9])
    right = [r.n for r in histogram(df, "v", [0, 1, 2, 3], "right").orderBy("bin").collect()]
    left = [r.n for r in histogram(df, "v", [0, 1, 2, 3], "left").orderBy("bin").collect()]
    assert right == list(pd.cut(pd.Series([0, 1, 1, 2, 3, 4, 9]), [0, 1, 2, 3]).value_counts().sort_index())
    assert left == list(np.histogram([0, 1, 1, 2, 3, 4, 9], [0, 1, 2, 3])[0])


def test_equal_width_histogram_matches_cut(spark):
    values = pd.Series(np.random.default_rng(3).normal(size=500))
    got = [r.n for r in equal_width_histogram(frame(spark, values), "v", 20).orderBy("bin").collect()]
    assert got == list(pd.cut(values, 20).value_counts().sort_index())


def test_half_even_and_first_maximum(spark):
    row = spark.range(1).select(
        half_even(F.lit(2.5)).alias("a"), half_even(F.lit(0.125), 2).alias("b"), argmax(F.array(F.lit(1), F.lit(3), F.lit(3))).alias("c")
    ).first()
    assert (row.a, row.b, row.c) == (2.0, 0.12, 1)


@pytest.mark.parametrize("inclusive", [False, True])
def test_edge_rank_counts_smaller_entries(spark, inclusive):
    edges = [1.0, 2.0, 2.0, 5.0, 8.0]
    df = frame(spark, [0, 1, 1.5, 2, 3, 5, 8, 9]).withColumn("e", F.array(*[F.lit(e) for e in edges]))
    for r in df.withColumn("n", edge_rank("e", "v", 5, inclusive)).collect():
        assert r.n == sum(e <= r.v if inclusive else e < r.v for e in edges)


def test_bad_numbers_and_nan(spark):
    df = spark.createDataFrame([("1.5",), ("route_type",), ("NaN",), ("",), (None,)], "x string")
    assert [r.x for r in C.coerce(df, ["x"]).collect()] == [1.5, None, None, None, None]
    report = C.coercion_report(df, ["x"]).first()
    assert (report.n_present, report.n_failed) == (4, 3)
    flags = C.negative_flags(C.coerce(df, ["x"]), ["x"]).collect()
    assert [r.x_negative for r in flags] == [0] * 5


def test_header_row_is_dropped_and_null_kept(spark):
    df = spark.createDataFrame([("a",), ("route_type",), (None,)], "route_type string")
    assert C.drop_embedded_header(df, "route_type", "route_type").count() == 2


def test_require_not_null_fails(spark):
    df = C.coerce(spark.createDataFrame([("1",), ("x",)], "payout string"), ["payout"])
    with pytest.raises(Exception, match="could not be converted"):
        C.require_not_null(df, "payout").collect()


def nodes(spark, rows):
    return spark.createDataFrame(rows, "bin int, node_p double, n long, tau double, q double")


def test_isotonic_pools_weighted(spark):
    rows = [(0, 1.0, 1, 0.9, 1.0), (1, 2.0, 1, 0.9, 3.0), (2, 3.0, 2, 0.9, 2.0), (3, 4.0, 1, 0.9, 4.0)]
    fit = R.isotonic_fit(nodes(spark, rows)).first()
    assert fit.ys == pytest.approx([1, 7 / 3, 7 / 3, 4])


def test_negative_intercept_goes_through_origin(spark):
    rows = [(i, float(p), 5, 0.9, q) for i, (p, q) in enumerate([(1, 0.1), (2, 3.0), (3, 9.0)])]
    fit = R.power_fit(nodes(spark, rows), [1.0]).first()
    assert fit.alpha == 0
    assert fit.beta == pytest.approx((0.1 + 6 + 27) / 14)


def test_monotone_scan_finds_a_falling_boundary(spark):
    curve = "struct<gamma:double,alpha:double,beta:double,xs:array<double>,ys:array<double>>"
    grid = spark.createDataFrame(
        [(0, (1.0, 5.0, 1.0, None, None), (1.0, 9.0, 2.0, None, None)), (1, (1.0, 50.0, -1.0, None, None), (1.0, 1.0, 0.5, None, None))],
        f"candidate int, lower {curve}, upper {curve}",
    )
    got = {r.candidate: r.mono_viol for r in R.monotone_violations(grid, frame(spark, [0, 10], "payout")).collect()}
    assert got[0] == 0 and got[1] == 199 + 200


def grid_rows(spark, rows):
    cols = "candidate int, form string, tau1 double, tau2 double, pct_0 double, pct_2 double, mono_viol long, compact_ok boolean, ratio_02 double"
    curve = F.lit(None).cast("struct<gamma:double,alpha:double,beta:double,xs:array<double>,ys:array<double>>")
    return spark.createDataFrame(rows, cols).withColumn("lower", curve).withColumn("upper", curve)


def test_pick_prefers_power_form_within_slack(spark):
    rows = [
        (0, "M1", 0.86, 0.98, 86.0, 2.0, 0, True, 40.0),
        (1, "M2(g=1.0)", 0.86, 0.98, 86.0, 2.0, 0, True, 38.9),
        (2, "M2(g=1.2)", 0.86, 0.98, 86.0, 2.0, 0, True, 38.5),
        (3, "M2(g=1.5)", 0.86, 0.98, 86.0, 3.0, 0, True, 99.0),
        (4, "M2(g=2.0)", 0.86, 0.98, 91.0, 2.0, 0, True, 99.0),
    ]
    pick = R.pick_rule(grid_rows(spark, rows)).first()
    assert (pick.form, pick.n_admissible, pick.n_tried) == ("M2(g=1.0)", 3, 5)


def test_pick_reports_an_empty_choice(spark):
    pick = R.pick_rule(grid_rows(spark, [(0, "M1", 0.86, 0.98, 80.0, 2.0, 0, True, 40.0)])).collect()
    assert len(pick) == 1 and pick[0].form is None and pick[0].reason == "no candidate meets the limits"


def labelled_range(spark, counts):
    edges = np.cumsum(counts)
    label = F.when(F.col("id") < int(edges[0]), 0).when(F.col("id") < int(edges[1]), 1).otherwise(2)
    return spark.range(int(edges[2])).select(F.col("id").alias("claim_key"), label.alias("risk_class"))


def test_oversample_counts(spark):
    df = labelled_range(spark, [9600, 1336, 231])
    grown = N.oversample(df, {1: 0.5, 2: 0.5})
    assert {r.risk_class: r["count"] for r in grown.groupBy("risk_class").count().collect()} == {0: 9600, 1: 4800, 2: 4800}
    assert grown.select("claim_key").distinct().count() == df.count()
    assert N.oversample(df, {1: 0.1, 2: 0.01}).count() == df.count() + 0


def cells(spark, matrix):
    rows = [(t, p, matrix[t][p]) for t in range(3) for p in range(3)]
    return spark.createDataFrame(rows, "true_class int, pred_class int, n long")


def test_metrics_of_known_matrices(spark):
    direct = {r.risk_class: r for r in N.metrics_from_cells(cells(spark, [[9506, 88, 6], [474, 776, 86], [7, 171, 53]])).collect()}
    via_rule = {r.risk_class: r for r in N.metrics_from_cells(cells(spark, [[9552, 48, 0], [528, 798, 10], [7, 219, 5]])).collect()}
    assert direct[0].macro_f1 == pytest.approx(0.635712, abs=1e-6)
    assert via_rule[0].macro_f1 == pytest.approx(0.558587, abs=1e-6)
    assert direct[2].precision == pytest.approx(0.366, abs=5e-4)
    assert via_rule[2].precision == pytest.approx(0.333, abs=5e-4)


def test_majority_baseline(spark):
    row = N.majority_baseline(labelled_range(spark, [9600, 1336, 231])).first()
    assert row.macro_f1 == pytest.approx(0.308, abs=5e-4)


def test_spearman_matches_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.integers(0, 5, 400), "b": rng.normal(size=400).round(1), "y": rng.exponential(3, 400).round(1)})
    got = {r.column_name: r.rho for r in spearman(spark.createDataFrame(pdf), ["a", "b"], "y").collect()}
    for c in "ab":
        assert got[c] == pytest.approx(pdf[c].rank().corr(pdf.y.rank()))


def test_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (1, None)], "a int, b string")
    row = duplicate_rows(df, ["a", "b"]).first()
    assert (row.n_rows, row.n_duplicates) == (4, 2)


def test_freeze_trees(spark):
    df = spark.createDataFrame([(10,), (165,), (166,), (167,), (4000,)], "best_iteration int")
    assert freeze_trees(df).first().n_trees == 199
    assert freeze_trees(df.limit(1)).first().n_trees == 100


def test_metrics_clamp_at_zero(spark):
    df = spark.createDataFrame([(2.0, -5.0), (0.5, 0.5)], "payout double, payout_hat double")
    row = regression_metrics(df).first()
    assert (row.mae, row.mape_ge1, row.wape) == pytest.approx((1.0, 100.0, 80.0))
