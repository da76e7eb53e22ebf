"""Every check with a case that passes and one that fails, and the operators that refuse or leave out bad rows."""

import math

import pytest
from pyspark.sql import functions as F

from claimsieve.operators import quality as Q
from claimsieve.operators.binning import histogram
from claimsieve.operators.profile import spearman
from claimsieve.sources.files import RISK_LABELS, fill_template



def statuses(df):
    return {r["check_id"]: r["status"] for r in df.collect()}


@pytest.fixture(scope="module")
def result(spark):
    rows = [(i, 100 + i, 10.0 * i, RISK_LABELS[i % 3]) for i in range(5)]
    return spark.createDataFrame(rows, "ordinal long, id long, payout double, risk_label string")


@pytest.fixture(scope="module")
def template(result):
    return result.select("ordinal", "id")


@pytest.fixture(scope="module")
def claims(result):
    return result.select("ordinal", "id", (F.col("payout") + 1).alias("claim_amount"))


def test_result_passes(result, template, claims):
    assert set(statuses(Q.check_result(result, template, claims)).values()) == {"PASS"}


@pytest.mark.parametrize(
    "column, value, failed",
    [
        ("payout", None, {"no_nulls"}),
        ("payout", -1.0, {"payout_not_negative"}),
        ("payout", 1e6, {"payout_within_claim"}),
        ("risk_label", "x", {"labels_in_domain"}),
        ("risk_label", None, {"no_nulls", "labels_in_domain"}),
        ("id", 7, {"ids_as_template", "ids_as_claims"}),
    ],
)
def test_result_fails(result, template, claims, column, value, failed):
    kind = dict(result.dtypes)[column]
    bad = result.withColumn(column, F.when(F.col("ordinal") == 3, F.lit(value).cast(kind)).otherwise(F.col(column)))
    got = statuses(Q.check_result(bad, template, claims))
    assert {k for k, v in got.items() if v == "FAIL"} == failed


def test_result_with_a_row_less(result, template, claims):
    got = statuses(Q.check_result(result.where("ordinal < 4"), template, claims))
    assert {k for k, v in got.items() if v == "FAIL"} == {"shape", "ids_as_template", "ids_as_claims"}


def test_shares(spark):
    df = spark.range(100).select(F.when(F.col("id") < 90, 0).when(F.col("id") < 98, 1).otherwise(2).alias("risk_class"))
    assert statuses(Q.check_shares(df, "t")) == {"t_class_0_floor": "PASS", "t_class_2_cap": "PASS"}
    worse = df.withColumn("risk_class", F.when(F.col("risk_class") == 1, 2).otherwise(F.col("risk_class")))
    assert statuses(Q.check_shares(worse, "t")) == {"t_class_0_floor": "PASS", "t_class_2_cap": "FAIL"}
    assert statuses(Q.check_shares(df.where("risk_class > 0"), "t"))["t_class_0_floor"] == "FAIL"
    assert set(statuses(Q.check_shares(df.limit(0), "t")).values()) == {"FAIL"}


def test_refit(spark):
    nodes = spark.createDataFrame([(t, float(p), a + b * p) for t, a, b in ((0.8, 1.0, 0.5), (0.9, 3.0, 0.7)) for p in range(5)], "tau double, node_p double, q double")
    schema = "tau1 double, tau2 double, alpha1 double, beta1 double, alpha2 double, beta2 double"
    frozen = spark.createDataFrame([(0.8, 0.9, 1.0, 0.5, 3.0, 0.7)], schema)
    assert statuses(Q.check_refit(nodes, frozen)) == {"refit_lower": "PASS", "refit_upper": "PASS"}
    shifted = spark.createDataFrame([(0.8, 0.9, 1.0, 0.5, 3.0, 0.9)], schema)
    assert statuses(Q.check_refit(nodes, shifted)) == {"refit_lower": "PASS", "refit_upper": "FAIL"}
    assert statuses(Q.check_refit(nodes.where("tau > 0.85"), frozen))["refit_lower"] == "FAIL"


def test_figures(spark):
    published = spark.createDataFrame([("a", 1.0, 0.1), ("b", 2.0, 0.1), ("c", 3.0, 0.1)], "metric string, published double, tolerance double")
    found = spark.createDataFrame([("a", 1.05), ("b", 2.5)], "metric string, value double")
    assert statuses(Q.reconcile(published, found)) == {"figure_a": "PASS", "figure_b": "FAIL", "figure_c": "FAIL"}


def test_summary_and_audits(spark):
    checks = spark.createDataFrame([("a", "PASS"), ("b", "FAIL"), ("c", "FAIL")], "check_id string, status string")
    assert tuple(Q.check_summary(checks).first()) == (3, 2)
    ids = spark.createDataFrame([(1,), (1,), (5,)], "id int")
    assert Q.template_audit(ids).first().asDict() == {"id_min": 1, "id_max": 5, "n_rows": 3, "n_duplicates": 1}
    cells = spark.createDataFrame([(1, None), (None, None)], "a int, b int")
    assert Q.null_audit(cells, "t").first()["n_null_cells"] == 3


def test_template_keeps_its_columns_and_refuses_other_keys(spark):
    template = spark.createDataFrame([(2, "b", None), (1, "a", None)], "id int, note string, payout double")
    predicted = spark.createDataFrame([(1, 1.005, 0), (2, 2.0, 2)], "id int, payout_hat double, risk_class int")
    out = fill_template(template, predicted)
    assert out.columns == ["id", "note", "payout", "risk_label"]
    assert {(r["id"], r["note"], r["payout"], r["risk_label"]) for r in out.collect()} == {(1, "a", 1.0, RISK_LABELS[0]), (2, "b", 2.0, RISK_LABELS[2])}
    foreign = spark.createDataFrame([(3, 1.0, 0)], predicted.schema)
    for bad in (predicted.where("id = 1"), predicted.union(foreign), predicted.union(predicted)):
        with pytest.raises(ValueError, match="one to one"):
            fill_template(template, bad)


def test_rank_correlation_uses_the_pairs_that_are_there(spark):
    rows = [(1.0, 1.0, None), (2.0, None, None), (3.0, 2.0, None), (4.0, math.nan, None), (None, 9.0, None), (5.0, 0.5, None), (5.0, 3.0, None)]
    df = spark.createDataFrame(rows, "y double, x double, empty double")
    got = {r["column_name"]: r["rho"] for r in spearman(df, ["x", "empty"], "y").collect()}
    pairs = df.toPandas().dropna(subset=["x", "y"])
    assert set(got) == {"x"} and got["x"] == pytest.approx(pairs["x"].rank().corr(pairs["y"].rank()))


@pytest.mark.parametrize("closed", ["left", "right"])
def test_histogram_counts_every_value(spark, closed):
    df = spark.createDataFrame([(x,) for x in (-5.0, 0.0, 0.5, 1.0, 2.0, 2.5, math.nan, None, math.inf)], "x double")
    got = {r["bin"]: (r["lo"], r["hi"], r["n"]) for r in histogram(df, "x", [0, 1, 2], closed, outside=True).collect()}
    assert {b: v[:2] for b, v in got.items()} == {-1: (None, 0.0), 0: (0.0, 1.0), 1: (1.0, 2.0), 2: (2.0, None)}
    assert sum(v[2] for v in got.values()) == 7 and got[2][2] == 2
    assert got[-1][2] == (1 if closed == "left" else 2)
