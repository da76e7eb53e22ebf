"""Reports over predictions, pair sums within groups and the replacement report, against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimsieve.operators import classify as N
from claimsieve.operators.density import bandwidth, pair_sums
from claimsieve.operators.regress import regression_metrics, share_baselines
from claimsieve.operators.report import prediction_summary
from claimsieve.operators.textjobs import dictionary_hits, dictionary_replace, replacement_report


def test_pair_sums_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    hot = np.concatenate([rng.gamma(2.0, 300.0, 900), np.full(500, 250.0)])
    rows = [(1, float(v)) for v in hot] + [(2, 3.0), (2, 9.0), (2, None), (3, 4.0), (3, 4.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "decile int, excess double").repartition(5)
    h = {r["decile"]: r["h"] for r in bandwidth(df).collect()}
    got = {r["decile"]: r for r in pair_sums(df).collect()}
    for group, values in ((1, hot), (2, np.array([3.0, 9.0]))):
        z = (values[:, None] - values[None, :]) / h[group]
        want = np.exp(-0.5 * z * z).sum()
        assert got[group]["pair_sum"] == pytest.approx(want, rel=1e-10)
        assert got[group]["mean_density"] == pytest.approx(want / (len(values) ** 2 * h[group] * math.sqrt(2 * math.pi)), rel=1e-10)
    assert got[2]["n"] == 3 and got[3]["n"] == 2 and got[3]["pair_sum"] is None and got[None]["pair_sum"] is None
    assert pair_sums(df.where("false")).count() == 0


PAIRS = [("a", "b"), ("b", "a"), ("x", "xx"), ("q", "z"), ("", "never"), (".", "!")]


def test_replacement_report_tells_what_is_left(spark):
    texts = ["abc", "x.y", "", None, "x", "...", "a" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = dictionary_replace(df, PAIRS)
    plain, found = [], []
    for t in texts:
        hits = []
        for i, (old, new) in enumerate(PAIRS):
            if t is not None and old and old in t:
                hits.append(i)
                t = t.replace(old, new)
        plain.append(t)
        found.append(hits)
    got = out.orderBy("doc_id").collect()
    assert [r["text"] for r in got] == plain and [r["hits"] for r in got] == found
    report = {r["entry"]: r for r in replacement_report(out, PAIRS).collect()}
    for i, (old, _) in enumerate(PAIRS):
        n, left = sum(i in f for f in found), sum(bool(t) and bool(old) and old in t for t in plain)
        assert (report[i]["n_documents"], report[i]["n_still_present"]) == (n, left)
        assert report[i]["problem"] == ("still present" if left else None if n else "never hit")
    empty = replacement_report(out.where("false"), PAIRS).collect()
    assert len(empty) == len(PAIRS) and {r["problem"] for r in empty} == {"never hit"}
    assert dictionary_hits(dictionary_replace(df, []), []).count() == 0


def test_replacement_with_many_entries(spark):
    pairs = [(f"<{i}>", str(i)) for i in range(1500)]
    df = spark.createDataFrame([(1, "".join(f"<{i}> " for i in range(0, 1500, 3)))], "doc_id int, text string")
    row = dictionary_replace(df, pairs).first()
    assert row["text"] == "".join(f"{i} " for i in range(0, 1500, 3)) and row["hits"] == list(range(0, 1500, 3))


def test_summary_leaves_out_what_is_no_prediction(spark):
    df = spark.createDataFrame([(1.0,), (4.0,), (10.0,), (None,), (math.nan,)], "payout_hat double")
    assert prediction_summary(df).first().asDict() == {"n": 3, "mean": 5.0, "min": 1.0, "max": 10.0, "median": 4.0}
    none = prediction_summary(df.where("false")).first()
    assert none["n"] == 0 and none["median"] is None


def test_shares_are_scored_in_one_pass(spark):
    df = spark.createDataFrame([(100.0, 50.0), (200.0, 80.0)], "claim_amount double, payout double")
    scored = share_baselines(df, [0.4, 0.5])
    got = {r["share"]: r["mae"] for r in regression_metrics(scored, by=["config", "share"]).collect()}
    assert got == {0.4: 5.0, 0.5: 10.0}
    assert scored._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_first_of_the_best_schemes(spark):
    rows = [(i % 2, k, p) for i, (k, p) in enumerate([(0, 0), (1, 1), (2, 2), (0, 0), (1, 0), (2, 2)] * 4)]
    good = spark.createDataFrame(rows, "fold int, risk_class int, predicted int")
    parts = [good.withColumn("predicted", F.lit(0)), good, good]
    named = [d.select(F.lit(i).alias("ordinal"), F.lit(f"s{i}").alias("scheme"), "*") for i, d in enumerate(parts)]
    report = N.scheme_report(named[0].unionByName(named[1]).unionByName(named[2]))
    assert N.best_scheme(report).first()["scheme"] == "s1"
    compared = {(r["route"], r["risk_class"]): r for r in N.compare_routes({"A": good, "B": parts[0]}).collect()}
    alone = {r["risk_class"]: r for r in N.class_metrics(good).collect()}
    assert all(compared["A", k]["f1"] == alone[k]["f1"] for k in alone) and compared["B", 2]["recall"] == 0.0
