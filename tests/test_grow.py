"""Trees grown on binned rows in one task are those of Spark ML, and the model queries do all their rounds."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from claimsieve.catalog import modelling as C
from claimsieve.operators import grow as G
from claimsieve.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    """Numbers, a function of one of them, flags and a category, some rows twice."""
    rng = np.random.default_rng(7)
    n = 900
    x, z, level = rng.integers(0, 300, n), rng.normal(size=n).round(2), rng.integers(0, 6, n)
    y = 40.0 * (x > 120) + 25.0 * np.isin(level, (1, 4)) + 10 * z * z + rng.normal(size=n).round(3) + 60
    data = [(i, float(a), float(a // 2), float(b), float(b > 0), float(c), float(v), int(i % 5 == 0)) for i, (a, b, c, v) in enumerate(zip(x, z, level, y))]
    df = spark.createDataFrame([*data, *data[:40]], "claim_key int, a double, half double, b double, flag double, c double, payout double, side int")
    df = df.withColumn("c", F.col("c").alias("c", metadata={"ml_attr": {"type": "nominal", "vals": [str(i) for i in range(7)], "name": "c"}}))
    return VectorAssembler(inputCols=["a", "half", "b", "flag", "c"], outputCol="features").transform(df).select("claim_key", "features", "payout", "side").cache()


@pytest.mark.parametrize("objective", ["l2", "l1", "log"])
def test_trees_in_one_task_are_those_of_spark_ml(rows, objective, monkeypatch, tmp_path):
    spec = M.GbtSpec(objective, 0.3, 3, 10, 4)
    slow = M.boost(rows, spec, 32, inner="side")
    monkeypatch.setattr(M, "FEW_TREES", 0)
    fast = M.boost(rows, spec, 32, inner="side")
    assert isinstance(fast.model, M.BoostedAtOnce) and not isinstance(slow.model, M.BoostedAtOnce)
    assert fast.training == pytest.approx(slow.training) and fast.inner == pytest.approx(slow.inner) and fast.best == slow.best
    listed = lambda m: [r["payout_hat"] for r in m.predict(rows).orderBy("claim_key").collect()]
    assert listed(fast.model) == pytest.approx(listed(slow.model))
    M.save_boosted(rows.sparkSession, fast.model, str(tmp_path / "m"))
    again = M.load_boosted(rows.sparkSession, str(tmp_path / "m"))
    assert len(again.rounds) == 4 and listed(again) == listed(fast.model)
    assert listed(again.first(2)) == pytest.approx(listed(slow.model.first(2)))


def test_many_rounds_stop_early_in_one_task(rows):
    fit = M.boost(rows, M.GbtSpec("l2", 0.3, 4, 5, 400), 32, inner="side", patience=12)
    assert M.FEW_TREES < len(fit.inner) < 400 and fit.best == 1 + int(np.argmin(fit.inner))
    assert len(fit.inner) - M.CHUNK < fit.best + 12 <= len(fit.inner) and len(fit.chosen.rounds) == fit.best
    assert len(M.boost(rows, M.GbtSpec("l2", 0.3, 2, 5, 20), 32).model.rounds) == 20


def test_more_rows_than_a_task_takes_are_fitted_by_all_tasks(rows, monkeypatch):
    monkeypatch.setattr(M, "ROWS_IN_TASK", 10)
    monkeypatch.setattr(M, "FEW_TREES", 1)
    fit = M.boost(rows, M.GbtSpec("l2", 0.3, 2, 5, 3), 32)
    assert not isinstance(fit.model, M.BoostedAtOnce) and len(fit.training) == 3


def test_long_models_are_applied_in_parts(rows, monkeypatch):
    model = M.boost(rows, M.GbtSpec("l2", 0.3, 2, 5, 5), 32).model
    whole = [r["payout_hat"] for r in model.predict(rows).orderBy("claim_key").collect()]
    monkeypatch.setattr(M, "APPLIED", 2)
    assert [r["payout_hat"] for r in model.predict(rows).orderBy("claim_key").collect()] == whole


def test_features_counted_together_tell_the_same(rows):
    """Joint codes give every feature's own counts and sums."""
    rng = np.random.default_rng(2)
    x, flag, level = rng.integers(0, 40, 5_000), rng.integers(0, 2, 5_000), rng.integers(0, 5, 5_000)
    cols, sizes = [x, x // 3, flag, level], [40, 14, 2, 5]
    bins = G.Bins([np.arange(39) + 0.5, np.arange(13) + 0.5, np.array([0.5]), None], sizes)
    grower = G.Grower([np.stack(cols).astype(np.uint8)], 5_000, bins)
    assert len(grower.codes) < len(sizes)
    w = rng.normal(size=5_000)
    told = np.bincount(grower.goal, weights=grower.tally(None, w)[grower.source], minlength=sum(sizes))
    assert told == pytest.approx(np.concatenate([np.bincount(c, weights=w, minlength=n) for c, n in zip(cols, sizes)]))


def test_cuts_keep_rare_values_and_all_weight():
    values, weights = G.shortened(np.array([3.0, 1.0, 3.0, 2.0]), np.array([1.0, 1, 4, 1]))
    assert values.tolist() == [1, 2, 3] and weights.tolist() == [1, 1, 5]
    assert G.find_cuts(values, weights, 32).tolist() == [1.5, 2.5]
    many = np.random.default_rng(1).normal(size=20_000)
    v, w = G.shortened(many, np.ones(20_000), 1_000)
    assert len(v) <= 1_000 and w.sum() == 20_000 and v[-1] == many.max()
    cuts = G.find_cuts(v, w, 10)
    assert np.abs(np.searchsorted(np.sort(many), cuts) / 20_000 - np.arange(1, 10) / 10).max() < 0.002


class _Stop(Exception):
    pass


def _asked(monkeypatch, owner, name):
    """What a function is asked for first."""
    asked = {}

    def stop(*args, **kwargs):
        asked.update(kwargs, args=args)
        raise _Stop

    monkeypatch.setattr(owner, name, stop)
    return asked


def _no_data(monkeypatch):
    monkeypatch.setattr(C, "prepared", lambda *a: C.P.Prepared(None, None, M.FeatureSpace(None, [], []), None))
    monkeypatch.setattr(C.P, "assembled_folds", lambda *a, **k: None)
    monkeypatch.setattr(M.FeatureSpace, "max_bins", 32)


def test_cv_oof_does_all_rounds(spark, monkeypatch):
    _no_data(monkeypatch)
    asked = _asked(monkeypatch, C.P, "cross_validation")
    with pytest.raises(_Stop):
        C.cv_oof(spark, "")
    assert [s.trees for _, s in asked["args"][1]] == [2000] * 3 and asked.get("early_stop", True)


def test_gbt_regress_does_all_rounds(spark, monkeypatch):
    _no_data(monkeypatch)
    monkeypatch.setattr(C, "median_baseline", lambda d: d)
    monkeypatch.setattr(C, "regression_metrics", lambda d: spark.range(1))
    asked = _asked(monkeypatch, M, "cross_fits")
    with pytest.raises(_Stop):
        C.gbt_regress(spark, "")
    assert [s.trees for s in asked["args"][1]] == [2000] * 3 and asked["early_stop"]


@pytest.mark.parametrize("query", ["grid_screen", "topk_configs"])
def test_screens_do_all_rounds(spark, monkeypatch, query):
    _no_data(monkeypatch)
    asked = _asked(monkeypatch, C.P, "grid_screen")
    with pytest.raises(_Stop):
        getattr(C, query)(spark, "")
    assert [s.trees for s in asked["args"][1]] == [2000] * 20


@pytest.mark.parametrize("query", ["select_regressor", "holdout_check", "predict_payout", "result_summary", "predictions_table"])
def test_the_choice_does_all_rounds(spark, monkeypatch, query):
    _no_data(monkeypatch)
    asked = _asked(monkeypatch, C.P, "select_regressor")
    with pytest.raises(_Stop):
        getattr(C, query)(spark, "")
    assert [s.trees for s in asked["args"][1]] == [2000] * 20 and asked.get("lo", 100) == 100


def test_predictions_table_chooses_among_whole_forests(spark, monkeypatch):
    _no_data(monkeypatch)
    monkeypatch.setattr(C.P, "select_regressor", lambda *a, **k: None)
    asked = _asked(monkeypatch, C.P, "select_classifier")
    with pytest.raises(_Stop):
        C.predictions_table(spark, "")
    assert asked["trees"] == 300


@pytest.mark.parametrize("query, plan", [("ablation", "ablation"), ("route_compare", "route_comparison")])
def test_given_settings_have_the_frozen_rounds(spark, monkeypatch, query, plan):
    _no_data(monkeypatch)
    asked = _asked(monkeypatch, C.P, plan)
    with pytest.raises(_Stop):
        getattr(C, query)(spark, "")
    assert asked["args"][1].trees == 198


def test_some_features_are_not_binned_again(rows, monkeypatch):
    """Fits of some features on a fold share its binned rows, and are those of a table with these features only."""
    from pyspark.ml.feature import VectorSlicer

    def view(df):
        return VectorSlicer(inputCol="_all", outputCol="features", indices=[0, 2, 4]).transform(df.withColumnRenamed("features", "_all")).drop("_all")

    data = rows.withColumnRenamed("side", "fold")
    parts = [M.Part([0, 2, 4], view), M.Part([0, 1, 2, 3, 4], lambda df: df)]
    spec = M.GbtSpec("l2", 0.3, 3, 10, 4)
    listed = lambda done: [[r["payout_hat"] for r in d.orderBy("claim_key", "payout_hat").collect()] for d, _ in done]
    slow = listed(M.cross_fits(data, [spec] * 2, 32, 2, features=parts))
    monkeypatch.setattr(M, "FEW_TREES", 0)
    calls, write = [], G.binned
    monkeypatch.setattr(G, "binned", lambda *a: calls.append(1) or write(*a))
    fast = listed(M.cross_fits(data, [spec] * 2, 32, 2, features=parts))
    assert len(calls) == 2
    assert fast[0] == pytest.approx(slow[0]) and fast[1] == pytest.approx(slow[1]) and fast[0] != pytest.approx(fast[1])
