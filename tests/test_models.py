import json
import pathlib
import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from claimsieve.operators import classify as N
from claimsieve.operators import models as M
from claimsieve.operators.folds import holdout, inner_splits, stratified_kfold, training_ordinal
from claimsieve.operators.regress import median_baseline, regression_metrics
from claimsieve.plans import modelling as P
from claimsieve.sources.claims import order_claims

SPEC = M.GbtSpec("l2", 0.3, 4, 20, 5)


@pytest.fixture(scope="module")
def prep(spark, sf_dir):
    return P.prepare(order_claims(spark, sf_dir))


@pytest.fixture(scope="module")
def data(prep):
    return P.assembled_folds(prep, 2)


def test_feature_space(prep):
    row = prep.space.assemble(prep.score).first()
    assert row.features.size == 42
    sizes = {name: len(num) + len(cat) for name, (num, cat) in P.ABLATION_GROUPS.items()}
    assert sizes == {"all": 42, "no_claim": 39, "no_branch": 28, "no_frequency": 35, "claim_only": 2}
    assert "payout" not in prep.score.columns


def test_full_grid():
    grid = M.full_grid()
    assert len(grid) == len(set(grid)) == 20


def test_cross_fit_predicts_every_key_once_and_beats_the_median(prep, data):
    oof, _ = M.cross_fit(data, SPEC, prep.space.max_bins, 2)
    assert oof.count() == oof.select("claim_key").distinct().count() == data.count()
    base = regression_metrics(median_baseline(data)).first().mae
    assert regression_metrics(oof).first().mae < base


def test_lad_rounds_do_not_raise_the_training_error(prep, data):
    fit = M.boost(data, SPEC._replace(objective="l1"), prep.space.max_bins, chunk=2)
    errors = fit.training
    assert len(errors) == 5 and all(b <= a + 1e-9 for a, b in zip(errors, errors[1:])) and errors[-1] < errors[0]
    again = fit.model.predict(data).agg(F.avg(F.abs(F.col("payout") - F.col("payout_hat")))).first()[0]
    assert again == pytest.approx(errors[-1])


def test_first_lad_rounds_equal_brute_force(spark):
    rng = np.random.default_rng(4)  # seed 3 has two equally good cuts in its third round
    x, y = rng.permutation(60).astype(float), rng.normal(size=60) * 50 + 100
    y += np.where(x > 40, 80, 0)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "claim_key int, x double, payout double")
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    fit = M.boost(df, M.GbtSpec("l1", 0.5, 1, 1, 3), 64)
    now, want = np.full(60, np.median(y)), []
    for _ in range(3):
        sign = np.sign(y - now)
        cuts = np.sort(x)[:-1] + 0.5
        spread = [sign[x <= c].var() * (x <= c).sum() + sign[x > c].var() * (x > c).sum() for c in cuts]
        assert np.diff(np.sort(spread)[:2])[0] > 1e-6  # one best cut
        left = x <= cuts[int(np.argmin(spread))]
        for side in (left, ~left):
            now = np.where(side, now + 0.5 * np.median((y - now)[side]), now)
        want.append(np.abs(y - now).mean())
    assert fit.model.start == pytest.approx(np.median(y)) and fit.training == pytest.approx(want)
    assert [r["payout_hat"] for r in fit.model.predict(df).orderBy("claim_key").collect()] == pytest.approx(now.tolist())


def test_leaf_medians_by_either_way(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), float(v)) for i, v in zip(rng.integers(0, 5, 400) * 2, rng.integers(0, 40, 400))]
    df = spark.createDataFrame(rows, "_leaf int, _residual double")
    want = [float(np.median([v for i, v in rows if i == k])) if k % 2 == 0 else 0.0 for k in range(9)]
    assert M.leaf_medians(df, 9, 400) == want and M.leaf_medians(df, 9, 400, few=0) == pytest.approx(want)


@pytest.mark.parametrize("objective", ["l2", "l1", "log"])
def test_early_stopping_ends_after_its_patience(prep, data, objective):
    train = holdout(data.where("fold <> 0"), seed=1, name="side")
    spec = M.GbtSpec(objective, 1.0, 4, 20, 12)
    whole = M.boost(train, spec, prep.space.max_bins, inner="side", patience=99)
    short = M.boost(train, spec, prep.space.max_bins, inner="side", patience=2, chunk=2)
    assert len(whole.inner) == 12 and whole.best == 1 + int(np.argmin(whole.inner))
    n = len(short.inner)
    assert short.inner == pytest.approx(whole.inner[:n]) and short.best == 1 + int(np.argmin(short.inner))
    assert n == 12 or n < short.best + 2 + 2
    assert len(short.chosen.rounds) == short.best


def test_copies_as_weights_are_the_oversampled_counts(prep):
    rows = prep.train.select("claim_key", "risk_class")
    for ratios in ({1: 0.5, 2: 0.3}, {1: 1.0, 2: 0.5}):
        weighed = {r["risk_class"]: r["n"] for r in N.copies(rows, ratios).groupBy("risk_class").agg(F.sum("copies").alias("n")).collect()}
        grown = {r["risk_class"]: r["count"] for r in N.oversample(rows, ratios).groupBy("risk_class").count().collect()}
        assert weighed == grown


def test_feature_view_keeps_levels_and_values(prep, data):
    numeric, categorical = P.ABLATION_GROUPS["no_branch"]
    view, plain = M.feature_view(data, prep.space, numeric, categorical), prep.space.assemble(prep.train, numeric, categorical)
    both = view.select("claim_key", F.col("features").alias("a")).join(plain.select("claim_key", F.col("features").alias("b")), "claim_key")
    assert both.count() == data.count() and all(list(r.a.toArray()) == list(r.b.toArray()) for r in both.limit(50).collect())
    levels = lambda df: {a["name"]: len(a["vals"]) for a in df.schema["features"].metadata["ml_attr"]["attrs"].get("nominal", [])}
    assert levels(view) == levels(plain) and levels(plain)


def test_classifier_probabilities(prep, data):
    for boosted in (False, True):
        model = M.fit_classifier(data, prep.space.max_bins, trees=3, depth=3, boosted=boosted)
        scored = model.predict(data)
        off = scored.where(F.abs(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9)
        assert off.count() == 0 and scored.count() == data.count()


def test_choice_is_saved_and_follows_the_scores(spark, prep, tmp_path):
    """The lowest error wins wherever it stands in the grid; predictions come from the saved folder and follow it."""
    one, other, winners, sums = SPEC._replace(depth=1, trees=1), SPEC, [], []
    for name, grid in (("a", [one, other]), ("b", [other, one])):
        path = str(tmp_path / name)
        scored = P.select_regressor(prep, grid, path, k=2, keep=2, early_stop=False, lo=2).collect()
        assert [r["chosen"] for r in scored] == [True, False] and scored[0]["oof_mae"] < scored[1]["oof_mae"]
        won = grid[scored[0]["config"]]
        spec = P.load_spec(spark, f"{path}/spec")
        assert spec == won._replace(trees=6 if won == other else 2) and scored[0]["frozen_trees"] == spec.trees
        winners.append(won)
        out = P.predict_payout(spark, path, prep.score)
        assert out.count() == prep.score.count()
        sums.append(out.agg(F.sum("payout_hat")).first()[0])
    assert winners[0] == winners[1] and sums[0] == pytest.approx(sums[1])
    M.save_boosted(spark, M.load_boosted(spark, f"{path}/regressor").first(1), f"{path}/regressor")
    assert P.predict_payout(spark, path, prep.score).agg(F.sum("payout_hat")).first()[0] != pytest.approx(sums[1])


def test_classifier_is_chosen_saved_and_reloaded(spark, prep, tmp_path):
    path = str(tmp_path)
    P.select_regressor(prep, [SPEC._replace(objective="l1", trees=2)], path, k=2, keep=1, early_stop=False, lo=2)
    schemes = [P.SCHEMES[0], P.SCHEMES[1], P.SCHEMES[-1]]
    report = P.select_classifier(prep, path, schemes, k=2, trees=3, depth=4).collect()
    assert len(report) == 3 and sum(r["chosen"] for r in report) == 1
    assert max(report, key=lambda r: (r["macro_f1_mean"], -r["ordinal"]))["chosen"]
    first = {r["claim_key"]: tuple(r) for r in P.prediction_table(spark, path, prep.score).collect()}
    assert len(first) == prep.score.count()
    code = f"""
import json, sys
from claimsieve.session import build_session
from claimsieve.plans import modelling as P
spark = build_session("again", cores=4)
claims = spark.read.parquet({str(tmp_path / "claims")!r})
json.dump([[r["claim_key"], r["payout_hat"], r["route_a"], r["route_b"]] for r in P.prediction_table(spark, {path!r}, claims).collect()], open({str(tmp_path / "out.json")!r}, "w"))
"""
    prep.score.write.parquet(str(tmp_path / "claims"))
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, cwd=pathlib.Path(__file__).parents[1])
    again = {k: (k, *rest) for k, *rest in json.load(open(tmp_path / "out.json"))}
    assert again == {k: v[:4] for k, v in first.items()}
    prior = P.select_classifier(prep, path, [P.SCHEMES[-1]], k=2, trees=3, depth=4).first()
    assert prior["chosen"] and P.predict_class(spark, path, prep.score).count() == len(first)


def test_best_scheme_on_all_schemes(prep):
    """Every scheme scores every claim once, and the choice is the largest mean."""
    predictions = P.scheme_predictions(prep, k=2, trees=2, depth=3)
    assert {r["scheme"]: r["count"] for r in predictions.groupBy("scheme").count().collect()} == {s.name: prep.train.count() for s in P.SCHEMES}
    report = N.scheme_report(predictions).collect()
    best = N.best_scheme(prep.train.sparkSession.createDataFrame(report)).first()
    assert best["macro_f1_mean"] == max(r["macro_f1_mean"] for r in report)


def _rows(spark, n=600):
    return spark.range(n).selectExpr("id as claim_key", "cast(case when id % 10 = 0 then 2 when id % 10 < 3 then 1 else 0 end as int) as risk_class")


def test_copies_by_the_places_of_the_folds(spark):
    """The places that the folds were dealt by give every fold's copies without ranking its training part again."""
    data = stratified_kfold(_rows(spark), "risk_class", k=5, ordinal="class_ordinal")
    for f in range(5):
        train = data.where(F.col("fold") != f)
        told = N.copies(train, {1: 0.5, 2: 0.3}, ordinal=training_ordinal("class_ordinal", f, 5))
        want = {(r["claim_key"], r["copies"]) for r in N.copies(train, {1: 0.5, 2: 0.3}).collect()}
        assert {(r["claim_key"], r["copies"]) for r in told.collect()} == want and len({c for _, c in want}) > 1


def test_inner_splits_are_the_holdouts_of_all_folds(spark):
    data = stratified_kfold(_rows(spark, 403), "risk_class", k=3).cache()
    got = {r["claim_key"]: r["inner_folds"] for r in inner_splits(data, 3, seed=9).collect()}
    for f in range(3):
        want = {r["claim_key"]: r["side"] for r in holdout(data.where(F.col("fold") != f), seed=9, name="side").collect()}
        assert {k: got[k][f] for k in want} == want and not any(v[f] for k, v in got.items() if k not in want)
    data.unpersist()


def test_boosting_writes_its_rows_only_where_many_rounds_follow(prep, data, monkeypatch):
    written = []
    write = M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, label="step": written.append(label) or write(df, label))
    M.boost(data, SPEC, prep.space.max_bins)
    assert written == []
    monkeypatch.setattr(M, "WRITTEN", 2)
    twice = M.boost(data, SPEC, prep.space.max_bins, chunk=1)
    assert written == ["rounds", "rounds"]
    again = twice.model.predict(data).agg(F.avg(F.pow(F.col("payout") - F.col("payout_hat"), F.lit(2)))).first()[0]
    assert again == pytest.approx(twice.training[-1])


def test_fits_beside_each_other_fit_in_memory(spark):
    assert M.fits_at_once(spark.range(1000)) == M.WIDTH
    assert M.fits_at_once(spark.range(4_000_000)) == 4 and M.fits_at_once(spark.range(40_000_000)) == 1


def test_medians_beside_the_sketch(spark):
    """Values around a median come from the sketch; the counted ones between them give it exactly."""
    rng = np.random.default_rng(1)
    rows = [(int(i), float(v)) for i, v in zip(rng.integers(0, 3, 30_001), np.round(rng.normal(size=30_001), 3))]
    df = spark.createDataFrame([*rows, (0, None), (1, float("nan"))], "_leaf int, _residual double")
    want = [float(np.median([v for i, v in rows if i == k])) for k in range(3)]
    assert M.leaf_medians(df, 4, 30_003, few=0) == pytest.approx([*want, 0.0])
    assert M._median([(1.0, 2)], 9, 0) is None and M._median([(1.0, 2), (2.0, 1)], 4, 1) == 1.0


def test_equal_trees_are_grown_once_and_finalists_are_not_fitted_again(prep, monkeypatch):
    data = P.assembled_folds(prep, 2, inner=True)
    grid = [M.GbtSpec("l1", rate, 3, 20, 2) for rate in (0.1, 0.3)]
    alone = [M.boost(M.inner_side(data, 0).where("fold <> 0"), s, prep.space.max_bins, inner=M.INNER) for s in grid]
    fit, grown = M.DecisionTreeRegressor.fit, []
    monkeypatch.setattr(M.DecisionTreeRegressor, "fit", lambda *a: grown.append(1) or fit(*a))
    first = M.SharedTrees()
    screened = P.grid_screen(prep, grid, 2, 2, data=data, shared=first).collect()
    assert len(grown) == 3  # the first tree of both rates is the same
    assert {r["config"]: r["best_iteration"] for r in screened} == {i: f.best for i, f in enumerate(alone)}
    maes = {r["config"]: r["mae"] for r in screened}
    for i, f in enumerate(alone):
        assert maes[i] == pytest.approx(regression_metrics(f.chosen.predict(data.where("fold = 0"))).first().mae)
    P.cross_validation(prep, list(enumerate(grid)), 2, data=data, shared={0: first}).collect()
    assert len(grown) == 6  # three more on the second fold, none on the first


def test_features_are_not_moved_to_deal_folds(prep, monkeypatch):
    from claimsieve.operators.folds import kfold

    moved = []
    for name in ("kfold", "stratified_kfold", "inner_splits"):
        monkeypatch.setattr(P, name, lambda df, *a, _f=getattr(P, name), **k: moved.append(df.columns) or _f(df, *a, **k))
    repeated = prep._replace(train=prep.train.union(prep.train.limit(5).withColumn(P.ROW, -1 - F.col(P.ROW))))  # keys may repeat
    plain = inner_splits(kfold(prep.train.select("claim_key"), k=3), 3, seed=M.SEED + 1)
    dealt = P.assembled_folds(prep, 3, inner=True).select("claim_key", "fold", "inner_folds")
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))
    again = P.assembled_folds(repeated, 3, stratified=True)
    assert again.count() == prep.train.count() + 5
    assert moved and all("claim_amount" not in columns for columns in moved)
