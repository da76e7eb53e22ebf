"""Model selection and scoring plans built from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from statistics import median
from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimsieve.functions.expr import half_even
from claimsieve.operators import classify as N
from claimsieve.operators import models as M
from claimsieve.operators import rule as R
from claimsieve.operators.folds import holdout, inner_splits, kfold, stratified_kfold, training_ordinal
from claimsieve.operators.regress import freeze_trees, regression_metrics
from claimsieve.plans.features import FREQUENCY_KEYS, NUMERIC_FEATURES, feature_tables
from claimsieve.plans.score import route_b
from claimsieve.session import materialize
from claimsieve.sources.files import load_config, save_config
from claimsieve.sources.schemas import CATEGORICAL

SPEC_SCHEMA = T.StructType().add("objective", "string").add("learning_rate", "double").add("depth", "integer").add("min_leaf", "integer").add("trees", "integer")


ROW = "_row"  # a number of each written row of history, as keys may repeat


class Prepared(NamedTuple):
    train: DataFrame
    score: DataFrame
    space: M.FeatureSpace
    rule: DataFrame


def prepare(claims: DataFrame, rule: DataFrame | None = None) -> Prepared:
    """Feature tables, category levels, and history labelled by the rule (default: the linear form)."""
    train, target = feature_tables(materialize(claims, "claims"))
    wanted = ["claim_key", *dict.fromkeys([*NUMERIC_FEATURES, *CATEGORICAL])]
    train = materialize(train.select(*wanted, "payout", "excess", F.monotonically_increasing_id().alias(ROW)), "history")
    target = materialize(target.select(*wanted), "scoring")
    rule = materialize(R.linear_rule(train), "rule") if rule is None else rule
    return Prepared(R.apply_rule(train, rule), target, M.fit_features(train, target), rule)


def assembled_folds(prep: Prepared, k: int, stratified: bool = False, inner: bool = False, **features) -> DataFrame:
    """Folds and feature vectors, written once for all fits; ``inner`` adds every fold's split for early stopping.

    Where history has row numbers, only these and what the rows are dealt by are put in order; the features are joined with
    the outcome and move once at most."""
    narrow = [c for c in (ROW, "claim_key", *(["risk_class"] if stratified else [])) if c in prep.train.columns]
    rows = prep.train.select(*narrow) if ROW in narrow else prep.train
    split = stratified_kfold(rows, "risk_class", k=k, ordinal="class_ordinal") if stratified else kfold(rows, k=k)
    if ROW in narrow:
        split = materialize(split, "dealt")
    split = inner_splits(split, k, seed=M.SEED + 1) if inner else split
    if ROW in narrow:
        split = prep.train.join(split.drop("claim_key", "risk_class"), ROW)
    return materialize(prep.space.assemble(split, **features), "folds")


def _spec_columns(spec: M.GbtSpec) -> list:
    return [F.lit(v).alias(n) for n, v in zip(M.GbtSpec._fields, spec)]


def grid_screen(
    prep: Prepared, grid: Sequence[M.GbtSpec], k: int = 5, keep: int = 3, early_stop: bool = True, width: int = M.WIDTH, data: DataFrame | None = None, shared: M.SharedTrees | None = None
) -> DataFrame:
    """Score every configuration on the first fold and keep the best.

    One assembled table, with the inner split of early stopping, serves all fits; a tree that several of them need is grown
    once."""
    shared = shared or M.SharedTrees()
    data = assembled_folds(prep, k, inner=early_stop) if data is None else data
    train, valid = M.inner_side(data, 0).where("fold <> 0") if early_stop else data.where("fold <> 0"), data.where("fold = 0")

    def job(spec: M.GbtSpec):
        def run():
            fit = M.boost(train, spec, prep.space.max_bins, inner=M.INNER if early_stop else None, shared=shared)
            return fit.best, regression_metrics(fit.chosen.predict(valid)).first()

        return run

    done = M.in_parallel([job(s) for s in grid], M.fits_at_once(data, width, grid))
    rows = [(i, *spec, best, row["mae"], row["rmse"]) for i, (spec, (best, row)) in enumerate(zip(grid, done))]
    schema = T.StructType([T.StructField("config", T.IntegerType()), *SPEC_SCHEMA, T.StructField("best_iteration", T.IntegerType()), T.StructField("mae", T.DoubleType()), T.StructField("rmse", T.DoubleType())])
    return topk(prep.train.sparkSession.createDataFrame(rows, schema), "mae", keep)  # a row for each configuration


def topk(scores: DataFrame, score: str, k: int = 3) -> DataFrame:
    """The ``k`` lowest scores, ties by configuration number."""
    return scores.orderBy(score, "config").limit(k)


def cross_validation(
    prep: Prepared,
    configs: Sequence[tuple[int, M.GbtSpec]],
    k: int = 5,
    early_stop: bool = True,
    width: int = M.WIDTH,
    data: DataFrame | None = None,
    shared: dict[int, M.SharedTrees] | None = None,
) -> DataFrame:
    """Fold means and pooled out-of-fold metrics of each configuration, best first."""
    data = assembled_folds(prep, k, inner=early_stop) if data is None else data
    out = None
    for (i, spec), (oof, iterations) in zip(configs, M.cross_fits(data, [s for _, s in configs], prep.space.max_bins, k, early_stop, width, shared=shared)):
        per_fold = regression_metrics(oof, by=["fold"]).agg(
            F.avg("mae").alias("mae_mean"),
            F.stddev_pop("mae").alias("mae_std"),
            F.avg("rmse").alias("rmse_mean"),
            F.avg("mape_ge1").alias("mape_ge1_mean"),
        )
        row = per_fold.withColumn("_o", R.as_scalar(regression_metrics(oof))).select(
            F.lit(i).alias("config"),
            *_spec_columns(spec),
            "mae_mean",
            "mae_std",
            "rmse_mean",
            "mape_ge1_mean",
            *[F.col(f"_o.{m}").alias(f"oof_{m}") for m in ("n", "mae", "rmse", "mape_ge1", "wape")],
            F.lit(float(median(iterations))).alias("best_iteration_median"),
        )
        out = row if out is None else out.unionByName(row)
    return materialize(out, "cv").orderBy("oof_mae", "config")


def holdout_check(prep: Prepared, spec: M.GbtSpec, frac: float = 0.2) -> DataFrame:
    data = materialize(prep.space.assemble(holdout(prep.train, frac=frac).withColumnRenamed("is_holdout", "fold")), "holdout")
    model = M.fit_gbt(data.where("fold = 0"), spec, prep.space.max_bins)
    return regression_metrics(model.predict(data.where("fold = 1")))


def save_spec(spark: SparkSession, spec: M.GbtSpec, path: str) -> None:
    """Write the configuration of a final model, with its frozen number of trees."""
    save_config(spark.createDataFrame([tuple(spec)], SPEC_SCHEMA), path)


def load_spec(spark: SparkSession, path: str) -> M.GbtSpec:
    return M.GbtSpec(*load_config(spark, path, SPEC_SCHEMA).first())


def select_regressor(
    prep: Prepared,
    grid: Sequence[M.GbtSpec],
    folder: str,
    k: int = 5,
    keep: int = 3,
    early_stop: bool = True,
    lo: int = 100,
    hi: int = 2000,
    width: int = M.WIDTH,
) -> DataFrame:
    """Screen the grid, cross-validate the best, freeze the winner's trees, fit it on all of history, and save it.

    ``folder`` gets the configuration (:func:`load_spec`), the category levels and the fitted trees.  Returns the
    cross-validated configurations, best first, with ``chosen`` and ``frozen_trees``.  What comes to the driver is a row of
    scores for each configuration.
    """
    spark = prep.train.sparkSession
    data = assembled_folds(prep, k, inner=early_stop)
    first = M.SharedTrees()  # the finalists' fits on the first fold are those of the screen
    screened = grid_screen(prep, grid, k, keep, early_stop, width, data, first).select("config").collect()
    finalists = [(r["config"], grid[r["config"]]) for r in screened]
    scored = cross_validation(prep, finalists, k, early_stop, width, data, {0: first})
    best = scored.limit(1)
    winner = best.first()["config"]
    trees = freeze_trees(best, "best_iteration_median", lo, hi).first()["n_trees"]
    spec = grid[winner]._replace(trees=trees)
    save_spec(spark, spec, f"{folder}/spec")
    save_space(spark, prep.space, folder)
    train = materialize(prep.space.assemble(prep.train), "train")
    M.save_boosted(spark, M.fit_gbt(train, spec, prep.space.max_bins), f"{folder}/regressor")
    return scored.withColumn("chosen", F.col("config") == winner).withColumn("frozen_trees", F.when(F.col("chosen"), F.lit(trees)))


SPACE_SCHEMA = "numeric array<string>, categorical array<string>"


def save_space(spark: SparkSession, space: M.FeatureSpace, folder: str) -> None:
    space.indexer.write().overwrite().save(f"{folder}/levels")
    save_config(spark.createDataFrame([(space.numeric, space.categorical)], SPACE_SCHEMA), f"{folder}/features")


def load_space(spark: SparkSession, folder: str) -> M.FeatureSpace:
    row = load_config(spark, f"{folder}/features", SPACE_SCHEMA).first()
    return M.FeatureSpace(StringIndexerModel.load(f"{folder}/levels"), row["numeric"], row["categorical"])


class Scheme(NamedTuple):
    name: str
    kind: str
    ratios: tuple[float, float] | None = None
    w: float | None = None


SCHEMES = (
    Scheme("class_weights", "weight"),
    *[Scheme(f"oversample_{a}_{b}", "oversample", (a, b)) for a in (0.5, 1.0) for b in (0.3, 0.5)],
    *[Scheme(f"prior_{w}", "prior", None, w) for w in (0.25, 0.5, 1.0)],
)


def _treated(train: DataFrame, s: Scheme, ordinal: Column | None = None) -> DataFrame:
    """The training rows with a scheme's weights; copies are weights, so no row is repeated."""
    if s.kind == "weight":
        return N.balanced_weights(train)
    if s.kind == "oversample":
        return N.copies(train, {1: s.ratios[0], 2: s.ratios[1]}, name="weight", ordinal=ordinal)
    return train


def _fit_treated(train: DataFrame, max_bins: int, **forest) -> M.ForestModel:
    return M.fit_classifier(train, max_bins, weight="weight" if "weight" in train.columns else None, **forest)


def scheme_predictions(
    prep: Prepared, schemes: Sequence[Scheme] = SCHEMES, k: int = 5, data: DataFrame | None = None, width: int = M.WIDTH, **forest
) -> DataFrame:
    """Out-of-fold predictions of every imbalance scheme on the same folds.

    Treatments touch the training part only and go by the places that the folds were dealt by, so they move no feature
    vector.  The prior corrections share one untreated fit per fold.  Each fit scores its
    fold, the scores are written, and the model is dropped; at most ``width`` models are held at a time.
    """
    data = assembled_folds(prep, k, stratified=True) if data is None else data
    alike: dict[object, list[tuple[int, Scheme]]] = {}
    for i, s in enumerate(schemes):
        alike.setdefault("plain" if s.kind == "prior" else i, []).append((i, s))

    def job(group: list[tuple[int, Scheme]], f: int):
        def run() -> DataFrame:
            train, valid = data.where(F.col("fold") != f), data.where(F.col("fold") == f)
            place = training_ordinal("class_ordinal", f, k) if "class_ordinal" in data.columns else None
            scored = _fit_treated(_treated(train, group[0][1], place), prep.space.max_bins, **forest).predict(valid)
            parts = []
            for i, s in group:
                own = N.prior_correct(scored, N.class_priors(train), s.w) if s.kind == "prior" else scored
                parts.append(own.select(F.lit(i).alias("ordinal"), F.lit(s.name).alias("scheme"), "claim_key", "fold", "risk_class", "predicted"))
            return materialize(reduce(DataFrame.unionByName, parts), "scheme")

        return run

    done = M.in_parallel([job(group, f) for f in range(k) for group in alike.values()], M.fits_at_once(data, width))
    return reduce(DataFrame.unionByName, done)


def route_comparison(prep: Prepared, spec: M.GbtSpec, scheme: Scheme, k: int = 5, width: int = M.WIDTH, **forest) -> DataFrame:
    """Direct classification and regression-then-rule on the same stratified folds."""
    data = assembled_folds(prep, k, stratified=True)
    direct = scheme_predictions(prep, [scheme], k, data, width, **forest)
    oof, _ = M.cross_fit(data, spec, prep.space.max_bins, k, width=width)
    via_rule = route_b(oof, prep.rule).join(data.select("claim_key", "risk_class"), "claim_key")
    return N.compare_routes({"A": direct, "B": via_rule})


SCHEME_SCHEMA = "name string, kind string, ratios array<double>, w double, priors array<double>"


def select_classifier(prep: Prepared, folder: str, schemes: Sequence[Scheme] = SCHEMES, k: int = 5, width: int = M.WIDTH, **forest) -> DataFrame:
    """Compare the schemes on the same folds, fit the best on all of history, and save it with its configuration.

    Returns the schemes' report with ``chosen``."""
    spark = prep.train.sparkSession
    report = materialize(N.scheme_report(scheme_predictions(prep, schemes, k, None, width, **forest)), "report")
    best = schemes[N.best_scheme(report).first()["ordinal"]]
    train = materialize(prep.space.assemble(_treated(prep.train, best)), "train")
    model = _fit_treated(train, prep.space.max_bins, **forest)
    model.model.write().overwrite().save(f"{folder}/classifier/model")
    priors = train.select(N.class_priors(train).alias("p")).first()["p"] if best.kind == "prior" else None
    row = (best.name, best.kind, list(best.ratios) if best.ratios else None, best.w, priors)
    save_config(spark.createDataFrame([row], SCHEME_SCHEMA), f"{folder}/classifier/scheme")
    save_space(spark, prep.space, folder)
    prep.rule.write.mode("overwrite").parquet(f"{folder}/rule")
    return report.withColumn("chosen", F.col("scheme") == best.name)


def predict_payout(spark: SparkSession, folder: str, claims: DataFrame) -> DataFrame:
    """Payouts of new claims (a scoring table of :func:`feature_tables`) by the saved regressor, clamped at 0."""
    scored = M.load_boosted(spark, f"{folder}/regressor").predict(load_space(spark, folder).assemble(claims))
    return scored.select("claim_key", "claim_amount", F.greatest("payout_hat", F.lit(0.0)).alias("payout_hat"))


def predict_class(spark: SparkSession, folder: str, claims: DataFrame, name: str = "route_a") -> DataFrame:
    """Classes of new claims by the saved classifier and its scheme."""
    scheme = load_config(spark, f"{folder}/classifier/scheme", T.StructType.fromDDL(SCHEME_SCHEMA)).first()
    scored = M.ForestModel(RandomForestClassificationModel.load(f"{folder}/classifier/model")).predict(load_space(spark, folder).assemble(claims))
    if scheme["kind"] == "prior":
        priors = F.array(*[F.lit(p).cast("double") for p in scheme["priors"]])
        scored = N.prior_correct(scored, priors, scheme["w"])
    return scored.select("claim_key", F.col("predicted").alias(name))


def prediction_table(spark: SparkSession, folder: str, claims: DataFrame) -> DataFrame:
    """From the saved folder alone, per new claim: payout, direct class (route A), class by the rule (route B), claimed amount."""
    payout = materialize(predict_payout(spark, folder, claims), "payouts")
    by_rule = route_b(payout, spark.read.parquet(f"{folder}/rule"), name="route_b").select("claim_key", "route_b")
    return (
        payout.join(predict_class(spark, folder, claims), "claim_key")
        .join(by_rule, "claim_key")
        .select("claim_key", half_even("payout_hat", 2).alias("payout_hat"), "route_a", "route_b", "claim_amount")
    )


# ---- sensitivity -----------------------------------------------------------------------------------------------


def label_sensitivity(prep: Prepared, pairs: Sequence[tuple[float, float]], k: int = 5, **forest) -> DataFrame:
    """Relabel under other quantile levels, refit the oversampled classifier, report its stability."""
    out = None
    for tau1, tau2 in pairs:
        rule = materialize(R.linear_rule(prep.train, tau1, tau2), "rule")
        relabelled = R.apply_rule(prep.train.drop("risk_class"), rule)
        predictions = scheme_predictions(
            prep._replace(train=relabelled), [Scheme("oversample", "oversample", (0.5, 0.5))], k, **forest
        )
        severe = predictions.agg((F.avg((F.col("risk_class") == 2).cast("int")) * 100).alias("p")).scalar()
        row = N.fold_summary(predictions).select(
            F.lit(tau1).alias("tau1"), F.lit(tau2).alias("tau2"), severe.alias("pct_severe"), "macro_f1_mean", "macro_f1_std"
        )
        out = row if out is None else out.unionByName(row)
    return out


CLAIM_FEATURES = ["claim_amount", "claim_amount_log1p"]
BRANCH_PREFIXES = ("start_volume", "start_accident", "start_claim", "end_volume", "end_accident", "end_claim")

ABLATION_GROUPS = {
    "all": (NUMERIC_FEATURES, CATEGORICAL),
    "no_claim": ([c for c in NUMERIC_FEATURES if not c.startswith("claim_amount")], CATEGORICAL),
    "no_branch": ([c for c in NUMERIC_FEATURES if not c.startswith(BRANCH_PREFIXES)], CATEGORICAL),
    "no_frequency": ([c for c in NUMERIC_FEATURES if c not in {f"{k}_freq" for k in FREQUENCY_KEYS}], CATEGORICAL),
    "claim_only": (CLAIM_FEATURES, []),
}


def ablation(prep: Prepared, spec: M.GbtSpec, groups=None, k: int = 5, width: int = M.WIDTH) -> DataFrame:
    """Mean and deviation of the fold MAE for each feature group.  The table is assembled once; a group is a slice of it."""
    groups = groups or ABLATION_GROUPS
    data = assembled_folds(prep, k)
    parts = [M.Part(M.feature_places(prep.space, n, c), lambda df, n=n, c=c: M.feature_view(df, prep.space, n, c)) for n, c in groups.values()]
    done = M.cross_fits(data, [spec] * len(groups), prep.space.max_bins, k, width=width, features=parts)
    out = None
    for (name, (numeric, categorical)), (oof, _) in zip(groups.items(), done):
        row = regression_metrics(oof, by=["fold"]).agg(
            F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std"), F.sum("n").alias("n")
        )
        row = row.select(F.lit(name).alias("feature_set"), F.lit(len(numeric) + len(categorical)).alias("n_features"), "*")
        out = row if out is None else out.unionByName(row)
    return out
