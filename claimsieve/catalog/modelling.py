"""Queries that fit models: all configurations, schemes, folds and rounds; forests alone have fewer trees, except that of ``predictions_table``."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimsieve.catalog.common import round_doubles
from claimsieve.catalog.registry import register
from claimsieve.catalog.sqltext import SCORE, with_claims
from claimsieve.operators import classify as N
from claimsieve.operators import models as M
from claimsieve.operators.regress import median_baseline, regression_metrics
from claimsieve.operators.report import prediction_summary
from claimsieve.plans import modelling as P
from claimsieve.session import scratch_path
from claimsieve.sources.claims import order_claims

TREES = 2000  # rounds at most, ended by early stopping
FROZEN = 198  # rounds of a fit with settings that are given
SPEC = M.GbtSpec("l1", 0.1, 5, 20, FROZEN)
FOREST = {"trees": 5, "depth": 6}
FULL_FOREST = {"trees": 300, "depth": 6}
FOLDS = 5
_saved: dict[tuple[str, str], dict] = {}  # by application and data: the folder of chosen models and what is in it


def prepared(spark, sf_dir) -> P.Prepared:
    return P.prepare(order_claims(spark, sf_dir))


def choose(spark, sf_dir, part, prep=None, forest=FULL_FOREST):
    """Choose a regressor or a classifier on this data and save it, once in an application: ``(folder, scores)``.

    A classifier of another ``forest`` than the full one lies in a folder of its own."""
    held = _saved.setdefault((spark.sparkContext.applicationId, sf_dir), {"folder": scratch_path(spark, "models")})
    folder = held["folder"] if forest == FULL_FOREST else f"{held['folder']}-{forest['trees']}"
    if (part, folder) not in held:
        prep = prep or prepared(spark, sf_dir)
        if part == "regressor":
            held[part, folder] = P.select_regressor(prep, M.full_grid(TREES), folder, FOLDS)
        else:
            held[part, folder] = P.select_classifier(prep, folder, k=FOLDS, **forest)
    return folder, held[part, folder]


@register(
    "assemble_features",
    with_claims("select claim_key, 42::int as n_features from hist union all select claim_key, 42::int from score", SCORE),
)
def assemble_features(spark, sf_dir):
    prep = prepared(spark, sf_dir)
    both = prep.space.assemble(prep.train).select("claim_key", "features").unionByName(
        prep.space.assemble(prep.score).select("claim_key", "features")
    )
    return both.select("claim_key", F.size(M.vector_to_array("features")).alias("n_features"))


@register("gbt_regress")
def gbt_regress(spark, sf_dir):
    """Out-of-fold errors of the three objectives, stopped early, and the median baseline."""
    prep = prepared(spark, sf_dir)
    data = P.assembled_folds(prep, FOLDS, inner=True)
    out = regression_metrics(median_baseline(data)).withColumn("objective", F.lit("median"))
    specs = [SPEC._replace(objective=o, trees=TREES) for o in ("l2", "log", "l1")]
    for spec, (oof, _) in zip(specs, M.cross_fits(data, specs, prep.space.max_bins, FOLDS, early_stop=True)):
        out = out.unionByName(regression_metrics(oof).withColumn("objective", F.lit(spec.objective)))
    return round_doubles(out)


@register("lad_boost")
def lad_boost(spark, sf_dir):
    """Training error of every round, and the error on the fold that was left out."""
    prep = prepared(spark, sf_dir)
    data = P.assembled_folds(prep, FOLDS)
    fit = M.boost(data.where("fold <> 0"), SPEC._replace(trees=8), prep.space.max_bins)
    rounds = F.array(*[F.lit(m) for m in fit.training])
    scored = regression_metrics(fit.model.predict(data.where("fold = 0"))).select("n", "mae")
    return round_doubles(scored.select(F.posexplode(rounds).alias("round", "training_mae"), F.col("n"), F.col("mae").alias("final_mae")))


@register("early_stop")
def early_stop(spark, sf_dir):
    """Best round of each objective on the inner split of the training part, with the errors around it."""
    prep = prepared(spark, sf_dir)
    train = M.inner_split(P.assembled_folds(prep, FOLDS).where("fold <> 0"))
    specs = [SPEC._replace(objective=o, learning_rate=0.5, trees=8) for o in ("l2", "log", "l1")]
    fits = M.in_parallel([lambda s=s: M.early_stopped(train, s, prep.space.max_bins, patience=4, chunk=2) for s in specs], M.fits_at_once(train))
    rows = [(s.objective, f.best, len(f.inner), f.inner[0], f.inner[f.best - 1]) for s, f in zip(specs, fits)]
    return round_doubles(spark.createDataFrame(rows, "objective string, best_iteration int, rounds int, first_error double, best_error double"))


@register("grid_screen")
def grid_screen(spark, sf_dir):
    """All 20 configurations with early stopping, the best three kept."""
    return round_doubles(P.grid_screen(prepared(spark, sf_dir), M.full_grid(TREES), FOLDS))


@register("topk_configs")
def topk_configs(spark, sf_dir):
    """The best three of all 20 configurations."""
    screened = P.grid_screen(prepared(spark, sf_dir), M.full_grid(TREES), FOLDS, keep=20)
    return round_doubles(P.topk(screened, "mae", 3).select("config", "objective", "depth", "mae"))


@register("cv_oof")
def cv_oof(spark, sf_dir):
    """The three objectives over five folds, each with early stopping."""
    configs = [(i, SPEC._replace(objective=o, trees=TREES)) for i, o in enumerate(("l2", "log", "l1"))]
    return round_doubles(P.cross_validation(prepared(spark, sf_dir), configs, FOLDS))


@register("holdout_check")
def holdout_check(spark, sf_dir):
    """The chosen configuration, fitted without the holdout and scored on it."""
    prep = prepared(spark, sf_dir)
    return round_doubles(P.holdout_check(prep, P.load_spec(spark, f"{choose(spark, sf_dir, 'regressor', prep)[0]}/spec")))


@register("select_regressor")
def select_regressor(spark, sf_dir):
    """Full screen, cross-validation of the best three, choice and frozen trees; the fitted model is saved."""
    return round_doubles(choose(spark, sf_dir, "regressor")[1])


@register("select_classifier")
def select_classifier(spark, sf_dir):
    """All schemes over five folds; the best one, fitted on all of history, is saved with its configuration."""
    return round_doubles(choose(spark, sf_dir, "classifier", forest=FOREST)[1])


@register("predict_payout")
def predict_payout(spark, sf_dir):
    """Payouts of new claims from the saved model."""
    prep = prepared(spark, sf_dir)
    return round_doubles(P.predict_payout(spark, choose(spark, sf_dir, "regressor", prep)[0], prep.score))


@register("classify")
def classify(spark, sf_dir):
    prep = prepared(spark, sf_dir)
    data = P.assembled_folds(prep, FOLDS, stratified=True)

    def job(boosted, f):
        def run():
            settings = {"trees": 6, "depth": 4, "learning_rate": 0.3} if boosted else FOREST
            model = M.fit_classifier(data.where(F.col("fold") != f), prep.space.max_bins, boosted=boosted, **settings)
            return P.materialize(model.predict(data.where(F.col("fold") == f)).select("claim_key", "risk_class", "predicted"), "classes")

        return run

    out = None
    for name, boosted in (("forest", False), ("boosted", True)):
        parts = M.in_parallel([job(boosted, f) for f in range(FOLDS)], M.fits_at_once(data))
        row = N.class_metrics(P.reduce(P.DataFrame.unionByName, parts)).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return round_doubles(out)


@register("imbalance_schemes")
def imbalance_schemes(spark, sf_dir):
    return round_doubles(N.scheme_report(P.scheme_predictions(prepared(spark, sf_dir), k=FOLDS, **FOREST)))


@register("best_scheme")
def best_scheme(spark, sf_dir):
    predictions = P.scheme_predictions(prepared(spark, sf_dir), **FOREST)
    return round_doubles(N.best_scheme(N.scheme_report(predictions)))


@register("route_compare")
def route_compare(spark, sf_dir):
    return round_doubles(P.route_comparison(prepared(spark, sf_dir), SPEC, P.SCHEMES[2], FOLDS, **FOREST))


@register("predictions_table")
def predictions_table(spark, sf_dir):
    """From the saved choice alone."""
    prep = prepared(spark, sf_dir)
    choose(spark, sf_dir, "regressor", prep)
    return P.prediction_table(spark, choose(spark, sf_dir, "classifier", prep)[0], prep.score)


@register("result_summary")
def result_summary(spark, sf_dir):
    """Counts and quartiles of the payouts that the chosen model predicts."""
    prep = prepared(spark, sf_dir)
    scored = P.materialize(P.predict_payout(spark, choose(spark, sf_dir, "regressor", prep)[0], prep.score), "payouts")
    return round_doubles(prediction_summary(scored))


@register("label_sensitivity")
def label_sensitivity(spark, sf_dir):
    pairs = [(0.86, 0.98), (0.85, 0.97), (0.88, 0.98)]
    return round_doubles(P.label_sensitivity(prepared(spark, sf_dir), pairs, FOLDS, **FOREST))


@register("ablation")
def ablation(spark, sf_dir):
    return round_doubles(P.ablation(prepared(spark, sf_dir), SPEC, k=FOLDS))
