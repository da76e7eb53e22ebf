"""Tree models on Spark ML: features, boosted regression (three objectives, resumable, early stopping), classification.

Loops here run on the driver over Spark ML fits; every fit is a distributed job over the claims.  What comes back to
the driver is bounded by the model: leaves, error curves and metric rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import accumulate
from threading import Lock
from typing import NamedTuple

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsieve.functions.expr import argmax
from claimsieve.operators import grow as G
from claimsieve.operators.order import exact_quantiles
from claimsieve.operators.folds import SEED, holdout
from claimsieve.plans.features import NUMERIC_FEATURES
from claimsieve.session import materialize, release_group, step_group
from claimsieve.sources.files import load_config, save_config
from claimsieve.sources.schemas import CATEGORICAL

INNER = "_inner_side"
PLACES = ["class_ordinal", "inner_folds"]  # of the folds, used by fits only
KEPT = ["claim_key", "claim_amount", "payout", "excess", "risk_class", "fold", "weight", *PLACES]


# ---- features --------------------------------------------------------------------------------------------------


class FeatureSpace(NamedTuple):
    """Category levels over both tables, so that training and scoring share their codes."""

    indexer: StringIndexerModel
    numeric: list[str]
    categorical: list[str]

    @property
    def max_bins(self) -> int:
        return max([32, *[len(levels) + 1 for levels in self.indexer.labelsArray]])

    def assemble(
        self, df: DataFrame, numeric: Sequence[str] | None = None, categorical: Sequence[str] | None = None
    ) -> DataFrame:
        """Feature vector of all or some features next to the key, targets and split columns that are present."""
        numeric = self.numeric if numeric is None else list(numeric)
        categorical = self.categorical if categorical is None else list(categorical)
        inputs = [*numeric, *[f"{c}_code" for c in categorical]]
        coded = self.indexer.transform(df)
        assembler = VectorAssembler(inputCols=inputs, outputCol="features")
        return assembler.transform(coded).select(*[c for c in KEPT if c in df.columns], "features")


def feature_places(space: FeatureSpace, numeric: Sequence[str], categorical: Sequence[str]) -> list[int]:
    """Where features stand in the vector."""
    return [*[space.numeric.index(c) for c in numeric], *[len(space.numeric) + space.categorical.index(c) for c in categorical]]


def feature_view(df: DataFrame, space: FeatureSpace, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """An assembled table with some of its features, category levels included, without assembling it again."""
    slicer = VectorSlicer(inputCol="_all", outputCol="features", indices=feature_places(space, numeric, categorical))
    return slicer.transform(df.withColumnRenamed("features", "_all")).drop("_all")


def fit_features(
    train: DataFrame,
    score: DataFrame | None = None,
    numeric: Sequence[str] = tuple(NUMERIC_FEATURES),
    categorical: Sequence[str] = tuple(CATEGORICAL),
) -> FeatureSpace:
    cats = list(categorical)
    both = train.select(*cats) if score is None else train.select(*cats).unionByName(score.select(*cats))
    indexer = StringIndexer(
        inputCols=cats, outputCols=[f"{c}_code" for c in cats], handleInvalid="keep", stringOrderType="alphabetAsc"
    )
    return FeatureSpace(indexer.fit(both), list(numeric), cats)


# ---- regression ------------------------------------------------------------------------------------------------


class GbtSpec(NamedTuple):
    """Objective ``l2``, ``l1`` or ``log`` (squared error on log1p); depth 5 and 6 stand for 31 and 63 leaves."""

    objective: str = "l2"
    learning_rate: float = 0.1
    depth: int = 5
    min_leaf: int = 20
    trees: int = 20


def full_grid(trees: int = 2000) -> list[GbtSpec]:
    """The 20 configurations of the screen."""
    grid = [
        GbtSpec(obj, lr, depth, leaf, trees)
        for obj in ("l2", "l1")
        for lr in (0.05, 0.1)
        for depth in (5, 6)
        for leaf in (20, 50)
    ]
    return grid + [GbtSpec("log", lr, depth, 20, trees) for lr in (0.05, 0.1) for depth in (5, 6)]


PATIENCE = 100
CHUNK = 4
WRITTEN = 8
FEW_ROWS = 100_000
WIDTH = 8
ROWS_AT_ONCE = 16_000_000  # a row in the trainer's memory takes about 300 bytes
FEW_TREES = 16  # up to these, binning the rows first costs more than it saves
ROWS_IN_TASK = 8_000_000  # of a fit whose rounds run in one task; a binned row takes about 100 bytes
TASK_ROWS_AT_ONCE = 40_000_000
APPLIED = 32  # trees applied in one plan


def fits_at_once(data: DataFrame, width: int = WIDTH, specs: Sequence[GbtSpec] = ()) -> int:
    """How many fits over a written table run beside each other: up to ``width`` on a small one.

    Every fit holds its rows in the executors' memory while it grows trees.  A large table keeps all cores busy alone, and
    further fits beside it would only push each other's rows to disk.  Fits that run in one task each (``specs`` of many trees,
    :func:`boost`) need less memory, and a core each."""
    rows = data.count()
    alone = bool(specs) and rows <= ROWS_IN_TASK and min(s.trees for s in specs) > FEW_TREES
    return max(1, min(width, (TASK_ROWS_AT_ONCE if alone else ROWS_AT_ONCE) // max(1, rows)))


def in_parallel(jobs: Sequence[Callable[[], object]], width: int = WIDTH, pool: str = "models") -> list:
    """Results of driver-side jobs (fits over tables that are written already), at most ``width`` at a time.

    Their Spark jobs share the executors; with the fair scheduler they do so in the named pool."""

    def run(job):
        SparkContext._active_spark_context.setLocalProperty("spark.scheduler.pool", pool)
        return job()

    with ThreadPoolExecutor(max(1, min(width, len(jobs)))) as threads:
        return [f.result() for f in [threads.submit(inheritable_thread_target(SparkSession.active())(run), job) for job in jobs]]


class Part(NamedTuple):
    """Some features of an assembled table: their ascending places among all, and the table with these only."""

    columns: Sequence[int]
    view: Callable[[DataFrame], DataFrame]


class Boosted:
    """A start value plus the trees' steps.  A tree's step is its own value or, for ``l1``, its leaf's median residual;
    the log objective is mapped back with ``expm1``."""

    def __init__(self, objective: str, learning_rate: float, start: float, rounds: list[tuple[object, list[float] | None]] | None = None):
        self.objective, self.learning_rate, self.start = objective, learning_rate, start
        self.rounds = rounds or []

    def first(self, n: int) -> Boosted:
        return Boosted(self.objective, self.learning_rate, self.start, self.rounds[:n])

    def step(self, df: DataFrame, tree, medians: list[float] | None, old: str, new: str) -> DataFrame:
        value = F.col("_p") if medians is None else F.get(F.array(*[F.lit(m) for m in medians]), F.col("_leaf").cast("int"))
        return tree.transform(df).withColumn(new, F.col(old) + self.learning_rate * value).drop("_leaf", "_p")

    def predict(self, df: DataFrame, name: str = "payout_hat") -> DataFrame:
        out = df.withColumn(name, F.lit(self.start))
        for i, (tree, medians) in enumerate(self.rounds):
            if i and i % APPLIED == 0:
                out = materialize(out, "applied")
            out = self.step(out, tree, medians, name, name)
        return out.withColumn(name, F.expm1(name)) if self.objective == "log" else out

    def save(self, spark: SparkSession, folder: str) -> None:
        PipelineModel([tree for tree, _ in self.rounds]).write().overwrite().save(folder)


class BoostedAtOnce(Boosted):
    """A model whose trees are applied in one step, as an ensemble of Spark ML.  A leaf holds its step, medians included."""

    def __init__(self, objective: str, learning_rate: float, start: float, rounds: list[list[tuple]], sizes: Sequence[int | None]):
        super().__init__(objective, learning_rate, start, rounds)
        self.sizes = sizes

    def first(self, n: int) -> BoostedAtOnce:
        return BoostedAtOnce(self.objective, self.learning_rate, self.start, self.rounds[:n], self.sizes)

    def predict(self, df: DataFrame, name: str = "payout_hat") -> DataFrame:
        if not self.rounds:
            return super().predict(df, name)
        model = G.ensemble(df.sparkSession, self.rounds, self.sizes, self.learning_rate)
        total = F.lit(self.start) + F.col("_p")
        return model.transform(df).withColumn(name, F.expm1(total) if self.objective == "log" else total).drop("_p")

    def save(self, spark: SparkSession, folder: str) -> None:
        G.write_ensemble(spark, self.rounds, self.sizes, self.learning_rate, folder)


def leaf_medians(placed: DataFrame, leaves: int, rows: int, few: int = FEW_ROWS) -> list[float]:
    """Exact median of ``_residual`` by ``_leaf``.  Up to ``few`` rows come to the driver as counted values.

    Beyond that a sketch, merged before it moves, gives two values around each median, and one pass counts the rows
    below them and the few values between them; no row is shuffled.  Should the two not enclose a median, the
    distributed order statistics find it, so a leaf can hold any number of rows."""
    out = [0.0] * leaves
    if rows > few:
        accuracy = max(10_000, rows // 5_000)  # a rank errs by n / accuracy at most, so up to 6 * 5,000 values come back
        numbers = placed.where(F.col("_residual").isNotNull() & ~F.isnan("_residual"))
        around = F.percentile_approx("_residual", [0.5 - 2 / accuracy, 0.5 + 2 / accuracy], accuracy)
        held = {int(r["_leaf"]): r for r in numbers.groupBy("_leaf").agg(around.alias("q"), F.count(F.lit(1)).alias("n")).collect()}
        low, high = (F.get(F.array(*[F.lit(held[i]["q"][e] if i in held else None).cast("double") for i in range(leaves)]), F.col("_leaf").cast("int")) for e in (0, 1))
        near = numbers.where(F.col("_residual") <= high).groupBy("_leaf", F.when(F.col("_residual") >= low, F.col("_residual")).alias("v")).count().collect()
        below = {int(r["_leaf"]): r["count"] for r in near if r["v"] is None}
        inside = _counted((r["_leaf"], r["v"], r["count"]) for r in near if r["v"] is not None)
        found = {i: _median(inside.get(i, []), r["n"], below.get(i, 0)) for i, r in held.items()}
        if None in found.values():
            found = {int(r["_leaf"]): r["q"] for r in exact_quantiles(placed, "_residual", [0.5], ["_leaf"]).collect()}  # at most 2 ** depth leaves
    else:
        counted = _counted(placed.groupBy("_leaf", "_residual").count().collect())  # bounded by few
        found = {i: _median(values, sum(n for _, n in values), 0) for i, values in counted.items()}
    for i, median in found.items():
        out[i] = median
    return out


def _counted(rows: Iterable[tuple[float, float, int]]) -> dict[int, list[tuple[float, int]]]:
    """Counted values by leaf, ascending."""
    out: dict[int, list[tuple[float, int]]] = {}
    for leaf, value, n in rows:
        out.setdefault(int(leaf), []).append((value, n))
    return {i: sorted(values) for i, values in out.items()}


def _median(values: list[tuple[float, int]], n: int, below: int) -> float | None:
    """Median of ``n`` numbers of which ``below`` are smaller than the counted ``values``; none if it isn't among those."""
    ends = list(accumulate(c for _, c in values))
    ranks = [(n - 1) // 2 - below, n // 2 - below]
    if not ends or ranks[0] < 0 or ranks[1] >= ends[-1]:
        return None
    low, high = (values[bisect_right(ends, rank)][0] for rank in ranks)
    return low + (high - low) / 2


class Fit(NamedTuple):
    """A boosted model, its mean training and inner error after each round, and the round with the least inner error."""

    model: Boosted
    training: list[float]
    inner: list[float]
    best: int

    @property
    def chosen(self) -> Boosted:
        return self.model.first(self.best)


class SharedTrees:
    """What several fits over the same rows and features have in common, worked out once.

    A tree follows from the objective, the depth, the least rows of a leaf, and the running prediction that it corrects.  So
    fits that differ in their learning rate start with the same tree, and the same fit asked for again costs its errors only.
    """

    def __init__(self):
        self.held, self.lock = {}, Lock()

    def get(self, key: tuple, find: Callable[[], tuple]) -> tuple:
        """What is held under ``key``; ``find`` is called for the first who asks, and others wait for it."""
        with self.lock:
            own, found = self.held.setdefault(key, (Lock(), []))
        with own:
            if not found:
                found.append(find())
            return found[0]

    def tree(self, spec: GbtSpec, before: Sequence[tuple], grow: Callable[[], tuple]) -> tuple:
        """The tree that follows the rounds ``before``, with its leaves' medians."""
        return self.get((spec.objective, spec.depth, spec.min_leaf, spec.learning_rate if before else None, *map(id, before)), grow)


def boost(
    data: DataFrame, spec: GbtSpec, max_bins: int, y: str = "payout", seed: int = SEED, inner: str | None = None, patience: int = PATIENCE, chunk: int = CHUNK, shared: SharedTrees | None = None, part: Part | None = None
) -> Fit:
    """Boosting from the mean (``l1``: the median), a tree on the residual (``l1``: its sign) per round.

    ``data`` is a written table, or a filter or view of one: every pass reads it again.  Rows where the column ``inner`` is 1
    are not learned from; their error is that of early stopping, looked at every ``chunk`` rounds: no round is added once
    ``patience`` rounds have passed since the best.  Few trees are cheaper to apply again than their rows are to write;
    so the running prediction is written to the shared folder only where more rounds follow ``WRITTEN`` of them, in place
    of the one written before.  ``shared`` holds the trees of fits over the same ``data``, with the same arguments but ``spec``.

    Beyond ``FEW_TREES`` rounds, the rows are binned and written once for all fits over them, and a fit of up to
    ``ROWS_IN_TASK`` rows runs all its rounds in one task (:mod:`claimsieve.operators.grow`).  A ``part`` of the features needs no
    binning of its own; such a model is applied by :func:`predict_part`.
    """
    spark = data.sparkSession
    l1 = spec.objective == "l1"
    target = F.log1p(y) if spec.objective == "log" else F.col(y).cast("double")
    if spec.trees > FEW_TREES:
        with step_group("binned") as group:
            found = _boost_in_task(data, spec, max_bins, y, inner, patience, chunk, shared or SharedTrees(), part)
        if shared is None:
            release_group(spark, group)
        if found:
            return found
    data, shared = (part.view(data), SharedTrees()) if part else (data, shared or SharedTrees())
    grower = DecisionTreeRegressor(
        featuresCol="features", labelCol="_r", predictionCol="_p", maxDepth=spec.depth, minInstancesPerNode=spec.min_leaf, maxBins=max_bins, seed=seed
    )
    if l1:
        grower = grower.setLeafCol("_leaf")

    def grow(rows: DataFrame, running: str):
        residual = F.col("_y") - F.col(running)
        tree = grower.fit(rows.withColumn("_r", F.signum(residual) if l1 else residual))
        if not l1:
            return tree, None
        return tree, leaf_medians(tree.transform(rows).select("_leaf", residual.alias("_residual")), tree.numNodes, size)

    def begin() -> tuple[float, int]:
        mean, n = learned.agg(F.avg("_y"), F.count("_y")).first()
        return leaf_medians(learned.select(F.lit(0).alias("_leaf"), F.col("_y").alias("_residual")), 1, n)[0] if l1 else mean or 0.0, n

    with step_group("boost") as group:
        side = F.col(inner).cast("int") if inner else F.lit(0)
        state = data.select("features", target.alias("_y"), side.alias("_inner"))
        learned = state.where("_inner = 0")
        start, size = shared.get((spec.objective,), begin)
        model = Boosted(spec.objective, spec.learning_rate, float(start))
        state = state.withColumn("_f", F.lit(model.start))
        training, held, best, kept, since = [], [], spec.trees, None, 0
        while len(model.rounds) < spec.trees:
            todo = min(chunk, spec.trees - len(model.rounds))
            now = state.withColumnRenamed("_f", "_f0")
            for i in range(todo):
                model.rounds.append(shared.tree(spec, model.rounds, lambda: grow(now.where("_inner = 0"), f"_f{i}")))
                now = model.step(now, *model.rounds[-1], f"_f{i}", f"_f{i + 1}")
            names = [f"_f{i + 1}" for i in range(todo)]
            def error(name: str, part: int) -> Column:
                gap = F.abs(F.col("_y") - F.col(name))
                return F.avg(F.when(F.col("_inner") == part, gap if l1 else gap * gap))

            row = now.agg(*[error(n, part).alias(f"{n}_{part}") for n in names for part in (0, 1)]).first()
            training += [row[f"{n}_0"] for n in names]
            held += [row[f"{n}_1"] for n in names]
            state, since = now.select("features", "_y", "_inner", F.col(names[-1]).alias("_f")), since + todo
            if inner and row[f"{names[0]}_1"] is not None:
                best = 1 + min(range(len(held)), key=lambda i: held[i])
                if len(held) - best >= patience:
                    break
            if since >= WRITTEN and len(model.rounds) < spec.trees:
                with step_group("rounds") as own:
                    state, since = materialize(state, "rounds"), 0
                if kept:
                    release_group(spark, kept)
                kept = own
        release_group(spark, group)
    return Fit(model, training, held, min(best, len(model.rounds)))


def predict_part(model: Boosted, df: DataFrame, part: Part | None) -> DataFrame:
    """Predictions of a model of some features: an ensemble knows them by their place among all, single trees by that in the view."""
    return model.predict(df if part is None or isinstance(model, BoostedAtOnce) else part.view(df))


def _boost_in_task(data: DataFrame, spec: GbtSpec, max_bins: int, y: str, inner: str | None, patience: int, chunk: int, shared: SharedTrees, part: Part | None) -> Fit | None:
    """:func:`boost` in one task; none if the rows are too many or none."""
    side = F.col(inner).cast("int") if inner else F.lit(0)
    rows = data.select("features", F.col(y).cast("double").alias("_y"), side.alias("_inner"))
    if not 0 < shared.get(("rows",), lambda: (rows.count(),))[0] <= ROWS_IN_TASK:
        return None
    table, bins = shared.get(("binned", max_bins), lambda: G.binned(rows, max_bins))
    table = table.withColumn("y", F.log1p("y")) if spec.objective == "log" else table
    settings = {"objective": spec.objective, "learning_rate": spec.learning_rate, "depth": spec.depth, "min_leaf": spec.min_leaf, "trees": spec.trees}

    def run() -> Fit:
        start, rounds, training, held = G.fit(table, bins, inner is not None, part.columns if part else None, patience=patience, chunk=chunk, **settings)
        best = 1 + min(range(len(held)), key=lambda i: held[i]) if inner and held[0] is not None else spec.trees
        sizes = [n if c is None else None for c, n in zip(*bins)]
        model = BoostedAtOnce(spec.objective, spec.learning_rate, float(start), rounds, sizes)
        return Fit(model, training, held, min(best, len(rounds)))

    return shared.get((spec, patience, chunk, part and tuple(part.columns)), run)


def fit_gbt(train: DataFrame, spec: GbtSpec, max_bins: int, y: str = "payout", seed: int = SEED) -> Boosted:
    """Fit one configuration with all its trees."""
    return boost(train, spec, max_bins, y, seed).model


def early_stopped(
    train: DataFrame, spec: GbtSpec, max_bins: int, y: str = "payout", seed: int = SEED, patience: int = PATIENCE, chunk: int = CHUNK, shared: SharedTrees | None = None, part: Part | None = None
) -> Fit:
    """Fit with early stopping on an inner split of the training part, never on rows that are scored.

    A split that ``train`` has already (:func:`inner_split`, :func:`inner_side`) is used as it is."""
    rows = train if INNER in train.columns else inner_split(train, seed)
    return boost(rows, spec, max_bins, y, seed, INNER, patience, chunk, shared, part)


def inner_split(train: DataFrame, seed: int = SEED) -> DataFrame:
    """The training part with its inner split, written once for all fits that stop early on it."""
    return materialize(holdout(train, seed=seed + 1, name=INNER), "inner")


def inner_side(data: DataFrame, fold: int) -> DataFrame:
    """The inner split of one fold's training part from the splits of all folds (:func:`claimsieve.operators.folds.inner_splits`)."""
    return data.withColumn(INNER, F.get("inner_folds", F.lit(fold)))


def best_iteration(train: DataFrame, spec: GbtSpec, max_bins: int, y: str = "payout", seed: int = SEED) -> int:
    """Number of trees with the lowest error of the objective on the inner split."""
    return early_stopped(train, spec, max_bins, y, seed).best


def cross_fit(assembled: DataFrame, spec: GbtSpec, max_bins: int, folds: int, early_stop: bool = False, width: int = WIDTH) -> tuple[DataFrame, list[int]]:
    """Out-of-fold predictions: every key is predicted once by a model that did not see it."""
    return cross_fits(assembled, [spec], max_bins, folds, early_stop, width)[0]


def cross_fits(
    assembled: DataFrame,
    specs: Sequence[GbtSpec],
    max_bins: int,
    folds: int,
    early_stop: bool = False,
    width: int = WIDTH,
    features: Sequence[Part] | None = None,
    shared: dict[int, SharedTrees] | None = None,
) -> list[tuple[DataFrame, list[int]]]:
    """:func:`cross_fit` of several configurations over one written table, fits beside each other.

    ``features`` may give each configuration some of the features.  ``shared`` holds what is known already of the fits on a
    fold's training part."""
    parts = features or [None] * len(specs)
    same = not early_stop or "inner_folds" in assembled.columns  # rows of all fits on a fold
    known = {f: (shared or {}).get(f) or (SharedTrees() if same else None) for f in range(folds)}

    def job(spec: GbtSpec, part: Part | None, f: int):
        def run() -> tuple[DataFrame, int]:
            train, valid = assembled.where(F.col("fold") != f), assembled.where(F.col("fold") == f).drop(*PLACES)
            if early_stop and "inner_folds" in assembled.columns:
                train = inner_side(train, f)
            model = early_stopped(train, spec, max_bins, shared=known[f], part=part).chosen if early_stop else boost(train, spec, max_bins, shared=known[f], part=part).model
            return materialize(predict_part(model, valid, part).drop("features"), "oof"), len(model.rounds)

        return run

    done = in_parallel([job(s, v, f) for s, v in zip(specs, parts) for f in range(folds)], fits_at_once(assembled, width, specs))
    out = []
    for i in range(len(specs)):
        own = done[i * folds : (i + 1) * folds]
        out.append((reduce(DataFrame.unionByName, [d for d, _ in own]), [n for _, n in own]))
    return out


def save_boosted(spark: SparkSession, model: Boosted, folder: str) -> None:
    """Trees as Spark ML writes them, next to one row with the rest; without medians the trees are one ensemble."""
    model.save(spark, f"{folder}/trees")
    row = (model.objective, model.learning_rate, model.start, None if isinstance(model, BoostedAtOnce) else [m for _, m in model.rounds])
    save_config(spark.createDataFrame([row], BOOSTED_SCHEMA), f"{folder}/steps")


def load_boosted(spark: SparkSession, folder: str) -> Boosted:
    row = load_config(spark, f"{folder}/steps", BOOSTED_SCHEMA).first()
    if row["medians"] is None:
        return BoostedAtOnce(row["objective"], row["learning_rate"], row["start"], *G.read_ensemble(spark, f"{folder}/trees"))
    trees = PipelineModel.load(f"{folder}/trees").stages
    return Boosted(row["objective"], row["learning_rate"], row["start"], list(zip(trees, row["medians"])))


BOOSTED_SCHEMA = "objective string, learning_rate double, start double, medians array<array<double>>"


# ---- classification --------------------------------------------------------------------------------------------


class ForestModel:
    def __init__(self, model):
        self.model = model

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(df).withColumn("probability", vector_to_array("_prob"))
        return scored.withColumn("predicted", argmax("probability")).drop("_prob", "_raw", "_p")


class OneVsRestModel:
    """One boosted binary model per class; the three probabilities are normalised to sum to one."""

    def __init__(self, models):
        self.models = models

    def predict(self, df: DataFrame) -> DataFrame:
        for k, model in enumerate(self.models):
            df = model.transform(df).withColumn(f"_p{k}", F.get(vector_to_array("probability"), F.lit(1)))
            df = df.drop("probability", "rawPrediction", "prediction")
        parts = [F.col(f"_p{k}") for k in range(len(self.models))]
        total = sum(parts[1:], parts[0])
        scored = df.withColumn("probability", F.array(*[p / total for p in parts]))
        return scored.withColumn("predicted", argmax("probability")).drop(*[f"_p{k}" for k in range(len(parts))])


def fit_classifier(
    train: DataFrame,
    max_bins: int,
    label: str = "risk_class",
    weight: str | None = None,
    trees: int = 20,
    depth: int = 6,
    min_leaf: int = 20,
    seed: int = SEED,
    boosted: bool = False,
    learning_rate: float = 0.05,
):
    """Three-class trees with probabilities: a forest, or one boosted model per class."""
    outputs = {"rawPredictionCol": "_raw", "probabilityCol": "_prob", "predictionCol": "_p"}
    common = dict(featuresCol="features", maxDepth=depth, minInstancesPerNode=min_leaf, maxBins=max_bins, seed=seed)
    if weight:
        common["weightCol"] = weight
    if not boosted:
        return ForestModel(RandomForestClassifier(labelCol=label, numTrees=trees, **outputs, **common).fit(train))
    models = []
    for k in range(3):
        target = train.withColumn("_y", (F.col(label) == k).cast("double"))
        models.append(GBTClassifier(labelCol="_y", maxIter=trees, stepSize=learning_rate, **common).fit(target))
    return OneVsRestModel(models)
