"""Class-imbalance treatments and classification metrics for the three risk classes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsieve.functions.expr import argmax
from claimsieve.operators.order import hash_ordinal

CLASSES = (0, 1, 2)


def class_counts(df: DataFrame, label: str = "risk_class") -> Column:
    """Scalar subquery: rows per class as an array of three."""
    return df.agg(F.array(*[F.count_if(F.col(label) == k) for k in CLASSES]).alias("counts")).scalar()


def balanced_weights(df: DataFrame, label: str = "risk_class", name: str = "weight") -> DataFrame:
    """Add ``n / (3 * n_k)``."""
    own = F.get("_counts", F.col(label))
    total = F.aggregate("_counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return df.withColumn("_counts", class_counts(df, label)).withColumn(name, total / (own * len(CLASSES))).drop("_counts")


def copies(
    df: DataFrame, ratios: dict[int, float], label: str = "risk_class", key: str = "claim_key", seed: int = 2025, name: str = "copies", ordinal: Column | None = None
) -> DataFrame:
    """Add how often each row counts so that every listed class has ``ratio`` times as many rows as class 0.

    Every row counts; those that count once more than the others come first in the seeded hash order of their class.
    ``ordinal`` is a row's place in that order where it is known already; then no row is moved."""
    target = F.lit(None).cast("double")
    for k, ratio in ratios.items():
        target = F.when(F.col(label) == k, F.bround(F.get("_counts", F.lit(0)) * F.lit(float(ratio)))).otherwise(target)
    ranked = hash_ordinal(df, key, seed, [label], "_o") if ordinal is None else df.withColumn("_o", ordinal)
    ranked = ranked.withColumn("_counts", class_counts(df, label))
    own = F.get("_counts", F.col(label))
    extra = F.greatest(F.coalesce(target.cast("bigint") - own, F.lit(0)), F.lit(0))
    times = 1 + F.expr("_extra div _own") + F.when(F.col("_o") < F.col("_extra") % F.col("_own"), 1).otherwise(0)
    return ranked.withColumn("_own", own).withColumn("_extra", extra).withColumn(name, times.cast("int")).drop("_o", "_counts", "_own", "_extra")


def oversample(
    df: DataFrame,
    ratios: dict[int, float],
    label: str = "risk_class",
    key: str = "claim_key",
    seed: int = 2025,
    copy: str = "copy",
) -> DataFrame:
    """Repeat the rows of each listed class until it has ``ratio`` times as many rows as class 0 (see :func:`copies`).

    Copies are made inside the task that holds the row."""
    return copies(df, ratios, label, key, seed, "_times").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times")


def prior_correct(df: DataFrame, priors: Column, w: float, probability: str = "probability") -> DataFrame:
    """Divide class probabilities by ``prior ** w``, renormalise, and take the first maximum.  A class without a prior was
    never seen in training, so it scores 0; if that leaves nothing, the probabilities stay as they are."""
    raw = F.zip_with(probability, "_priors", lambda p, prior: F.coalesce(F.try_divide(p, F.pow(prior, F.lit(float(w)))), F.lit(0.0)))
    total = F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x)
    return (
        df.withColumn("_priors", priors)
        .withColumn("_raw", raw)
        .withColumn("corrected", F.when(total > 0, F.transform("_raw", lambda x: F.try_divide(x, total))).otherwise(F.col(probability)))
        .withColumn("predicted", argmax("corrected"))
        .drop("_priors", "_raw")
    )


def class_priors(df: DataFrame, label: str = "risk_class") -> Column:
    """Scalar subquery: class shares as an array of three."""
    total = F.count(F.lit(1))
    return df.agg(F.array(*[F.try_divide(F.count_if(F.col(label) == k), total) for k in CLASSES]).alias("priors")).scalar()


def confusion_long(df: DataFrame, true: str = "risk_class", pred: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """All nine cells ``(by…, true_class, pred_class, n)`` from one aggregation, empty ones included."""
    cells = [
        F.struct(
            F.lit(t).alias("true_class"),
            F.lit(p).alias("pred_class"),
            F.count_if((F.col(true) == t) & (F.col(pred) == p)).alias("n"),
        )
        for t in CLASSES
        for p in CLASSES
    ]
    return df.groupBy(*by).agg(F.array(*cells).alias("cells")).select(*by, F.inline("cells"))


def confusion(df: DataFrame, true: str = "risk_class", pred: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """Wide confusion matrix: one row per true class."""
    return widen_confusion(confusion_long(df, true, pred, by), by)


def widen_confusion(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return cells.groupBy(*by, "true_class").agg(
        *[F.sum(F.when(F.col("pred_class") == p, F.col("n")).otherwise(0)).alias(f"pred_{p}") for p in CLASSES]
    )


def row_normalised(cells: DataFrame) -> DataFrame:
    """Cells with their share of the true class."""
    from pyspark.sql import Window

    support = F.sum("n").over(Window.partitionBy("true_class"))
    return cells.withColumn("share", F.coalesce(F.try_divide(F.col("n"), support), F.lit(0.0)))


def metrics_from_cells(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class precision, recall, F1 (0 where undefined) and support, with accuracy and macro-F1."""

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    def safe(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    same = F.col("true_class") == F.col("pred_class")
    aggs = [total(same).alias("hits"), F.sum("n").alias("n")]
    for k in CLASSES:
        aggs += [
            total(same & (F.col("true_class") == k)).alias(f"tp_{k}"),
            total(F.col("true_class") == k).alias(f"t_{k}"),
            total(F.col("pred_class") == k).alias(f"p_{k}"),
        ]
    sums = cells.groupBy(*by).agg(*aggs)
    f1 = {k: safe(2 * F.col(f"tp_{k}"), F.col(f"t_{k}") + F.col(f"p_{k}")) for k in CLASSES}
    rows = [
        F.struct(
            F.lit(k).alias("risk_class"),
            safe(F.col(f"tp_{k}"), F.col(f"p_{k}")).alias("precision"),
            safe(F.col(f"tp_{k}"), F.col(f"t_{k}")).alias("recall"),
            f1[k].alias("f1"),
            F.col(f"t_{k}").alias("support"),
        )
        for k in CLASSES
    ]
    macro = sum(f1.values(), F.lit(0.0)) / len(CLASSES)
    return sums.select(
        *by, F.inline(F.array(*rows)), safe(F.col("hits"), F.col("n")).alias("accuracy"), macro.alias("macro_f1")
    )


def class_metrics(df: DataFrame, true: str = "risk_class", pred: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    return metrics_from_cells(confusion_long(df, true, pred, by), by)


def fold_summary(
    df: DataFrame, true: str = "risk_class", pred: str = "predicted", fold: str = "fold", by: Sequence[str] = ()
) -> DataFrame:
    """Mean and population deviation over folds of macro-F1, and mean accuracy and recall of the severe class."""
    per_fold = class_metrics(df, true, pred, [*by, fold]).where(F.col("risk_class") == CLASSES[-1])
    return per_fold.groupBy(*by).agg(
        F.avg("macro_f1").alias("macro_f1_mean"),
        F.stddev_pop("macro_f1").alias("macro_f1_std"),
        F.avg("accuracy").alias("accuracy_mean"),
        F.avg("recall").alias("severe_recall_mean"),
    )


def majority_baseline(df: DataFrame, true: str = "risk_class") -> DataFrame:
    """Metrics of always predicting class 0."""
    return class_metrics(df.withColumn("predicted", F.lit(0)), true)


def compare_routes(routes: dict[str, DataFrame], true: str = "risk_class", pred: str = "predicted") -> DataFrame:
    """Metrics of several routes' predictions of the same claims, one row per route and class, in one aggregation."""
    named = [df.select(F.lit(name).alias("route"), true, pred) for name, df in routes.items()]
    return class_metrics(reduce(DataFrame.unionByName, named), true, pred, ["route"])


def scheme_report(predictions: DataFrame, keys: Sequence[str] = ("ordinal", "scheme")) -> DataFrame:
    """Fold means plus pooled precision and F1 of the severe class, per scheme."""
    pooled = class_metrics(predictions, by=keys).where(F.col("risk_class") == CLASSES[-1])
    pooled = pooled.select(*keys, F.col("precision").alias("severe_precision"), F.col("f1").alias("severe_f1"))
    return fold_summary(predictions, by=keys).join(pooled, list(keys))


def best_scheme(scores: DataFrame, score: str = "macro_f1_mean", ordinal: str = "ordinal") -> DataFrame:
    """The first scheme with the highest score."""
    return scores.orderBy(F.col(score).desc(), F.col(ordinal)).limit(1)
