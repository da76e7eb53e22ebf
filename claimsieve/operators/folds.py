"""Reproducible splits.  A fold depends on the key and the seed only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimsieve.functions.expr import hash_order
from claimsieve.operators.order import hash_ordinal

SEED = 2025


def kfold(df: DataFrame, key: str = "claim_key", k: int = 5, seed: int = SEED, name: str = "fold") -> DataFrame:
    """``k`` shuffled folds whose sizes differ by at most one."""
    return hash_ordinal(df, key, seed, name="_o").withColumn(name, (F.col("_o") % k).cast("int")).drop("_o")


def stratified_kfold(
    df: DataFrame, label: str, key: str = "claim_key", k: int = 5, seed: int = SEED, name: str = "fold", ordinal: str | None = None
) -> DataFrame:
    """``k`` folds balanced within every class; ``ordinal`` names a column for the row's place in its class, from 0."""
    place = ordinal or "_o"
    dealt = hash_ordinal(df, key, seed, [label], place).withColumn(name, (F.col(place) % k).cast("int"))
    return dealt if ordinal else dealt.drop(place)


def training_ordinal(ordinal: str, fold: int, k: int) -> Column:
    """A row's place in its class among the rows outside ``fold``, from its place among all of them (:func:`stratified_kfold`)."""
    return F.expr(f"`{ordinal}` - (`{ordinal}` + {k - 1 - fold}) div {k}")


def holdout(
    df: DataFrame, key: str = "claim_key", frac: float = 0.2, seed: int = SEED, name: str = "is_holdout"
) -> DataFrame:
    """The first ``ceil(frac * n)`` rows of the hash order are held out."""
    size = df.agg(F.ceil(F.count(F.lit(1)) * frac).alias("n")).scalar()
    return (
        hash_ordinal(df, key, seed, name="_o")
        .withColumn("_n", size)
        .withColumn(name, (F.col("_o") < F.col("_n")).cast("int"))
        .drop("_o", "_n")
    )


def inner_splits(
    df: DataFrame, k: int, key: str = "claim_key", frac: float = 0.2, seed: int = SEED, fold: str = "fold", name: str = "inner_folds"
) -> DataFrame:
    """:func:`holdout` of every fold's training part at once: an array whose entry ``f`` is 1 for the held-out rows outside fold ``f``.

    One pass orders the rows by hash and counts those outside each fold, so the rows move once and not once a fold."""
    outside = [(F.col(fold) != f).cast("int") for f in range(k)]
    hashed = df.withColumn("_h", hash_order(key, seed)).withColumn("_b", F.substring("_h", 1, 3))
    counts = hashed.groupBy("_b").agg(*[F.sum(c).alias(f"_n{f}") for f, c in enumerate(outside)])
    whole = Window.partitionBy(F.lit(0))  # at most 4,096 buckets
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select(
        "_b",
        F.array(*[F.sum(f"_n{f}").over(before) - F.col(f"_n{f}") for f in range(k)]).alias("_starts"),
        F.array(*[F.ceil(F.sum(f"_n{f}").over(whole) * frac) for f in range(k)]).alias("_sizes"),
    )
    local = Window.partitionBy("_b").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hashed.withColumn("_places", F.array(*[F.sum(c).over(local) for c in outside])).join(starts, "_b")
    inner = [((F.col(fold) != f) & (F.get("_starts", F.lit(f)) + F.get("_places", F.lit(f)) <= F.get("_sizes", F.lit(f)))).cast("int") for f in range(k)]
    return placed.withColumn(name, F.array(*inner)).drop("_h", "_b", "_places", "_starts", "_sizes")
