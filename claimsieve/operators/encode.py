"""Keyed lookups: frequency encoding, category drift, unseen keys.

All keys of a table are counted in one pass over a long ``(key_name, key_value)`` form: one map-side combined
shuffle instead of one per key, and a hot key costs one row per map task.  Attaching the counts is an ordinary left
join.  Spark broadcasts a dictionary only when its measured size is under the session's threshold; above it the join
is sort-merge and adaptive execution splits the partition of a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.session import materialize

PAIR_SEPARATOR = "_"


def _long(df: DataFrame, keys: dict[str, Sequence[str]]) -> DataFrame:
    cells = [
        F.struct(F.lit(name).alias("key_name"), key_text(cols).alias("key_value")) for name, cols in keys.items()
    ]
    return df.select(F.inline(F.array(*cells)))


def key_text(cols: Sequence[str]):
    """A key as text.  Several columns are joined with an underscore; backslashes and underscores inside a value get a
    backslash, so different values never make one key, and a null in any column makes a null key."""
    if len(cols) == 1:
        return F.col(cols[0]).cast("string")
    parts = [F.regexp_replace(F.col(c).cast("string"), r"([\\_])", r"\\$1") for c in cols]
    joined = [parts[0]]
    for p in parts[1:]:
        joined += [F.lit(PAIR_SEPARATOR), p]
    return F.concat(*joined)


def key_counts(df: DataFrame, keys: dict[str, Sequence[str]]) -> DataFrame:
    """Dictionary table ``(key_name, key_value, n)``; null keys are not counted."""
    return (
        _long(df, keys).where(F.col("key_value").isNotNull()).groupBy("key_name", "key_value").agg(F.count(F.lit(1)).alias("n"))
    )


def fit_frequencies(
    train: DataFrame, score: DataFrame, keys: dict[str, Sequence[str]], scope: str = "union"
) -> DataFrame:
    """Counts over both tables (``scope='union'``) or over the training table alone (``scope='train'``).

    The dictionary is written once: looked up by several keys it would otherwise be counted again for each of them."""
    if scope not in ("union", "train"):
        raise ValueError("scope must be 'union' or 'train'")
    cols = sorted({c for group in keys.values() for c in group})
    source = train.select(*cols)
    if scope == "union":
        source = source.unionByName(score.select(*cols))
    return materialize(key_counts(source, keys), "frequencies")


def freq_encode(
    df: DataFrame, dictionary: DataFrame, keys: dict[str, Sequence[str]], default: dict[str, float] | None = None
) -> DataFrame:
    """Add ``<name>_freq`` as double; a key missing from the dictionary gives null or ``default[name]``."""
    for name, cols in keys.items():
        lookup = dictionary.where(F.col("key_name") == name).select(
            F.col("key_value").alias("_key"), F.col("n").cast("double").alias(f"{name}_freq")
        )
        df = df.withColumn("_key", key_text(cols)).join(lookup, "_key", "left").drop("_key")
        if default and name in default:
            df = df.withColumn(f"{name}_freq", F.coalesce(F.col(f"{name}_freq"), F.lit(default[name])))
    return df


def _side_counts(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    keys = {c: [c] for c in cols}
    both = _long(a, keys).withColumn("_a", F.lit(1)).unionByName(_long(b, keys).withColumn("_a", F.lit(0)))
    return both.groupBy("key_name", "key_value").agg(
        F.sum("_a").alias("n_a"), F.sum(1 - F.col("_a")).alias("n_b")
    )


def drift(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of every value in both tables (null counted as a value, a missing share is 0), difference in points."""
    counts = _side_counts(a, b, cols)
    totals = counts.groupBy("key_name").agg(F.sum("n_a").alias("t_a"), F.sum("n_b").alias("t_b"))
    share_a = F.coalesce(F.try_divide(F.col("n_a"), F.col("t_a")), F.lit(0.0)) * 100
    share_b = F.coalesce(F.try_divide(F.col("n_b"), F.col("t_b")), F.lit(0.0)) * 100
    return counts.join(totals, "key_name").select(
        F.col("key_name").alias("column_name"),
        F.col("key_value").alias("value"),
        share_a.alias("pct_a"),
        share_b.alias("pct_b"),
        (share_b - share_a).alias("diff_points"),
    )


def unseen(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per key column: distinct keys of ``a``, of ``b``, and of ``b`` that ``a`` does not have.  One pass."""
    counts = _side_counts(a, b, cols).where(F.col("key_value").isNotNull())
    return counts.groupBy(F.col("key_name").alias("column_name")).agg(
        F.count_if(F.col("n_a") > 0).alias("n_a"),
        F.count_if(F.col("n_b") > 0).alias("n_b"),
        F.count_if((F.col("n_a") == 0) & (F.col("n_b") > 0)).alias("n_unseen"),
    )


def attach_labels(df: DataFrame, labels: DataFrame, key: str = "claim_key") -> DataFrame:
    """Pair features with labels by key, never by row position."""
    return df.join(labels, key)


def key_levels(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Distinct union of the values of one column."""
    return a.select(col).union(b.select(col)).distinct()


def key_difference(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Values of ``b`` that ``a`` does not have."""
    return b.select(col).where(F.col(col).isNotNull()).subtract(a.select(col))


def concat_values(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    return a.select(col).unionAll(b.select(col))


def concat_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; a column missing on one side becomes null."""
    return a.unionByName(b, allowMissingColumns=True)
