"""Exact order statistics without putting a group into one task.

``percentile`` keeps every distinct value of a group in one buffer and ``row_number`` over a whole group sorts it
in one task.  The operators here first collapse equal values into counts (map-side combined), cut the value range
into buckets with a bounded sketch, and then need only the bucket totals to know which bucket holds a wanted rank.
Only those buckets are ordered.  The sketch decides how evenly the buckets are filled, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimsieve.functions.expr import edge_rank, hash_order, null_safe_join, with_opaque

BUCKETS = 1024


def sketch_edges(counts: DataFrame, value: str, buckets: int = BUCKETS, n: str | None = None) -> Column:
    """Scalar subquery: ``buckets - 1`` approximate cut points of the distinct values.

    Taken over the collapsed counts, so a value that fills a third of the table weighs no more than any other.  The
    shuffle behind ``counts`` is shared with the query that uses the edges if ``n`` names its counts: unread, they would be
    pruned, and the values be shuffled once more without them.
    """
    counts = counts.where(F.col(n) > 0) if n else counts
    grid = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))
    sketch = F.expr(f"percentile_approx(`{value}`, array({grid}), {4 * buckets})")
    return counts.agg(sketch.alias("edges")).scalar()


def _bucketed(counts: DataFrame, value: str, buckets: int, n: str) -> DataFrame:
    edged = counts.withColumn("_edges", sketch_edges(counts, value, buckets, n))
    return with_opaque(edged, "_b", F.coalesce(edge_rank("_edges", value, buckets - 1), F.lit(0))).drop("_edges")


def _group_window(by: Sequence[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def _spans(located: DataFrame, by: Sequence[str], n: str) -> DataFrame:
    """Per group and bucket: rows before it and rows in the group.  At most ``buckets`` rows per group."""
    totals = located.groupBy(*by, "_b").agg(F.sum(n).alias("_inside"))
    running = _group_window(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        totals.withColumn("_end", F.sum("_inside").over(running))
        .withColumn("_size", F.sum("_inside").over(_group_window(by)))
        .withColumn("_start", F.col("_end") - F.col("_inside"))
    )


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), buckets: int = BUCKETS
) -> DataFrame:
    """Linear-interpolated quantiles: one row ``(by…, idx, prob, q)`` per group and probability; nulls ignored."""
    by = list(by)
    v = F.col(value).cast("double")
    base = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counts = base.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    located = _bucketed(counts, "_v", buckets, "_n")

    wanted = F.array(
        *[F.struct(F.lit(i).alias("idx"), F.lit(float(p)).alias("prob")) for i, p in enumerate(probs)]
    )
    position = F.col("_w.prob") * (F.col("_size") - 1)
    low = F.floor(position)
    targets = (
        _spans(located, by, "_n")
        .withColumn("_w", F.explode(wanted))
        .withColumn("_low", low)
        .withColumn("_frac", position - low)
        .withColumn("_rank", F.explode(F.array(F.col("_low"), F.least(F.col("_low") + 1, F.col("_size") - 1))))
        .where((F.col("_start") <= F.col("_rank")) & (F.col("_rank") < F.col("_end")))
        .groupBy(*by, "_b")
        .agg(
            F.first("_start").alias("_start"),
            F.collect_set(F.struct("_w.idx", "_w.prob", "_frac", "_low", "_rank")).alias("_targets"),
        )
    )
    within = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not by:
        targets = F.broadcast(targets)  # at most two buckets per probability
    return (
        null_safe_join(located, targets, by, plain=["_b"])
        .withColumn("_end", F.col("_start") + F.sum("_n").over(within))
        .withColumn(
            "_hit",
            F.filter(
                "_targets",
                lambda t: (t["_rank"] < F.col("_end")) & (t["_rank"] >= F.col("_end") - F.col("_n")),
            ),
        )
        .where(F.size("_hit") > 0)
        .select(*by, "_v", F.explode("_hit").alias("_t"))
        .groupBy(*by, F.col("_t.idx").alias("idx"), F.col("_t.prob").alias("prob"))
        .agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.max("_t._frac").alias("_frac"))
        .select(*by, "idx", "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias("q"))
    )


def quantile_arrays(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), name: str = "qs"
) -> DataFrame:
    """As :func:`exact_quantiles`, with the quantiles of a group in one array ordered like ``probs``."""
    by = list(by)
    long = exact_quantiles(df, value, probs, by)
    packed = F.transform(F.array_sort(F.collect_list(F.struct("idx", "q"))), lambda s: s["q"])
    return long.groupBy(*by).agg(packed.alias(name))


def quantile_columns(
    df: DataFrame, value: str, named_probs: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """As :func:`exact_quantiles`, one named column per probability."""
    arr = quantile_arrays(df, value, list(named_probs.values()), by, "_qs")
    return arr.select(*by, *[F.get("_qs", F.lit(i)).alias(n) for i, n in enumerate(named_probs)])


def quantile_table(df: DataFrame, wanted: dict[str, tuple[str, float]], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles of several columns per group in one pipeline.

    ``wanted`` maps an output name to ``(column, probability)``.  The columns go through one long form, so the rows are
    collapsed and bucketed once, whatever the number of columns.
    """
    by = list(by)
    cols = list(dict.fromkeys(c for c, _ in wanted.values()))
    probs = sorted({p for _, p in wanted.values()})
    cells = [F.struct(F.lit(c).alias("_what"), F.col(c).cast("double").alias("_x")) for c in cols]
    long = df.select(*by, F.inline(F.array(*cells)))
    found = exact_quantiles(long, "_x", probs, [*by, "_what"])

    def pick(col: str, prob: float) -> Column:
        return F.max(F.when((F.col("_what") == col) & (F.col("idx") == probs.index(prob)), F.col("q")))

    return found.groupBy(*by).agg(*[pick(c, p).alias(name) for name, (c, p) in wanted.items()])


def quantile_scalar(df: DataFrame, value: str, prob: float = 0.5) -> Column:
    """Scalar subquery holding one exact quantile."""
    return exact_quantiles(df, value, [prob]).agg(F.max("q").alias("q")).scalar()


def positions(
    counts: DataFrame, value: str, n: str, by: Sequence[str] = (), buckets: int = BUCKETS
) -> DataFrame:
    """Adds ``before``: rows of the group with a smaller value.  ``counts`` has one row per group and value."""
    by = list(by)
    located = _bucketed(counts, value, buckets, n)
    spans = _spans(located, by, n).select(*by, "_b", "_start")
    within = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = located.withColumn("_run", F.sum(n).over(within))
    return (
        null_safe_join(local, spans, by, plain=["_b"])
        .withColumn("before", F.col("_start") + F.col("_run") - F.col(n))
        .drop("_b", "_run", "_start")
    )


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per group and value: ``(by…, value, n, avg_rank)``, ties sharing their mean rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return positions(counts, value, "n", by).select(
        *by, value, "n", (F.col("before") + (F.col("n") + 1) / 2.0).alias("avg_rank")
    )


def hash_ordinal(
    df: DataFrame, key: str, seed: int, by: Sequence[str] = (), name: str = "ordinal"
) -> DataFrame:
    """Zero-based position of every row in the seeded hash order of its group.

    The first three hex digits of the hash make 4,096 even buckets; only their counts are accumulated globally, and
    the window below has the same partitioning as the join, so the rows move once.
    """
    by = list(by)
    hashed = df.withColumn("_h", hash_order(key, seed)).withColumn("_b", F.substring("_h", 1, 3))
    counts = hashed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    running = _group_window(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.withColumn("_start", F.sum("_n").over(running) - F.col("_n")).drop("_n")
    local = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key))
    return (
        null_safe_join(hashed.withColumn("_r", local), starts, by, plain=["_b"])
        .withColumn(name, F.col("_start") + F.col("_r") - 1)
        .drop("_h", "_b", "_r", "_start")
    )


def first_by_hash(df: DataFrame, key: str, seed: int, k: int, by: Sequence[str] = ()) -> DataFrame:
    """At most ``k`` rows per group, those first in the seeded hash order.

    Spark limits each map task to ``k`` rows per group before the shuffle; the extra level of 256 buckets bounds
    what the last task of a hot group receives to ``256 * k`` rows whatever the number of map tasks.
    """
    by = list(by)
    hashed = df.withColumn("_h", hash_order(key, seed)).withColumn("_b", F.substring("_h", 1, 2))
    first = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key))
    second = F.row_number().over(_group_window(by).orderBy("_h", key))
    return (
        hashed.withColumn("_r", first)
        .where(F.col("_r") <= k)
        .withColumn("_r2", second)
        .where(F.col("_r2") <= k)
        .drop("_h", "_b", "_r", "_r2")
    )
