"""Column expressions shared by the operators.  All of them stay on the JVM side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(as_col(c).cast("double"), digits) + F.lit(0.0)


def half_even(c: Column | str, digits: int = 0) -> Column:
    """Half-to-even rounding of the scaled double, as numeric Python libraries round."""
    scale = float(10**digits)
    return F.rint(as_col(c) * scale) / scale


def flag(condition: Column) -> Column:
    """0/1 integer; an unknown comparison counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def nan_to_null(c: Column | str) -> Column:
    """Spark orders NaN above every number, so it is turned into null before any comparison."""
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def edge_rank(edges: Column | str, x: Column | str, max_edges: int | None = None, inclusive: bool = False) -> Column:
    """How many entries of a sorted array are smaller than ``x`` (or equal, if ``inclusive``), by binary search.

    With the inner quantile edges as the array this is the bin number of right-closed bins whose lowest bin
    includes its lower end.  Without ``max_edges`` arrays of
    up to 2**25 - 1 entries are searched; a step beyond the end of an array finds nothing there and isn't taken.
    """
    edges, x = as_col(edges), as_col(x)

    def below(e: Column) -> Column:
        return e <= x if inclusive else e < x

    steps = F.array(*[F.lit(2**k) for k in range(24, -1, -1) if max_edges is None or 2**k <= max(max_edges, 1)])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda pos, step: F.when(below(F.get(edges, pos + step - 1)), pos + step).otherwise(pos),
    )


def with_opaque(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column whose defining expression the optimizer cannot see through.

    A bucket number that is later a join key must not be re-derived on the other side of the join: filter inference
    otherwise copies its expression, with columns that side does not have.
    """
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def hash_order(key: Column | str | Sequence[str], seed: int) -> Column:
    """A reproducible pseudo-random order that depends only on the key and the seed."""
    parts = [key] if isinstance(key, (str, Column)) else list(key)
    return F.md5(F.concat_ws("|", *[as_col(p).cast("string") for p in parts], F.lit(str(seed))))


def argmax(scores: Column | str) -> Column:
    """Zero-based index of the first maximum of an array."""
    scores = as_col(scores)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def linspace(lo: Column, hi: Column, step: Column, points: int) -> Column:
    return lo + (hi - lo) * step / F.lit(float(points - 1))


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", plain: Sequence[str] = ()
) -> DataFrame:
    """Equi-join whose keys may be null (a null key matches a null key).  Keys are kept once, from the left.

    ``plain`` keys are never null and use ordinary equality, which keeps an existing partitioning on them usable.
    """
    keys = [*keys, *plain]
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for k in keys:
        mine, other = left[k], renamed[f"_right_{k}"]
        cond = cond & ((mine == other) if k in plain else mine.eqNullSafe(other))
    joined = left.join(renamed, cond, how)
    if how in ("full", "outer", "full_outer"):
        for k in keys:
            joined = joined.withColumn(k, F.coalesce(F.col(k), F.col(f"_right_{k}")))
    return joined.drop(*[f"_right_{k}" for k in keys])
