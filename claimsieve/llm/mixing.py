"""Mixing to target weights by iterative proportional fitting, with DataFrame functions only.

Tokens are summed by cell (one value of every dimension).  Each step scales the cells of one dimension so that their
sums meet that dimension's targets; steps go round the dimensions until all targets are met.  A cell's fitted tokens by
its tokens is the rate at which its documents are sampled.  Only cell sums are iterated on, in one aggregation and one
join each, and a cell or source that holds a third of all rows is summed map-side.

Rates are scaled so that the mixture has as many tokens as the input: cells above their targets are thinned, and rare
cells repeat.  With ``most`` they are scaled by the largest factor that asks for no more than that of any cell, so the
scarcest cell decides how much of all others stays.  A document appears
``floor(rate)`` times and once more with the rest as probability, drawn from a hash of its id, text and the seed: the same
documents in every run and however the table is divided.  Rows of equal id and text are drawn one by one, by their place
in the table.  Tokens are estimated with a regular expression unless the caller counts them.

Defined results: a null value of a dimension is a value of its own; values without a target share
what the targets leave of 1, in proportion to their tokens; if the targets as given leave nothing, values without one
keep the share that they have and the targets are scaled to the rest; if there are no such values, the
targets are scaled to 1; targets of values that don't occur are left out; documents
without tokens take their cell's rate and don't count in any sum; columns named ``sample_rate`` or ``copies`` are replaced;
an empty table gives an empty result.  Targets that contradict each other (for cells that don't exist) are met as nearly as the last step can.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.session import materialize

NULL = "\u0000null"
TOLERANCE = 1e-6
MAX_SWEEPS = 40
CELLS_A_TASK = 100_000
IN_PLACE = 64  # copies that a task makes of one row
PIECES = r"[A-Za-z0-9]{1,5}|[^A-Za-z0-9\s]"


def key_of(name: str) -> F.Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(NULL))


def cells_of(docs: DataFrame, dims: list[str], tokens: F.Column) -> DataFrame:
    """``<dims>, tokens`` of every cell."""
    return docs.select(*[key_of(d).alias(d) for d in dims], tokens.cast("double").alias("tokens")).groupBy(*dims).agg(F.sum(F.coalesce("tokens", F.lit(0.0))).alias("tokens"))


def complete_targets(cells: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    """``dim, value, want`` (shares that sum to 1 in each dimension) for every value that has tokens."""
    spark = cells.sparkSession
    full = [d for d, t in targets.items() if sum(t.values()) >= 1 - TOLERANCE]  # nothing left for other values
    given = spark.createDataFrame([(d, NULL if v is None else str(v), float(w)) for d, t in targets.items() for v, w in t.items()], "dim string, value string, given double")
    values = cells.select("tokens", F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in targets])).alias("v"))
    sums = values.groupBy("v.dim", "v.value").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    joined = sums.join(given, ["dim", "value"], "left")
    totals = joined.groupBy("dim").agg(F.sum("tokens").alias("all"), F.sum(F.when(F.col("given").isNull(), F.col("tokens")).otherwise(0.0)).alias("free"), F.sum("given").alias("given_all"))
    given_all, free = F.coalesce("given_all", F.lit(0.0)), F.col("free")
    kept = free / F.col("all")
    rest = F.when(F.col("dim").isin(full), kept).otherwise(F.greatest(1 - given_all, F.lit(0.0)))
    named = F.when(free <= 0, 1.0).when(F.col("dim").isin(full), 1 - kept).otherwise(given_all)
    asked = F.try_divide(F.col("given") * named, given_all)
    left = rest * F.try_divide(F.col("tokens"), free)
    want = F.when(F.col("given").isNull(), left).otherwise(asked)
    return joined.join(totals, "dim").select("dim", "value", F.coalesce(want, F.lit(0.0)).alias("want"))


def _step(cells: DataFrame, dim: str, want: DataFrame) -> DataFrame:
    """Scale the cells so that the sums of one dimension meet its targets."""
    sums = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("w").alias("s")).join(want, "value")
    factor = sums.select(F.col("value").alias(dim), F.coalesce(F.try_divide("want", "s"), F.lit(0.0)).alias("f"))
    return cells.join(factor, dim).select(*[c for c in cells.columns if c != "w"], (F.col("w") * F.col("f")).alias("w"))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]], max_sweeps: int = MAX_SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``<dims>, tokens, w``: fitted share ``w`` of every cell with tokens.  Every step reads the written cells of the
    step before twice (sums, then scaling), so the plan stays short."""
    wanted = materialize(complete_targets(cells, targets), "targets")
    wants = {d: wanted.filter(F.col("dim") == d).select("value", "want") for d in targets}
    start = cells.filter("tokens > 0")
    size = start.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    parts = 1 + size["n"] // CELLS_A_TASK
    now = materialize(start.withColumn("w", F.col("tokens") / F.lit(size["t"] or 1.0)).coalesce(parts), "cells")
    for _ in range(max_sweeps if size["n"] else 0):
        for dim in targets:
            now = materialize(_step(now, dim, wants[dim]).coalesce(parts), "cells")
        each = now.select("w", F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in targets])).alias("v"))
        off = each.groupBy("v.dim", "v.value").agg(F.sum("w").alias("s")).join(wanted, ["dim", "value"]).agg(F.max(F.abs(F.col("s") - F.col("want")))).first()[0]
        if off is None or off < tolerance:
            break
    return now


def unit(seed: int, *cols: str) -> F.Column:
    """A number in [0, 1) from the md5 of the seed and the columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)


def estimated_tokens(text: str = "text") -> F.Column:
    """Tokens of a text, estimated without a tokenizer: pieces of at most five ASCII letters or digits, and every other
    character but white space."""
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(PIECES)).cast("double")


def sampling_rates(cells: DataFrame, targets: dict[str, dict[str, float]], most: float | None = 1.0) -> DataFrame:
    """``<dims>, rate`` of every cell of :func:`cells_of`."""
    dims = list(targets)
    fitted = rake(cells, targets).select(*[F.col(d).alias(f"_{d}") for d in dims], "w", F.col("tokens").alias("_t"), (F.col("w") / F.col("tokens")).alias("r"))
    sums = fitted.agg(F.max("r").alias("top"), F.sum("w").alias("w"), F.sum("_t").alias("t")).first()
    scale = (sums["t"] or 1.0) / (sums["w"] or 1.0) if most is None else most / (sums["top"] or 1.0)
    scaled = fitted.select(*[f"_{d}" for d in dims], (F.col("r") * F.lit(float(scale))).alias("rate"))
    same = [F.col(d) == F.col(f"_{d}") for d in dims]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return cells.join(scaled, cond, "left").select(*dims, F.coalesce("rate", F.lit(1.0 if most is None else float(most))).alias("rate"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]], tokens: F.Column | DataFrame, most: float | None = 1.0, seed: int = 2025, id_col: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` with ``sample_rate`` and ``copies``, how often the row is in the mixture.

    ``tokens`` counts a row's tokens, unless they have been summed: then it is the written table of :func:`cells_of`.
    ``docs`` is a table that reads alike each time, as a file does."""
    dims = list(targets)
    docs = docs.drop("sample_rate", "copies")
    cells = tokens if isinstance(tokens, DataFrame) else materialize(cells_of(docs, dims, tokens), "cells")
    rates = sampling_rates(cells, targets, most)
    values = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in [id_col, *(c for c in ("text",) if c in docs.columns)]]
    digest = F.md5(F.concat_ws("\n", *values).cast("binary"))
    again = docs.select(digest.alias("_again")).groupBy("_again").agg(F.count("*").alias("_n")).filter("_n > 1").select("_again")
    again = materialize(again, "repeated")
    keyed = docs.select("*", digest.alias("_draw"), *[key_of(d).alias(f"_key_{i}") for i, d in enumerate(dims)])
    if not again.isEmpty():
        numbered = keyed.withColumn("_place", F.monotonically_increasing_id())
        marked = numbered.join(again, F.col("_draw") == F.col("_again"), "left")
        keyed = marked.withColumn("_draw", F.when(F.col("_again").isNull(), F.col("_draw")).otherwise(F.concat_ws("#", "_draw", "_place"))).drop("_again", "_place")
    named = rates.select(*[F.col(d).alias(f"_key_{i}") for i, d in enumerate(dims)], F.col("rate").alias("sample_rate"))
    named = materialize(named, "rates")
    if named.count() <= CELLS_A_TASK:
        named = F.broadcast(named)  # a few strings and a number each
    out = keyed.join(named, [f"_key_{i}" for i in range(len(dims))])
    copies = F.floor("sample_rate") + (unit(seed, "_draw") < F.col("sample_rate") - F.floor("sample_rate")).cast("long")
    return out.withColumn("copies", copies.cast("long")).drop("_draw", *[f"_key_{i}" for i in range(len(dims))])


def drawn(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every row, as often as its ``copies`` say.  A row with many copies is dealt over the tasks first."""
    one = F.lit(1).cast("long")
    times = F.explode(F.sequence(one, F.col("copies"))).alias("_copy")
    few = mixed.filter(F.col("copies").between(1, IN_PLACE)).select(*columns, times).select(*columns)
    if not (mixed.agg(F.max("copies")).first()[0] or 0) > IN_PLACE:
        return few
    turns = mixed.filter(F.col("copies") > IN_PLACE).select(*columns, "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / IN_PLACE))).alias("_turn"))
    turns = turns.repartition(F.xxhash64("_turn", F.monotonically_increasing_id()))
    last = F.least(F.col("copies") - F.col("_turn") * IN_PLACE, F.lit(IN_PLACE).cast("long"))
    return few.unionByName(turns.select(*columns, F.explode(F.sequence(one, last)).alias("_copy")).select(*columns))


def form_topic(text: str = "text") -> F.Column:
    """Topics by the form of a text, for tables without a topic."""
    bars = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^|]", ""))
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    return F.when(bars * 50 > size, "table").when(size < 500, "note").when(size < 4000, "article").otherwise("book")


TARGETS = {
    "lang": {"en": 0.55, "de": 0.17, "fr": 0.16, "es": 0.12},
    "_form": {"table": 0.03, "note": 0.01, "article": 0.40, "book": 0.56},
}
HOT_SHARE = 0.3


def source_targets(cells: DataFrame, hot_share: float = HOT_SHARE) -> dict[str, float]:
    """From the cells: bring every source that holds more than ``hot_share`` of the tokens down to it (there are fewer than
    ``1 / hot_share`` of those); the others share the rest as they do now, and need no target of their own."""
    sums = cells.groupBy("source").agg(F.sum("tokens").alias("t"))
    all_ = sums.agg(F.sum("t")).first()[0] or 0.0
    return {r["source"]: hot_share for r in sums.filter(F.col("t") > all_ * hot_share).collect()}  # fewer than 1 / hot_share rows
