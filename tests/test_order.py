import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimsieve.operators.order import (
    average_ranks,
    exact_quantiles,
    first_by_hash,
    hash_ordinal,
    quantile_arrays,
)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for i in range(6000):
        g = "hot" if i % 3 else rng.choice("abcd")
        v = 5.0 if i % 5 == 0 else round(rng.lognormvariate(3, 2), 3)
        rows.append((i, None if g == "d" else g, v if i % 97 else None))
    pdf = pd.DataFrame(rows, columns=["key", "g", "v"])
    return spark.createDataFrame(rows, "key long, g string, v double"), pdf


@pytest.mark.parametrize("buckets", [2, 16, 1024])
def test_quantiles_match_numpy(skewed, buckets):
    df, pdf = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.86, 0.999, 1.0]
    got = {r.idx: r.q for r in exact_quantiles(df, "v", probs, buckets=buckets).collect()}
    want = np.nanquantile(pdf.v, probs)
    assert [got[i] for i in range(len(probs))] == pytest.approx(list(want), rel=1e-12)


def test_grouped_quantiles_keep_null_group(skewed):
    df, pdf = skewed
    probs = [0.25, 0.5, 0.97]
    got = {r.g: r.qs for r in quantile_arrays(df, "v", probs, ["g"]).collect()}
    want = pdf.groupby("g", dropna=False).v.quantile(probs).unstack()
    assert len(got) == len(want)
    for g, row in want.iterrows():
        assert got[None if isinstance(g, float) else g] == pytest.approx(list(row), rel=1e-12)


def test_small_quantile(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double")
    assert exact_quantiles(df, "v", [0.85]).first().q == pytest.approx(3.4)


def test_average_ranks(skewed):
    df, pdf = skewed
    got = average_ranks(df, "v").toPandas().set_index("v").avg_rank
    want = pdf.v.dropna().rank()
    assert (pdf.v.dropna().map(got) - want).abs().max() == 0


def test_hash_ordinal_is_a_permutation_per_group(skewed):
    df, pdf = skewed
    got = hash_ordinal(df, "key", 2025, ["g"]).toPandas()
    assert len(got) == len(pdf)
    for _, part in got.groupby("g", dropna=False):
        assert sorted(part.ordinal) == list(range(len(part)))


def test_hash_ordinal_ignores_partitioning(skewed):
    df, _ = skewed
    a = hash_ordinal(df, "key", 1).select("key", "ordinal")
    b = hash_ordinal(df.repartition(13), "key", 1).select("key", "ordinal")
    assert a.exceptAll(b).count() == 0


def test_first_by_hash(skewed):
    df, pdf = skewed
    got = first_by_hash(df, "key", 3, 50, ["g"])
    ordinal = hash_ordinal(df, "key", 3, ["g"]).where(F.col("ordinal") < 50).drop("ordinal")
    assert got.exceptAll(ordinal).count() == 0
    assert got.count() == ordinal.count()
    assert not math.isnan(got.count())


def test_the_sketch_reads_the_counts_that_the_quantiles_read(spark):
    df = spark.createDataFrame([(i % 7, float(i * 37 % 101)) for i in range(400)] + [(None, 1.0), (1, None)], "g int, x double")
    for by in ([], ["g"]):
        found = exact_quantiles(df, "x", [0.25, 0.5], by)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        counted = [line for line in plan.splitlines() if re.search(r"Aggregate \[.*_v#\d+\], \[", line)]
        assert counted and all("count(1)" in line for line in counted)  # values alone would be shuffled once more
