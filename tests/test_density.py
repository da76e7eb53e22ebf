import numpy as np
from pyspark.sql import functions as F

from claimsieve.operators.density import bandwidth, density_cells, kde_at, kde_curve


def plain(x, values, h):
    z = (np.asarray(x)[:, None] - np.asarray(values)[None, :]) / h
    return np.exp(-0.5 * z * z).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))


def test_density_of_a_large_group_uses_every_row(spark):
    rng = np.random.default_rng(3)
    big = np.concatenate([rng.gamma(2.0, 300.0, 16_000), np.full(8_000, 250.0)])  # a third of the rows are equal
    small = rng.normal(-50.0, 5.0, 40)
    rows = [(i, 1, float(v)) for i, v in enumerate(big)] + [(100_000 + i, 2, float(v)) for i, v in enumerate(small)]
    df = spark.createDataFrame(rows, "claim_key int, decile int, excess double").repartition(4)
    h = {r["decile"]: r["h"] for r in bandwidth(df).collect()}
    out = kde_at(df, density_cells(df)).toPandas()
    assert len(out) == len(rows)
    for group, values in ((1, big), (2, small)):
        got = out[out["decile"] == group].sort_values("claim_key").iloc[:: 60 if group == 1 else 1]
        np.testing.assert_allclose(got["density"], plain(got["excess"], values, h[group]), rtol=1e-10)


def test_density_of_odd_groups(spark):
    rows = [(1, 1, 5.0), (2, 1, 5.0), (3, 2, 1.0), (4, None, 1.0), (5, 3, 0.0), (6, 3, 10.0), (7, 3, None), (8, 3, float("nan"))]
    df = spark.createDataFrame(rows, "claim_key int, decile int, excess double")
    got = {r["claim_key"]: r["density"] for r in kde_at(df, density_cells(df)).collect()}
    assert [k for k, v in got.items() if v is None] and {k for k, v in got.items() if v is not None} == {5, 6}
    h = 0.9 * np.std([0.0, 10.0], ddof=1) * 2**-0.2
    np.testing.assert_allclose([got[5], got[6]], plain([0.0, 10.0], [0.0, 10.0], h), rtol=1e-12)
    empty = df.where("false")
    assert kde_at(empty, density_cells(empty)).count() == 0


def test_curve_far_from_all_values_is_zero(spark):
    df = spark.range(50).select(F.lit(0).alias("g"), F.col("id").cast("double").alias("v"))
    curve = kde_curve(df, "g", "v", 0.0, 1e6, points=3).orderBy("point").collect()
    assert curve[0]["density"] > 0 and [r["density"] for r in curve[1:]] == [0.0, 0.0]
