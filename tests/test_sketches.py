"""Mergeable sketches, rank correlation by missing pattern, tables written for joins, streams that go on after a stop."""

import math
import uuid

import pytest
from pyspark.sql import functions as F

from claimsieve.operators import profile as P
from claimsieve.operators import sketches as S
from claimsieve.operators.clean import clean
from claimsieve.operators.encode import attach_labels, fit_frequencies, freq_encode
from claimsieve.session import scratch_path
from claimsieve.sources.claims import order_claims
from claimsieve.sources.files import write_bucketed
from claimsieve.streaming.labels import claim_stream, feature_stream, write_labels


def test_distinct_sketches_add_up(spark):
    df = spark.range(60_000).select("id", (F.col("id") % 5000).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("b"), F.lit(None).cast("string").alias("c"))
    parts = S.distinct_sketches(df, ["a", "b", "c"], F.col("id") % 4)
    path = scratch_path(spark, "sketches")
    parts.where("part < 2").write.parquet(path)
    parts.where("part >= 2").write.mode("append").parquet(path)  # later parts are added
    got = {r["column_name"]: (r["n"], r["n_distinct"]) for r in S.merged_distinct(spark.read.parquet(path)).collect()}
    assert got["a"][0] == 60_000 and got["b"][0] == 30_000 and got["c"] == (0, 0)
    assert abs(got["a"][1] - 5000) < 4 * S.distinct_error() * 5000 and abs(got["b"][1] - 30_000) < 4 * S.distinct_error() * 30_000


def test_quantile_sketches_keep_their_rank_error(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"), (F.col("id") % 2).alias("g"))
    sketches = S.quantile_sketches(df, "v", ["g"], parts=8, items=200)
    for r in S.merged_quantiles(sketches, [0.1, 0.5, 0.98], ["g"]).collect():
        assert all(abs(q / 200_003 - p) < 2 * S.rank_error(200) for q, p in zip(r["qs"], (0.1, 0.5, 0.98)))


@pytest.mark.parametrize("target_gaps", [False, True])
def test_spearman_with_missing_values_equals_pandas(spark, target_gaps):
    rows = [(float(i * 37 % 101), None if i % 5 == 0 else float(i % 13), None if i % 5 == 0 else float(i % 7), math.nan if i % 11 == 0 else float(i * i % 17), None, 3.0) for i in range(300)]
    if target_gaps:
        rows = [(None if i % 9 == 0 else math.nan if i % 9 == 1 else r[0], *r[1:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "y double, a double, b double, c double, d double, e double")
    got = {r["column_name"]: r["rho"] for r in P.spearman(df, list("abcde"), "y").collect()}
    frame = df.toPandas()
    want = {c: frame[["y", c]].dropna().rank().corr().iloc[0, 1] for c in "abc"}
    assert set(got) == set("abce") and got["e"] is None
    assert all(got[c] == pytest.approx(want[c]) for c in "abc")
    assert [sorted(g) for g in P._missing_patterns(df.withColumnRenamed("y", "_y").where("_y is not null"), list("abc"))] == [["a", "b"], ["c"]]


def test_bucketed_tables_join_without_a_shuffle(spark):
    name = f"t{uuid.uuid4().hex}"
    left = write_bucketed(spark.range(500).select(F.col("id").alias("claim_key"), F.rand(1).alias("x")), scratch_path(spark, "left"), f"{name}_l", ["claim_key"], 4)
    right = write_bucketed(spark.range(100, 700).select(F.col("id").alias("claim_key"), (F.col("id") % 3).alias("risk_class")), scratch_path(spark, "right"), f"{name}_r", ["claim_key"], 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = attach_labels(left, right)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 400 and "Exchange" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for side in "lr":
            spark.sql(f"drop table {name}_{side}")


def test_feature_stream_goes_on_after_a_stop(spark, sf_dir):
    keys, default = {"start_city": ["start_city"], "city_pair": ["start_city", "end_city"]}, {"city_pair": 1.0}
    claims = order_claims(spark, sf_dir)
    dictionary = fit_frequencies(claims.where("dataset = 'history'"), claims, keys, "train")
    source, out, progress = (scratch_path(spark, x) for x in ("arriving", "features", "progress"))
    halves = [claims.where(F.col("claim_key") % 2 == k) for k in (0, 1)]
    for half in halves:  # the second half arrives while nothing runs
        half.repartition(3).write.mode("append").parquet(source)
        query = write_labels(feature_stream(claim_stream(spark, source, claims.schema, files_per_trigger=2), dictionary, keys, default), out, progress)
        query.awaitTermination()
        assert query.exception() is None
    got, want = spark.read.parquet(out), freq_encode(clean(claims), dictionary, keys, default)
    assert got.count() == want.count() > 0 and set(got.columns) == set(want.columns)
    assert got.select(want.columns).exceptAll(want).count() == 0
