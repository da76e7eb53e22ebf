"""The same answer whatever the number of shuffle partitions and however hot a key is."""

import pytest
from pyspark.sql import functions as F

from claimsieve.operators import encode as E
from claimsieve.operators import rule as R
from claimsieve.operators.folds import stratified_kfold
from claimsieve.operators.profile import duplicate_rows
from claimsieve.plans.estimate import estimate_rule
from claimsieve.session import materialize
from claimsieve.sources.claims import history, order_claims


@pytest.fixture(scope="module")
def base(spark, sf_dir):
    return materialize(history(order_claims(spark, sf_dir)).select("claim_key", "payout", "excess"), "base")


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_labels_and_folds(base, partitions):
    results = []
    for n in (1, 4, 16):
        partitions(n)
        labelled = R.apply_rule(base, R.linear_rule(base))
        folds = stratified_kfold(labelled, "risk_class").select("claim_key", "risk_class", "fold")
        results.append(sorted(map(tuple, folds.collect())))
    assert results[0] == results[1] == results[2]


def test_estimate_is_whole_and_within_limits_or_says_so(base):
    est = estimate_rule(base)
    assert est.grid.count() == 60
    pick = est.pick.first()
    if pick.n_admissible:
        assert est.labels.count() == base.count()
        shares = {r.risk_class: r.pct for r in R.class_shares(est.labels).collect()}
        assert shares[0] >= 85 and shares[2] < 3
    else:
        assert pick.form is None and est.labels.count() == 0


@pytest.fixture(scope="module")
def hot(spark):
    """One sender holds a third of all rows and a third of all rows are copies."""
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 997)
    return spark.range(30000).select(key.alias("sender"), F.when(F.col("id") % 3 == 1, 5).otherwise(F.col("id")).alias("value"))


def test_hot_key_is_encoded_whole(hot):
    keys = {"sender": ["sender"]}
    dictionary = E.fit_frequencies(hot, hot.limit(0), keys)
    out = E.freq_encode(hot, dictionary, keys)
    assert out.count() == hot.count()
    assert out.where("sender = -1").select("sender_freq").distinct().first()[0] == 10000.0
    assert out.where("sender_freq is null").count() == 0


def test_duplicates_with_hot_copies(hot):
    row = duplicate_rows(hot, ["value"]).first()
    assert row.n_rows == 30000
    assert row.n_duplicates == 30000 - hot.select("value").distinct().count()


def test_frequency_scope(spark):
    a = spark.createDataFrame([("x",), ("x",), (None,)], "k string")
    b = spark.createDataFrame([("x",), ("y",)], "k string")
    got = {s: {r.key_value: r.n for r in E.fit_frequencies(a, b, {"k": ["k"]}, s).collect()} for s in ("union", "train")}
    assert got == {"union": {"x": 3, "y": 1}, "train": {"x": 2}}
