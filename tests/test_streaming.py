from claimsieve.operators.rule import apply_rule, linear_rule
from claimsieve.session import materialize, scratch_path
from claimsieve.sources.claims import history, order_claims
from claimsieve.streaming.labels import claim_stream, label_stream, write_labels


def test_stream_equals_batch(spark, sf_dir):
    claims = history(order_claims(spark, sf_dir)).select("claim_key", "claim_amount", "payout", "excess")
    source = scratch_path(spark, "arriving")
    claims.drop("excess").repartition(5).write.parquet(source)
    rule = materialize(linear_rule(claims), "rule")
    stream = claim_stream(spark, source, claims.drop("excess").schema, files_per_trigger=2)
    out = scratch_path(spark, "labels")
    query = write_labels(label_stream(stream, rule), out, scratch_path(spark, "progress"))
    query.awaitTermination()
    assert query.exception() is None
    got = spark.read.parquet(out).select("claim_key", "risk_class")
    want = apply_rule(claims, rule).select("claim_key", "risk_class")
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0
