"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F


from claimsieve.catalog.common import hist, narrow
from claimsieve.catalog.registry import register
from claimsieve.catalog.sqltext import with_claims
from claimsieve.session import scratch_path
from claimsieve.sources import files
from claimsieve.sources.claims import order_claims


@register("load_claims", with_claims("select * from claims"))
def load_claims(spark, sf_dir):
    df = order_claims(spark, sf_dir)
    path = scratch_path(spark, "claims")
    files.write_table(df, path)
    return files.load(spark, path, df.schema)


CSV_COLUMNS = ["claim_key", "dataset", "claim_amount", "payout", "abnormal_reason", "overtime"]


@register("csv_roundtrip", with_claims("select " + ", ".join(CSV_COLUMNS) + " from claims"))
def csv_roundtrip(spark, sf_dir):
    df = order_claims(spark, sf_dir).select(*CSV_COLUMNS)
    path = scratch_path(spark, "csv")
    files.write_csv(df, path)
    return files.read_csv(spark, path, df.schema)


@register(
    "write_tables",
    with_claims(
        "select f.fmt, count(*) as n_written, count(*) as n_read, cast(0 as bigint) as n_different "
        "from hist, (values ('parquet'), ('csv'), ('json')) f(fmt) group by f.fmt"
    ),
)
def write_tables(spark, sf_dir):
    df = narrow(spark, sf_dir, "claim_key", "claim_amount", "payout", "abnormal_reason")
    out = None
    for fmt in ("parquet", "csv", "json"):
        path = scratch_path(spark, fmt)
        files.write_table(df, path, fmt)
        back = files.load(spark, path, df.schema, fmt)
        both = df.withColumn("w", F.lit(1)).unionByName(back.withColumn("w", F.lit(-1)))
        rows = both.groupBy(*df.columns).agg(F.sum("w").alias("w"), F.count_if(F.col("w") > 0).alias("written"))
        one = rows.agg(
            F.sum("written").alias("n_written"),
            F.sum(F.col("written") - F.col("w")).alias("n_read"),
            F.sum(F.abs("w")).alias("n_different"),
        ).select(F.lit(fmt).alias("fmt"), "n_written", "n_read", "n_different")
        out = one if out is None else out.unionByName(one)
    return out


@register(
    "preview",
    with_claims("select claim_key, route_type, claim_amount, payout from hist order by claim_key limit 30"),
)
def preview(spark, sf_dir):
    df = hist(spark, sf_dir).select("claim_key", "route_type", "claim_amount", "payout")
    return files.preview(df, 30, ["claim_key"])
