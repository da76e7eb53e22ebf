"""The claims table, derived from the order tables.

One claim per order: claimed = sum of price * (discount + tax), paid = sum of price * discount.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """27-column claims table; the join strategy of every side is left to Catalyst and its runtime sizes.

    The two one-letter line codes are compared by their code point: a string in an aggregation buffer would turn the
    hash aggregation of all lines into a sort.
    """
    lineitem = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    lines = (
        lineitem.groupBy(F.col("l_orderkey").alias("k"))
        .agg(
            F.min("l_suppkey").alias("sk"),
            F.max("l_suppkey").alias("sk2"),
            F.min("l_partkey").alias("pk"),
            F.min(F.ascii("l_returnflag")).alias("rf"),
            F.min(F.ascii("l_linestatus")).alias("ls"),
            F.max("l_shipdate").alias("smax"),
            F.min("l_shipdate").alias("smin"),
            F.round(F.sum(price * (F.col("l_discount") + F.col("l_tax"))), 4).alias("c"),
            F.round(F.sum(price * F.col("l_discount")), 4).alias("p"),
        )
        .where((F.col("p") > 0) & (F.col("c") > F.col("p")))
    )
    volume = lineitem.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("disc")
    )
    branch = table(spark, sf_dir, "supplier").join(volume, F.col("s_suppkey") == F.col("l_suppkey"))

    def side(prefix: str, city: bool) -> DataFrame:
        cols = [
            F.col("s_suppkey").alias(f"{prefix}_key"),
            F.col("n").alias(f"{prefix}_volume"),
            F.col("s_acctbal").alias(f"{prefix}_accident_rate"),
            F.col("disc").alias(f"{prefix}_claim_ratio"),
        ]
        return branch.select(*cols, *([F.col("s_nationkey").alias("start_city")] if city else []))

    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    key = F.col("k")
    return (
        lines.join(orders, key == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(side("start", True), F.col("sk") == F.col("start_key"))
        .join(side("end", False), F.col("sk2") == F.col("end_key"))
        .join(part, F.col("pk") == F.col("p_partkey"))
        .select(
            key.alias("claim_key"),
            F.when(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"), "history")
            .otherwise("scoring")
            .alias("dataset"),
            F.col("o_orderpriority").alias("route_type"),
            (key % 4 == 0).cast("int").alias("is_c2c"),
            (key % 17 == 0).cast("int").alias("is_fresh"),
            F.col("c_acctbal").alias("protect_amount"),
            "start_city",
            F.col("c_nationkey").alias("end_city"),
            F.col("sk").alias("consigner_id"),
            F.col("o_custkey").alias("receiver_id"),
            F.when(key % 100 == 0, 0).when(key % 14 == 0, 1).otherwise(-1).alias("is_internal"),
            F.least(F.datediff("smax", "o_orderdate"), F.lit(500)).alias("overtime"),
            F.nullif(F.char("rf"), F.lit("N")).alias("abnormal_reason"),
            F.when(key % 119 != 0, F.col("c_mktsegment")).alias("source_channel"),
            F.datediff("smin", "o_orderdate").alias("contact_delay"),
            F.col("p_type").alias("goods_category"),
            F.when(key % 3 == 0, -1).when(key % 29 == 0, 1).otherwise(0).alias("goods_level"),
            F.col("o_orderstatus").alias("bc_source"),
            F.char("ls").alias("customer_role"),
            "start_volume",
            "start_accident_rate",
            "start_claim_ratio",
            "end_volume",
            "end_accident_rate",
            "end_claim_ratio",
            F.col("c").alias("claim_amount"),
            F.col("p").alias("payout"),
        )
    )


def with_excess(df: DataFrame) -> DataFrame:
    return df.withColumn("excess", F.col("claim_amount") - F.col("payout"))


def history(claims: DataFrame) -> DataFrame:
    """Claims with a known payout, with ``excess`` = claimed - paid."""
    return with_excess(claims.where(F.col("dataset") == "history"))


def scoring(claims: DataFrame) -> DataFrame:
    """Claims to be scored; their payout is dropped."""
    return claims.where(F.col("dataset") == "scoring").drop("payout")
