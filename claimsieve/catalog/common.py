"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsieve.functions.expr import rounded
from claimsieve.session import materialize
from claimsieve.sources.claims import history, order_claims, scoring

LABEL_NUMERIC = [
    "claim_amount",
    "protect_amount",
    "overtime",
    "contact_delay",
    "start_volume",
    "start_accident_rate",
    "start_claim_ratio",
    "end_volume",
    "end_accident_rate",
    "end_claim_ratio",
    "goods_level",
    "start_city",
    "end_city",
]


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(order_claims(spark, sf_dir))


def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring(order_claims(spark, sf_dir))


def narrow(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Some columns of history written once, for reports that pass over them several times."""
    return materialize(hist(spark, sf_dir).select(*cols), "history")


def round_doubles(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column for comparison."""
    return df.select(
        *[
            rounded(F.col(f.name), special.get(f.name, digits)).alias(f.name)
            if f.dataType.simpleString() in ("double", "float")
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def raw_copy(df: DataFrame) -> DataFrame:
    """String-typed copy with one embedded row of variable names, the form in which raw claim sheets arrive."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    names = df.sparkSession.range(1).select(*[F.lit(c).alias(c) for c in df.columns])
    return text.unionByName(names)
