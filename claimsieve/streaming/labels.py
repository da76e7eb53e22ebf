"""Labelling arriving claim files.  Cleaning and the rule are row-local, so the batch operators run unchanged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from claimsieve.operators.clean import clean
from claimsieve.operators.encode import freq_encode
from claimsieve.operators.rule import apply_rule


def claim_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def feature_stream(claims: DataFrame, dictionary: DataFrame, keys: dict[str, Sequence[str]], default: dict[str, float] | None = None) -> DataFrame:
    """Cleaned claims with their keyed frequencies: every arriving claim is looked up in the frozen dictionary (a static
    table), so nothing is kept between batches and a restart goes on after the last finished batch."""
    return freq_encode(clean(claims), dictionary, keys, default)


def label_stream(claims: DataFrame, rule: DataFrame) -> DataFrame:
    """Append-only labels under a frozen rule; no state is kept."""
    scored = claims.withColumn("excess", F.col("claim_amount") - F.col("payout"))
    return apply_rule(scored, rule)


def write_labels(labels: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process everything available, then stop.  ``checkpoint`` must be a folder every executor can reach."""
    return (
        labels.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
