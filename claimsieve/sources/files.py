"""File sources and sinks: typed reads, CSV with a byte-order mark, one-row JSON configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimsieve.functions.expr import half_even

BOM = "﻿"


def load(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Read with a fixed schema; nothing is inferred, so no extra pass over the data."""
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return load(spark, path, schema, "csv")


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """Header row in every part file; with ``bom`` each part starts with the UTF-8 byte-order mark."""
    if bom:
        first = df.columns[0]
        df = df.withColumnRenamed(first, BOM + first)
    df.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    if fmt == "csv":
        write_csv(df, path)
        return
    df.write.mode("overwrite").partitionBy(*partition_by).format(fmt).save(path)


def write_bucketed(df: DataFrame, path: str, name: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Write a table divided and sorted by its join keys, register it as ``name``, and return it.

    Tables with equal keys and buckets join without a shuffle, as often as they are joined."""
    df.repartition(buckets, *keys).write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def save_config(config: DataFrame, path: str) -> None:
    """Write a one-row configuration (a frozen rule, a model setting) as JSON."""
    config.coalesce(1).write.mode("overwrite").json(path)


def load_config(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def preview(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First ``n`` rows in a stated order (a distributed top-n, no full sort)."""
    return df.orderBy(*order).limit(n)


def fill_template(template: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Fill the two result columns of a template; its other columns, rows and keys are left as they are.

    Refused with an error unless every template key is predicted exactly once and no other key is: a result with a row
    too many or too few must not be written.
    """
    wrong = key_mismatches(template, predictions, key).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("k")).first()
    if wrong["n"]:
        raise ValueError(f"{wrong['n']} keys of template and predictions do not match one to one, the first is {wrong['k']}")
    filled = predictions.select(
        key, half_even("payout_hat", 2).alias("payout"), risk_label("risk_class").alias("risk_label")
    )
    return template.drop("payout", "risk_label").join(filled, key, "left")


def key_mismatches(template: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """``(key, n_template, n_predicted)`` of keys that are null, absent on one side, or not predicted exactly once."""
    sides = template.select(key, F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(
        predictions.select(key, F.lit(0).alias("t"), F.lit(1).alias("p"))
    )
    counts = sides.groupBy(key).agg(F.sum("t").alias("n_template"), F.sum("p").alias("n_predicted"))
    return counts.where(F.col(key).isNull() | (F.col("n_template") == 0) | (F.col("n_predicted") != 1))


# The three class labels of the result table, for classes 0, 1 and 2.
RISK_LABELS = ("合理诉求", "诉求偏高", "严重超额")


def risk_label(col: str):
    return F.get(F.array(*[F.lit(x) for x in RISK_LABELS]), F.col(col))
