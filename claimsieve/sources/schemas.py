"""Fixed schemas of the claim tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Spreadsheet header of a raw claim table and the column it becomes here.
HEADER_NAMES = {
    "运单号": "claim_key",
    "线路类型": "route_type",
    "是否c2c": "is_c2c",
    "是否生鲜妥投及时": "is_fresh",
    "保价金额": "protect_amount",
    "始发城市": "start_city",
    "目的城市": "end_city",
    "寄件人id": "consigner_id",
    "收件人id": "receiver_id",
    "寄件是否内部": "is_internal",
    "配送超时时长": "overtime",
    "异常原因": "abnormal_reason",
    "进线渠道": "source_channel",
    "妥投到进线时长": "contact_delay",
    "索赔金额": "claim_amount",
    "商品类型": "goods_category",
    "新旧程度": "goods_level",
    "寄件B/C": "bc_source",
    "进线人身份": "customer_role",
    "始发网点发单量": "start_volume",
    "始发网点万单理赔率": "start_accident_rate",
    "始发网点赔付比例": "start_claim_ratio",
    "目的网点发单量": "end_volume",
    "目的网点万单理赔率": "end_accident_rate",
    "目的网点赔付比例": "end_claim_ratio",
    "实际赔付金额": "payout",
}

NUMERIC = [
    "protect_amount",
    "overtime",
    "contact_delay",
    "claim_amount",
    "start_volume",
    "start_accident_rate",
    "start_claim_ratio",
    "end_volume",
    "end_accident_rate",
    "end_claim_ratio",
]
CATEGORICAL = [
    "route_type",
    "is_c2c",
    "is_fresh",
    "is_internal",
    "abnormal_reason",
    "source_channel",
    "goods_category",
    "goods_level",
    "bc_source",
    "customer_role",
]
IDS = ["start_city", "end_city", "consigner_id", "receiver_id"]


def raw_schema(with_payout: bool, with_key: bool = True) -> T.StructType:
    """All columns as strings: an embedded header row makes every column textual."""
    names = [n for n in HEADER_NAMES.values() if (with_payout or n != "payout") and (with_key or n != "claim_key")]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def rename_headers(df: DataFrame) -> DataFrame:
    """Rename the spreadsheet headers that are present to the column names used here."""
    return df.withColumnsRenamed({k: v for k, v in HEADER_NAMES.items() if k in df.columns})
