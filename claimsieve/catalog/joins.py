"""Queries over the keyed lookups and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimsieve.catalog.common import hist, round_doubles, score
from claimsieve.catalog.registry import register
from claimsieve.catalog.sqltext import SCORE, with_claims
from claimsieve.operators import encode as E
from claimsieve.operators.clean import fill_categorical
from claimsieve.session import scratch_path
from claimsieve.sources.claims import order_claims
from claimsieve.sources.files import write_bucketed
from claimsieve.sources.schemas import CATEGORICAL, IDS

SINGLE = {c: [c] for c in [*IDS, "abnormal_reason", "goods_category"]}
PAIR = {"city_pair": ["start_city", "end_city"]}


def _encode(spark, sf_dir, keys, default=None):
    claims = fill_categorical(order_claims(spark, sf_dir), {"abnormal_reason": "NoReport"})
    cols = sorted({c for group in keys.values() for c in group})
    claims = claims.select("claim_key", "dataset", *cols)
    train, target = claims.where("dataset = 'history'"), claims.where("dataset = 'scoring'")
    dictionary = E.fit_frequencies(train, target, keys)
    out = E.freq_encode(claims, dictionary, keys, default)
    return out.select("claim_key", *[f"{k}_freq" for k in keys])


@register(
    "freq_encode",
    with_claims(
        "select claim_key, "
        + ", ".join(f"cast(count(*) over (partition by {c}) as double) as {c}_freq" for c in SINGLE)
        + " from claims"
    ),
)
def freq_encode(spark, sf_dir):
    return _encode(spark, sf_dir, SINGLE)


@register(
    "pair_freq_encode",
    with_claims(
        "select claim_key, cast(count(*) over (partition by start_city, end_city) as double) as city_pair_freq from claims"
    ),
)
def pair_freq_encode(spark, sf_dir):
    return _encode(spark, sf_dir, PAIR, {"city_pair": 1.0})


def _drift_one(c: str) -> str:
    return f"""select '{c}' as column_name, value, round(coalesce(pa, 0), 6) as pct_a, round(coalesce(pb, 0), 6) as pct_b,
  round(coalesce(pb, 0) - coalesce(pa, 0), 6) as diff_points
from (select cast({c} as varchar) as value, 100.0::double * count(*) / sum(count(*)) over () as pa from hist group by 1) a
full outer join (select cast({c} as varchar) as vb, 100.0::double * count(*) / sum(count(*)) over () as pb
  from score group by 1) b on a.value is not distinct from b.vb"""


@register(
    "category_drift",
    with_claims(
        " union all ".join(
            _drift_one(c).replace("value, round", "coalesce(value, vb) as value, round", 1) for c in CATEGORICAL
        ),
        SCORE,
    ),
)
def category_drift(spark, sf_dir):
    return round_doubles(E.drift(hist(spark, sf_dir), score(spark, sf_dir), CATEGORICAL))


@register(
    "unseen_ids",
    with_claims(
        " union all ".join(
            f"select '{c}' as column_name, (select count(distinct {c}) from hist) as n_a, "
            f"(select count(distinct {c}) from score) as n_b, (select count(*) from (select distinct {c} from score "
            f"except select {c} from hist)) as n_unseen"
            for c in IDS
        ),
        SCORE,
    ),
)
def unseen_ids(spark, sf_dir):
    return E.unseen(hist(spark, sf_dir), score(spark, sf_dir), IDS)


@register(
    "key_difference",
    with_claims("select receiver_id from score except select receiver_id from hist", SCORE),
)
def key_difference(spark, sf_dir):
    return E.key_difference(hist(spark, sf_dir), score(spark, sf_dir), "receiver_id")


@register(
    "key_union",
    with_claims("select goods_category from hist union select goods_category from score", SCORE),
)
def key_union(spark, sf_dir):
    return E.key_levels(hist(spark, sf_dir), score(spark, sf_dir), "goods_category")


@register(
    "concat_values",
    with_claims("select start_city from hist union all select start_city from score", SCORE),
)
def concat_values(spark, sf_dir):
    return E.concat_values(hist(spark, sf_dir), score(spark, sf_dir), "start_city")


@register(
    "concat_tables",
    with_claims(
        "select 'claim' as measure, count(*) as n, round(avg(claim_amount), 4) as mean_claim, null::double as total_payout "
        "from score union all select 'payout', count(*), null, round(sum(payout), 2) from hist",
        SCORE,
    ),
)
def concat_tables(spark, sf_dir):
    a = score(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.avg("claim_amount").alias("mean_claim"))
    b = hist(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum("payout").alias("total_payout"))
    out = E.concat_tables(a.withColumn("measure", F.lit("claim")), b.withColumn("measure", F.lit("payout")))
    return round_doubles(out, mean_claim=4, total_payout=2)


LABEL_JOIN = with_claims(
    "select claim_key, claim_amount, cast(case when excess <= payout then 0 when excess <= 2 * payout then 1 else 2 end "
    "as int) as risk_class from hist"
)


@register("bucketed_label_join", LABEL_JOIN)
def bucketed_label_join(spark, sf_dir):
    """The label join over two tables that are written by claim key, so neither side is shuffled."""
    claims = hist(spark, sf_dir)
    u, p = F.col("excess"), F.col("payout")
    labels = claims.select("claim_key", F.when(u <= p, 0).when(u <= 2 * p, 1).otherwise(2).alias("risk_class"))
    sides = []
    for label, df in (("features", claims.select("claim_key", "claim_amount")), ("labels", labels)):
        path = scratch_path(spark, label)
        sides.append(write_bucketed(df, path, "claimsieve_" + path.rpartition("/")[2].replace("-", "_"), ["claim_key"], 16))
    return E.attach_labels(*sides)


@register("label_join", LABEL_JOIN)
def label_join(spark, sf_dir):
    claims = hist(spark, sf_dir)
    u, p = F.col("excess"), F.col("payout")
    labels = claims.select("claim_key", F.when(u <= p, 0).when(u <= 2 * p, 1).otherwise(2).alias("risk_class"))
    return E.attach_labels(claims.select("claim_key", "claim_amount"), labels)
