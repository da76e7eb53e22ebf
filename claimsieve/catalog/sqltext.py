"""Common table expressions of the SQL counterparts."""

from __future__ import annotations

CLAIMS = """
li as (
  select l_orderkey k, min(l_suppkey) sk, max(l_suppkey) sk2, min(l_partkey) pk,
         min(l_returnflag) rf, min(l_linestatus) ls, max(l_shipdate) smax, min(l_shipdate) smin,
         round(sum(l_extendedprice*(l_discount+l_tax)),4) c, round(sum(l_extendedprice*l_discount),4) p
  from lineitem group by l_orderkey),
sup as (select l_suppkey s, count(*) n, round(avg(l_discount),6) disc from lineitem group by l_suppkey),
claims as (
select k as claim_key,
  case when o_orderdate < timestamp '2000-01-01 00:00:00' then 'history' else 'scoring' end as dataset,
  o_orderpriority as route_type,
  cast(case when k%4=0 then 1 else 0 end as int) as is_c2c,
  cast(case when k%17=0 then 1 else 0 end as int) as is_fresh,
  c_acctbal as protect_amount, a.s_nationkey as start_city, c_nationkey as end_city,
  li.sk as consigner_id, o_custkey as receiver_id,
  cast(case when k%100=0 then 0 when k%14=0 then 1 else -1 end as int) as is_internal,
  cast(least(datediff('day',o_orderdate,smax),500) as int) as overtime,
  nullif(rf,'N') as abnormal_reason,
  case when k%119=0 then null else c_mktsegment end as source_channel,
  cast(datediff('day',o_orderdate,smin) as int) as contact_delay, p_type as goods_category,
  cast(case when k%3=0 then -1 when k%29=0 then 1 else 0 end as int) as goods_level,
  o_orderstatus as bc_source, ls as customer_role,
  s1.n as start_volume, a.s_acctbal as start_accident_rate, s1.disc as start_claim_ratio,
  s2.n as end_volume, b.s_acctbal as end_accident_rate, s2.disc as end_claim_ratio,
  c as claim_amount, p as payout
from li join orders on k=o_orderkey join customer on o_custkey=c_custkey
  join supplier a on li.sk=a.s_suppkey join supplier b on li.sk2=b.s_suppkey
  join part on li.pk=p_partkey join sup s1 on s1.s=li.sk join sup s2 on s2.s=li.sk2
where p>0 and c>p)"""

HIST = "hist as (select *, claim_amount - payout as excess from claims where dataset='history')"
SCORE = "score as (select * exclude (payout) from claims where dataset='scoring')"


def with_claims(body: str, *ctes: str) -> str:
    """``WITH claims, hist, <ctes> <body>``."""
    return "with " + ",\n".join([CLAIMS, HIST, *[c.strip().rstrip(",") for c in ctes]]) + "\n" + body.strip()


def qcut_cte(name: str, src: str, col: str, k: int, out: str = "bin") -> str:
    """``name``: ``src`` with right-closed equal-frequency bins, numbered from 0 after dropping equal edges."""
    probs = ", ".join(repr(i / k) for i in range(k + 1))
    return f"""
{name}_edges as (select list_distinct(quantile_cont({col}, [{probs}])) as e from {src}),
{name}_inner as (select list_filter(e, lambda x: x > list_min(e) and x < list_max(e)) as e from {name}_edges),
{name} as (select {src}.*, cast(len(list_filter({name}_inner.e, lambda x: x < {col})) as int) as {out}
  from {src}, {name}_inner)"""
