"""SQL fragments shared by the oracle queries: the same mapping of the given tables, written for DuckDB."""

from __future__ import annotations

V = [f"v{i}" for i in range(1, 29)]

CLASS = "(case when event_type = 'error' and cast(props->>'$.k' as integer) >= 90 then 1 else 0 end)::bigint"
LOAD = "'load-' || cast(cast(ts as date) as varchar)"

CORE = f"""tx as (
  select event_id as id, (epoch_us(ts) - (select min(epoch_us(ts)) from events)) / 1e6::double as time,
         value as amount, {CLASS} as class, {LOAD} as load_id,
         sha256({LOAD} || ':' || cast(event_id as varchar)) as row_uid
  from events)"""

FULL = f"""core as (
  select event_id as id, (epoch_us(ts) - (select min(epoch_us(ts)) from events)) / 1e6::double as time,
         value as amount, {CLASS} as class, {LOAD} as load_id,
         sha256({LOAD} || ':' || cast(event_id as varchar)) as row_uid,
         event_id % (select count(*) from embeddings) as pick
  from events),
tx as (
  select id, time, {", ".join(" + ".join(f"embedding[{k}]::double" for k in range(i, 65, 28)) + f" as v{i}" for i in range(1, 29))},
         amount, class, load_id, row_uid
  from core join embeddings on vec_id = pick)"""

HOUR = "floor((time % 86400) / 3600.0::double)::integer"
BUCKET = (
    "case when amount = 0 then 'zero' when amount < 10 then 'low' when amount < 100 then 'medium' "
    "when amount < 1000 then 'high' else 'very_high' end"
)

FEATS = f"""feats as (
  select id, row_uid as transaction_id, load_id, time as time_seconds, {HOUR} as hour_of_day, amount,
         ln(amount + 1) as log_amount, {BUCKET} as amount_bucket, class as is_fraud
  from tx where amount >= 0)"""

INBOUND = f"""inbound as (
  select l_orderkey as order_key, l_linenumber::bigint as line_number, l_partkey as part_key, l_suppkey as supp_key,
         cast(l_shipdate as date) as batch_day, (l_orderkey - 3)::double as time,
         l_tax as v1, case when l_linenumber < 7 then l_discount end as v2,
         {", ".join(f"l_quantity / {i}::double as v{i}" for i in range(3, 29))},
         l_extendedprice - 950.0::double as amount,
         (case when l_returnflag = 'R' then null when l_linenumber = 5 then 2 else 0 end)::bigint as is_fraud
  from lineitem)"""

SCORED = f"""scored as (
  select event_id as id, user_id, {LOAD} as load_id, {CLASS} as label,
         floor((cast(props->>'$.k' as double) / 100.0::double * 0.5::double
                + least(value / 500.0::double, 1.0::double) * 0.25::double
                + case when event_type = 'error' then 0.25::double else 0.0::double end) * 2000.0::double)
         / 2000.0::double as score
  from events)"""


def rounded(expr: str, digits: int) -> str:
    factor = float(10**digits)
    return f"round(({expr}) * {factor}::double) / {factor}::double"
