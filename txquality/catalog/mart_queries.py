"""Marts, profile and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from txquality.catalog import sql as Q
from txquality.catalog.registry import query
from txquality.functions import columns as C
from txquality.plans import marts
from txquality.sources import star_tables as st

_V = ", ".join(Q.V)


@query(
    "stg_transactions",
    f"with {Q.FULL} select row_uid as transaction_id, load_id, time as time_seconds, {_V}, amount, class as is_fraud from tx",
)
def stg_transactions(spark, sf_dir):
    return marts.staging(st.raw_full(spark, sf_dir))


@query(
    "transactions_clean",
    f"with {Q.FULL} select row_uid as transaction_id, load_id, time as time_seconds, {_V}, amount, class as is_fraud "
    "from tx where amount >= 0",
)
def transactions_clean(spark, sf_dir):
    return marts.clean(marts.staging(st.raw_full(spark, sf_dir)))


@query(
    "transactions_features",
    f"with {Q.FULL} select row_uid as transaction_id, load_id, time as time_seconds, {Q.HOUR} as hour_of_day, {_V}, "
    f"amount, {Q.rounded('ln(amount + 1)', 9)} as log_amount, {Q.BUCKET} as amount_bucket, class as is_fraud from tx where amount >= 0",
)
def transactions_features(spark, sf_dir):
    """The last bit of a logarithm differs between engines, so the compared column is rounded to nine places."""
    feats = marts.features_from_raw(st.raw_full(spark, sf_dir))
    return feats.withColumn("log_amount", C.rounded(F.col("log_amount"), 9))


@query(
    "hourly_fraud_summary",
    f"with {Q.CORE}, {Q.FEATS} select hour_of_day, count(*) as nb_transactions, sum(is_fraud)::bigint as nb_fraud, "
    f"{Q.rounded('sum(is_fraud)::double / count(*)::double', 6)} as fraud_rate, "
    f"{Q.rounded('avg(amount)', 2)} as avg_amount from feats group by 1 order by 1",
)
def hourly_fraud_summary(spark, sf_dir):
    return marts.hourly_summary(marts.features_from_raw(st.raw_core(spark, sf_dir)))


@query(
    "transaction_labels",
    f"""with {Q.CORE}, parts as (
      select id, (floor(time / 86400.0::double) + 1)::bigint as day, floor(time % 86400)::bigint as rest from tx)
    select id, 'TX-' || (case when length(cast(id as varchar)) >= 6 then cast(id as varchar)
                              else lpad(cast(id as varchar), 6, '0') end) as label,
           printf('J%d %02d:%02d:%02d', day, rest // 3600, (rest % 3600) // 60, rest % 60) as clock, day
    from parts""",
)
def transaction_labels(spark, sf_dir):
    return marts.labels(st.raw_core(spark, sf_dir))


@query(
    "dataset_profile",
    f"with {Q.CORE}, {Q.FEATS} select count(*) as row_count, sum(is_fraud)::bigint as fraud_count, "
    f"{Q.rounded('sum(is_fraud)::double / count(*)::double', 6)} as fraud_ratio, min(amount) as min_amount, "
    "max(amount) as max_amount, min(time_seconds) as min_time, max(time_seconds) as max_time, "
    "count(distinct load_id) as load_count, count(distinct transaction_id) as distinct_ids from feats",
)
def dataset_profile(spark, sf_dir):
    return marts.profile(marts.features_from_raw(st.raw_core(spark, sf_dir)))


@query(
    "bucket_distribution",
    f"with {Q.CORE}, {Q.FEATS} select amount_bucket, count(*) as row_count from feats group by 1",
)
def bucket_distribution(spark, sf_dir):
    return marts.bucket_distribution(marts.features_from_raw(st.raw_core(spark, sf_dir)))


@query(
    "class_ratio",
    f"with {Q.CORE}, {Q.FEATS} select count(*) as row_count, {Q.rounded('avg(is_fraud)', 9)} as positive_rate from feats",
)
def class_ratio(spark, sf_dir):
    return marts.class_ratio(marts.features_from_raw(st.raw_core(spark, sf_dir)))
