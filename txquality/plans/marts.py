"""Staging, clean, features and the hourly summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from txquality import schema as S
from txquality.functions import columns as C


def staging(raw: DataFrame) -> DataFrame:
    """Rename the raw columns to contract names; components pass through when present."""
    present = [v for v in S.V_COLUMNS if v in raw.columns]
    return raw.select(
        F.col("row_uid").alias("transaction_id"),
        "load_id",
        F.col("time").alias("time_seconds"),
        *present,
        "amount",
        F.col("class").alias("is_fraud"),
    )


def clean(stg: DataFrame) -> DataFrame:
    """Rows with a non-negative amount; NULL amounts drop out, NaN stays."""
    return stg.filter(F.col("amount") >= 0)


def with_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "hour_of_day": C.hour_of_day(F.col("time_seconds")),
            "log_amount": C.log_amount(F.col("amount")),
            "amount_bucket": C.amount_bucket(F.col("amount")),
        }
    )


def features(cleaned: DataFrame) -> DataFrame:
    present = [v for v in S.V_COLUMNS if v in cleaned.columns]
    return with_features(cleaned).select(
        "transaction_id",
        "load_id",
        "time_seconds",
        "hour_of_day",
        *present,
        "amount",
        "log_amount",
        "amount_bucket",
        "is_fraud",
    )


def features_from_raw(raw: DataFrame) -> DataFrame:
    return features(clean(staging(raw)))


def hourly_summary(feats: DataFrame) -> DataFrame:
    """One row per hour. Partial aggregation leaves at most 24 rows per task to shuffle."""
    total, fraud = F.count(F.lit(1)), F.sum("is_fraud")
    return (
        feats.groupBy("hour_of_day")
        .agg(
            total.alias("nb_transactions"),
            fraud.alias("nb_fraud"),
            C.rounded(F.try_divide(fraud.cast("double"), total.cast("double")), 6).alias("fraud_rate"),
            C.rounded(F.avg("amount"), 2).alias("avg_amount"),
        )
        .orderBy("hour_of_day")
    )


def labels(raw: DataFrame) -> DataFrame:
    """Display labels of every row."""
    return raw.select(
        "id",
        C.transaction_label(F.col("id")).alias("label"),
        C.clock_label(F.col("time")).alias("clock"),
        (F.floor(F.col("time") / F.lit(float(S.SECONDS_PER_DAY))) + 1).alias("day"),
    )


def profile(feats: DataFrame) -> DataFrame:
    """One-row profile of the features table. Distinct counts are queries of their own: together with the other
    aggregates in one they would send every row through the shuffle once per count."""
    fraud = F.sum("is_fraud")

    def distinct(name: str):
        return feats.filter(F.col(name).isNotNull()).select(name).distinct().agg(F.count(F.lit(1))).scalar()

    return feats.agg(
        F.count(F.lit(1)).alias("row_count"),
        fraud.alias("fraud_count"),
        C.rounded(fraud.cast("double") / F.count(F.lit(1)), 6).alias("fraud_ratio"),
        F.min("amount").alias("min_amount"),
        F.max("amount").alias("max_amount"),
        F.min("time_seconds").alias("min_time"),
        F.max("time_seconds").alias("max_time"),
    ).select("*", distinct("load_id").alias("load_count"), distinct("transaction_id").alias("distinct_ids"))


def bucket_distribution(feats: DataFrame) -> DataFrame:
    return feats.groupBy("amount_bucket").agg(F.count(F.lit(1)).alias("row_count"))


def class_ratio(feats: DataFrame) -> DataFrame:
    return feats.agg(
        F.count(F.lit(1)).alias("row_count"),
        C.rounded(F.avg("is_fraud"), 9).alias("positive_rate"),
    )
