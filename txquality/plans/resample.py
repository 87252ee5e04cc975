"""Synthetic rows: bootstrap from a baseline, optional drift, and a schema-true fixture.

All randomness is a function of seed and draw number, so a repeated or partly repeated job gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from txquality import schema as S
from txquality.functions import columns as C
from txquality.operators import ranks


def bootstrap(base: DataFrame, draws: DataFrame, base_rows: int, seed: int) -> DataFrame:
    """One baseline row, drawn with replacement, per ``draw_id``. ``base`` has ``base_rows`` rows with distinct ids of zero or more.

    Rows are numbered in the order of their ids first, so gaps in the ids lose no draw. Drawn numbers are uniform, so the join
    is even however skewed the data are.
    """
    pick = F.floor(C.uniform(seed, "pick", F.col("draw_id")) * F.lit(float(base_rows)))
    numbered = ranks.dense_index(base, "id", "_number")
    return draws.select("draw_id", pick.alias("_number")).join(numbered, "_number").drop("_number")


def drifted(
    rows: DataFrame, intensity: str, seed: int, base_fraud_rate: float, base_max_time: float
) -> DataFrame:
    """Perturb bootstrapped rows: later day at the same hour, scaled amounts, more fraud, shifted components."""
    p = S.DRIFT_INTENSITY[intensity]
    draw = F.col("draw_id")
    first_day = math.ceil(base_max_time / S.SECONDS_PER_DAY) * S.SECONDS_PER_DAY
    low, high = S.AMOUNT_JITTER
    jitter = F.lit(low) + F.lit(high - low) * C.uniform(seed, "amount", draw)
    rate = min(base_fraud_rate * p["fraud_multiplier"], S.FRAUD_RATE_CAP)
    present = [v for v in S.V_COLUMNS if v in rows.columns]

    def shifted(v: str):
        if not p["v_shift"]:
            return F.col(v)
        return F.col(v) + F.lit(p["v_shift"]) * C.standard_normal(seed, v, draw)

    return rows.select(
        "draw_id",
        F.col("id").alias("source_id"),
        (F.lit(float(first_day)) + F.col("time") % F.lit(S.SECONDS_PER_DAY)).alias("time"),
        *[shifted(v).alias(v) for v in present],
        F.greatest(F.lit(0.0), F.col("amount") * F.lit(p["amount_scale"]) * jitter).alias("amount"),
        (C.uniform(seed, "label", draw) < F.lit(rate)).cast("long").alias("is_fraud"),
    )


def synthetic_rows(base: DataFrame, draws: DataFrame, intensity: str, seed: int) -> DataFrame:
    """Bootstrap and drift; size, fraud rate and time span of the baseline come from one aggregation."""
    facts = base.agg(
        F.count(F.lit(1)).alias("n"), F.avg("is_fraud").alias("rate"), F.max("time").alias("last")
    ).first()
    rows = bootstrap(base, draws, facts["n"], seed)
    return drifted(rows, intensity, seed, facts["rate"], facts["last"])


def fixture_rows(spark: SparkSession, rows: int = 500, fraud_share: float = 0.05, seed: int = 42, span: int = 172_792) -> DataFrame:
    """Rows with the raw schema for tests: exact fraud share, uniform times, normal components, exponential amounts."""
    ids = spark.range(rows).withColumn("_all", F.lit(0)).withColumn("_hash", C.hash32(seed, "class", F.col("id")))
    chosen = ranks.smallest_per_class(ids, "_all", "_hash", "id", {0: int(rows * fraud_share)})
    return ids.select(
        "id",
        F.floor(C.uniform(seed, "time", F.col("id")) * span).cast("double").alias("time"),
        *[C.standard_normal(seed, v, F.col("id")).alias(v) for v in S.V_COLUMNS],
        C.rounded(F.lit(-80.0) * F.ln(C.uniform(seed, "amount", F.col("id"))), 2).alias("amount"),
        chosen.cast("long").alias("class"),
    )
