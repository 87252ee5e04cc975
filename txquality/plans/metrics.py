"""Gauges, text exposition, rates, latency quantiles and hold-time alerts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from txquality import schema as S
from txquality.operators import ranks, sequences

LATENCY_BUCKETS = [0.1, 0.5, 1.0]


def pending_share(pending: Column, threshold: Column) -> Column:
    return F.least(F.lit(100.0), F.round(pending / threshold * 100))


def gauges(status: DataFrame, drift_summary: DataFrame | None) -> DataFrame:
    """Long table of platform gauges.

    ``status`` has one row: dataset_rows, pending, threshold, running, last_success, last_epoch (the last two NULL
    without a finished run). ``drift_summary`` has one row, or is None when drift could not be computed.
    """
    pairs = [
        ("fraud_dataset_rows", F.col("dataset_rows")),
        ("fraud_pending_updates", F.col("pending")),
        ("fraud_update_threshold", F.col("threshold")),
        ("fraud_pending_share", pending_share(F.col("pending"), F.col("threshold"))),
        ("fraud_pipeline_running", F.col("running")),
        ("fraud_pipeline_last_run_success", F.col("last_success")),
        ("fraud_pipeline_last_run_timestamp_seconds", F.col("last_epoch")),
        ("fraud_drift_available", F.lit(0 if drift_summary is None else 1)),
    ]
    rows = _long(status, pairs)
    if drift_summary is not None:
        drift_pairs = [
            ("fraud_drift_max_psi", F.col("max_psi")),
            ("fraud_drift_threshold", F.col("psi_threshold")),
            ("fraud_drift_alert", F.col("alert").cast("int")),
            ("fraud_drift_recent_rows", F.col("recent_rows")),
        ]
        rows = rows.unionByName(
            _long(drift_summary, drift_pairs, [("fraud_drift_psi", "feature", c, F.col(f"psi_{c}")) for c in S.MONITORED])
        )
    return rows


def _long(df: DataFrame, pairs: list, labelled: list | None = None) -> DataFrame:
    none = F.create_map().cast("map<string,string>")
    rows = [
        F.struct(F.lit(n).alias("metric"), none.alias("labels"), v.cast("double").alias("value")) for n, v in pairs
    ] + [
        F.struct(
            F.lit(n).alias("metric"), F.create_map(F.lit(label), F.lit(lv)).alias("labels"), v.cast("double").alias("value")
        )
        for n, label, lv, v in (labelled or [])
    ]
    return df.select(F.inline(F.array(*rows))).filter(F.col("value").isNotNull())


def exposition_lines(gauge_rows: DataFrame) -> DataFrame:
    """``name{label="x"} value`` lines."""
    pairs = F.transform(
        F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))
    )
    inner = F.array_join(pairs, ",")
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), inner, F.lit("}"))).otherwise(F.lit(""))
    whole = F.col("value") == F.floor("value")
    number = F.when(whole, F.col("value").cast("long").cast("string")).otherwise(F.format_string("%.9f", "value"))
    return gauge_rows.select(F.concat("metric", labels, F.lit(" "), number).alias("line"))


# ---- alerts ---------------------------------------------------------------------------------------------------------


def alert_states(samples: DataFrame, series: list[str], second: str, active: Column, hold: int) -> DataFrame:
    """Alert state at every sample: inactive, pending, or firing once active for ``hold`` seconds without a break.

    One row per series and scrape interval is expected; a series is scanned day by day, what a day hands on is one row.
    """
    marked = sequences.islands(samples, series, second, active)
    state = (
        F.when(~F.col("active"), F.lit("inactive"))
        .when(F.col(second) - F.col("active_since") >= hold, F.lit("firing"))
        .otherwise(F.lit("pending"))
    )
    return marked.withColumn("state", state)


def alert_conditions() -> dict[str, Column]:
    """Conditions over wide samples with the gauge names as columns."""
    psi, limit = F.col("max_psi"), F.col("psi_threshold")
    return {
        "drift_high": psi >= limit,
        "drift_moderate": (psi >= S.PSI_MODERATE) & (psi < limit),
        "last_run_failed": F.col("last_run_success") == 0,
        "runs_stale": F.col("second") - F.col("last_run_epoch") > S.STALE_AFTER_SECONDS,
        "scoring_down": F.col("scoring_up") == 0,
        "platform_down": F.col("platform_up") == 0,
        "drift_unavailable": F.col("drift_available") == 0,
    }


def rule_rows(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, alert, on, hold) for every declared rule whose columns are present."""
    needs = {
        "drift_high": ["max_psi", "psi_threshold"],
        "drift_moderate": ["max_psi", "psi_threshold"],
        "last_run_failed": ["last_run_success"],
        "runs_stale": ["last_run_epoch"],
        "scoring_down": ["scoring_up"],
        "platform_down": ["platform_up"],
        "drift_unavailable": ["drift_available"],
    }
    active = [n for n in S.ALERT_RULES if all(c in samples.columns for c in needs[n])]
    conditions = alert_conditions()
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("alert"), conditions[n].alias("on"), F.lit(S.ALERT_RULES[n]).alias("hold"))
            for n in active
        ]
    )
    return samples.select(*keys, F.inline(rows))


def active_rules(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, alert, hold) for every sample and rule whose condition holds."""
    return rule_rows(samples, keys).filter("on").drop("on")


def all_alerts(samples: DataFrame, series: list[str]) -> DataFrame:
    """States of every declared rule whose columns are present: (series, second, alert, state)."""
    long = rule_rows(samples, [*series, "second"])
    marked = sequences.islands(long, [*series, "alert"], "second", F.col("on"))
    state = (
        F.when(~F.col("active"), F.lit("inactive"))
        .when(F.col("second") - F.col("active_since") >= F.col("hold"), F.lit("firing"))
        .otherwise(F.lit("pending"))
    )
    return marked.select(*series, "second", "alert", state.alias("state"))


# ---- rates and latency ----------------------------------------------------------------------------------------------


def requests_per_minute(requests: DataFrame) -> DataFrame:
    """Counts per handler and minute; the only pass over the request log, with partial aggregation."""
    minute = F.floor(F.col("second") / 60) * 60
    return requests.groupBy("handler", minute.alias("minute")).agg(
        F.count(F.lit(1)).alias("request_count"), F.count_if(F.col("status") >= 500).alias("error_count")
    )


def request_rate(requests: DataFrame) -> DataFrame:
    return requests_per_minute(requests).select("handler", "minute", (F.col("request_count") / F.lit(60.0)).alias("rate"))


def error_rate(requests: DataFrame, window_minutes: int = 5) -> DataFrame:
    """Server errors per second over the minutes up to each minute with traffic."""
    per_minute = requests_per_minute(requests)
    w = Window.partitionBy("handler").orderBy("minute").rangeBetween(-(window_minutes - 1) * 60, 0)
    return per_minute.select(
        "handler", "minute", (F.sum("error_count").over(w) / F.lit(window_minutes * 60.0)).alias("error_rate")
    )


def counter_increase(samples: DataFrame, series: list[str], second: str, value: str) -> DataFrame:
    """Increase and rate between neighbouring samples of a counter; a drop means it restarted from zero."""
    known = sequences.row_before(samples, series, second, [value, second], "_last")
    before, at = F.col("_last")[value], F.col("_last")[second]
    increase = F.when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return known.withColumns(
        {"increase": increase, "rate": F.try_divide(increase.cast("double"), (F.col(second) - at).cast("double"))}
    ).drop("_last")


def latency_histogram(requests: DataFrame, bounds: list[float] | None = None) -> DataFrame:
    """(handler, le_no, le, cumulative): cumulative counts per upper bound, the last bound open."""
    bounds = bounds or LATENCY_BUCKETS
    limits = [*bounds, math.inf]
    counts = requests.groupBy("handler").agg(
        *[F.count_if(F.col("latency") <= b).alias(f"b{i}") for i, b in enumerate(limits)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("le_no"), F.lit(b).alias("le"), F.col(f"b{i}").alias("cumulative"))
            for i, b in enumerate(limits)
        ]
    )
    return counts.select("handler", F.inline(rows))


def histogram_quantile(buckets: DataFrame, q: float, groups: list[str] | None = None) -> DataFrame:
    """Quantile by linear interpolation inside the bucket that holds the rank; the open bucket gives its lower bound."""
    groups = groups or ["handler"]
    w = Window.partitionBy(*groups).orderBy("le_no")
    framed = buckets.withColumns(
        {
            "total": F.max("cumulative").over(Window.partitionBy(*groups)),
            "below": F.coalesce(F.lag("cumulative").over(w), F.lit(0)),
            "lower": F.coalesce(F.lag("le").over(w), F.lit(0.0)),
        }
    )
    rank = F.col("total") * F.lit(q)
    hit = framed.filter((F.col("total") > 0) & (F.col("cumulative") >= rank))
    inside = F.col("lower") + (F.col("le") - F.col("lower")) * F.try_divide(
        rank - F.col("below"), (F.col("cumulative") - F.col("below")).cast("double")
    )
    value = F.when(F.col("le") == math.inf, F.col("lower")).otherwise(inside)
    return hit.groupBy(*groups).agg(F.min_by(value, "le_no").alias("quantile"))


def exact_latency(requests: DataFrame, q: float, groups: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Exact linear quantile per group from running counts; a group may hold any share of the rows."""
    groups = groups or ["handler"]
    counted = requests.select(*groups, "latency", F.lit(1).cast("long").alias("n"))
    running = ranks.running_totals(counted, "latency", ["n"], groups, buckets=buckets)
    position = (F.col("total_n") - 1) * F.lit(q)
    low = F.floor(position)
    high = F.least(low + 1, F.col("total_n") - 1)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("cum_n") > rank) & (F.col("cum_n") - F.col("n") <= rank), F.col("latency")))

    both = running.groupBy(*groups).agg(at(low).alias("a"), at(high).alias("b"), F.max(position - low).alias("t"))
    return both.select(*groups, (F.col("a") + (F.col("b") - F.col("a")) * F.col("t")).alias("quantile"))
