"""Classifier evaluation from (score, label) rows, overall or per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from txquality import schema as S
from txquality.functions import columns as C
from txquality.operators import ranks


def confusion(df: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    said = F.col(score) >= F.lit(threshold)
    fraud = F.col(label) == 1
    tp, fp = F.count_if(said & fraud), F.count_if(said & ~fraud)
    tn, fn = F.count_if(~said & ~fraud), F.count_if(~said & fraud)
    return with_rates(
        df.agg(
            tp.alias("true_positives"),
            fp.alias("false_positives"),
            tn.alias("true_negatives"),
            fn.alias("false_negatives"),
        ).withColumn("threshold", F.lit(float(threshold)))
    )


def with_rates(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return df.withColumns(
        {
            "precision": C.ratio_or_zero(tp, tp + fp),
            "recall": C.ratio_or_zero(tp, tp + fn),
            "f1": C.ratio_or_zero(2 * tp, 2 * tp + fp + fn),
        }
    )


def curve(
    df: DataFrame, score: str = "score", label: str = "label", groups: list[str] | None = None, buckets: int | None = None
) -> DataFrame:
    """One row per distinct score, from the highest down: counts at the threshold and running counts."""
    groups = groups or []
    marked = df.select(
        *groups,
        F.col(score).alias("score"),
        (F.col(label) == 1).cast("long").alias("pos"),
        (F.col(label) != 1).cast("long").alias("neg"),
    )
    return ranks.running_totals(marked, "score", ["pos", "neg"], groups, descending=True, buckets=buckets)


def _recall() -> Column:
    """Recall at a point; one when there is no positive row at all."""
    return F.when(F.col("total_pos") > 0, F.col("cum_pos") / F.col("total_pos")).otherwise(F.lit(1.0))


def pr_points(points: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Precision and recall at every distinct score."""
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return points.select(
        *(groups or []),
        "score",
        tp.alias("tp"),
        fp.alias("fp"),
        C.ratio_or_zero(tp, tp + fp).alias("precision"),
        _recall().alias("recall"),
    )


def _average_precision() -> Column:
    step = F.col("pos").cast("double") / F.col("total_pos") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    return F.coalesce(F.sum(F.when(F.col("total_pos") > 0, step)), F.lit(0.0))


def _roc_auc() -> Column:
    """Area by trapezoids between neighbouring thresholds, tied scores together; NULL with one class only."""
    tp_before = F.col("cum_pos") - F.col("pos")
    area = F.col("neg").cast("double") * (tp_before + F.col("cum_pos")).cast("double") / 2
    return F.try_divide(F.sum(area), F.max(F.col("total_pos").cast("double") * F.col("total_neg").cast("double")))


def _f1_at_point() -> Column:
    p = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    r = _recall()
    return 2 * p * r / (p + r + F.lit(S.F1_EPSILON))


def areas(points: DataFrame, groups: list[str] | None = None) -> DataFrame:
    aggs = [_average_precision().alias("pr_auc"), _roc_auc().alias("roc_auc")]
    return points.groupBy(*groups).agg(*aggs) if groups else points.agg(*aggs)


def best_threshold(points: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Score with the highest F1; the lowest one on ties; 0.5 for an empty input."""
    chosen = F.max_by("score", F.struct(F.col("f1"), -F.col("score")))
    scored = points.withColumn("f1", _f1_at_point())
    aggs = [F.coalesce(chosen, F.lit(0.5)).alias("threshold"), F.max("f1").alias("f1")]
    return scored.groupBy(*groups).agg(*aggs) if groups else scored.agg(*aggs)


def metrics(
    df: DataFrame,
    score: str = "score",
    label: str = "label",
    groups: list[str] | None = None,
    threshold: float | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """PR-AUC, ROC-AUC, threshold, confusion counts and rates in one row (per group).

    Everything comes from one pass over the curve: the chosen threshold is one of its points, so its running counts are
    the confusion counts. With a given threshold the counts are taken at the lowest score not below it.
    """
    groups = groups or []
    points = curve(df, score, label, groups, buckets)
    state = F.struct("score", "cum_pos", "cum_neg")
    if threshold is None:
        pick = F.max_by(state, F.struct(_f1_at_point(), -F.col("score")))
    else:
        pick = F.min_by(F.when(F.col("score") >= threshold, state), F.when(F.col("score") >= threshold, F.col("score")))
    aggs = [
        _average_precision().alias("pr_auc"),
        _roc_auc().alias("roc_auc"),
        pick.alias("_at"),
        F.max("total_pos").alias("_pos"),
        F.max("total_neg").alias("_neg"),
    ]
    one = points.groupBy(*groups).agg(*aggs) if groups else points.agg(*aggs)
    tp, fp = F.coalesce(F.col("_at.cum_pos"), F.lit(0)), F.coalesce(F.col("_at.cum_neg"), F.lit(0))
    used = F.lit(float(threshold)) if threshold is not None else F.coalesce(F.col("_at.score"), F.lit(0.5))
    counted = one.select(
        *groups,
        "pr_auc",
        "roc_auc",
        used.alias("threshold"),
        tp.alias("true_positives"),
        fp.alias("false_positives"),
        (F.coalesce(F.col("_neg"), F.lit(0)) - fp).alias("true_negatives"),
        (F.coalesce(F.col("_pos"), F.lit(0)) - tp).alias("false_negatives"),
    )
    return with_rates(counted)


def thinned(points: DataFrame, count: int) -> DataFrame:
    """At most ``count`` evenly spaced curve points for display, picked by recall interval (one aggregation)."""
    slot = F.least(F.floor(F.col("recall") * F.lit(count)), F.lit(count - 1))
    return (
        points.groupBy(slot.alias("slot"))
        .agg(F.max_by(F.struct("score", "precision", "recall"), F.struct("score")).alias("p"))
        .select("slot", "p.*")
    )


def class_weights(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Balanced weights n / (classes * n_c)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("row_count"))
    everything = Window.partitionBy()  # one row per class
    return counts.withColumn(
        "weight",
        F.sum("row_count").over(everything).cast("double") / (F.count(F.lit(1)).over(everything) * F.col("row_count")),
    )


def scaler_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, std) with the population deviation, one scan."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    rows = [
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"))
        for c in columns
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Centre and scale in place; a constant column is only centred."""
    stats = {r["feature"]: r for r in scaler_stats(df, columns).collect()}  # one row per feature
    return df.withColumns(
        {c: (F.col(c) - F.lit(stats[c]["mean"])) / F.lit(stats[c]["std"] or 1.0) for c in columns if stats[c]["mean"] is not None}
    )
