from __future__ import annotations

import math

import numpy as np
import pytest

from txquality.plans import evaluation


def frame(spark, y, p):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label long, score double")


def brute_force(y, p):
    """Areas by definition: step sum over distinct scores, and pairs of one fraud and one legitimate row."""
    y, p = np.array(y), np.array(p)
    ap, before = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        said = p >= t
        recall, precision = (said & (y == 1)).sum() / (y == 1).sum(), (y[said] == 1).mean()
        ap, before = ap + (recall - before) * precision, recall
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return ap, wins / (len(pos) * len(neg))


def test_perfect_separation(spark):
    m = evaluation.metrics(frame(spark, [0, 0, 0, 1, 1], [0.1, 0.2, 0.3, 0.8, 0.9]), threshold=0.5).first()
    assert (m["precision"], m["recall"], m["pr_auc"], m["roc_auc"]) == (1, 1, 1, 1)
    assert (m["true_positives"], m["false_positives"]) == (2, 0)


def test_confusion_counts(spark):
    df = frame(spark, [0, 1, 1, 0], [0.9, 0.1, 0.6, 0.4])
    for m in (evaluation.metrics(df, threshold=0.5).first(), evaluation.confusion(df, 0.5).first()):
        assert (m["false_positives"], m["false_negatives"], m["true_positives"], m["true_negatives"]) == (1, 1, 1, 1)
    assert evaluation.areas(evaluation.curve(df)).first()["pr_auc"] == pytest.approx(0.5)


@pytest.mark.parametrize("buckets", [1, 7])
def test_areas_and_threshold_equal_brute_force(spark, buckets):
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 2, 200), np.round(rng.random(200), 2)
    df = frame(spark, y, p)
    m = evaluation.metrics(df, buckets=buckets).first()
    ap, roc = brute_force(y, p)
    assert m["pr_auc"] == pytest.approx(ap, abs=1e-12) and m["roc_auc"] == pytest.approx(roc, abs=1e-12)
    best = None
    for t in sorted(set(p)):
        said = p >= t
        pr, rc = (y[said] == 1).mean(), (said & (y == 1)).sum() / (y == 1).sum()
        f1 = 2 * pr * rc / (pr + rc + 1e-12)
        if best is None or f1 > best[0]:
            best = (f1, t)
    assert m["threshold"] == best[1] and 0 <= m["threshold"] <= 1


def test_grouped_metrics_equal_single_runs(spark):
    rng = np.random.default_rng(5)
    rows = [("ab"[i % 2], int(rng.integers(0, 2)), float(np.round(rng.random(), 1))) for i in range(300)]
    df = spark.createDataFrame(rows, "m string, label long, score double")
    grouped = {r["m"]: r for r in evaluation.metrics(df, groups=["m"], buckets=4).collect()}
    for m in "ab":
        one = evaluation.metrics(df.filter(f"m = '{m}'")).first()
        for key in ("pr_auc", "roc_auc", "threshold", "true_positives", "false_negatives", "f1"):
            assert grouped[m][key] == pytest.approx(one[key])


def test_threshold_above_every_score(spark):
    m = evaluation.metrics(frame(spark, [0, 1], [0.2, 0.3]), threshold=0.9).first()
    assert (m["true_positives"], m["false_positives"], m["precision"], m["f1"]) == (0, 0, 0.0, 0.0)


def test_empty_and_one_class_inputs(spark):
    empty = evaluation.metrics(frame(spark, [], [])).first()
    assert empty["threshold"] == 0.5 and empty["pr_auc"] == 0.0 and empty["roc_auc"] is None
    only = evaluation.metrics(frame(spark, [0, 0], [0.1, 0.2])).first()
    assert only["pr_auc"] == 0.0 and only["roc_auc"] is None


def test_scaling_and_weights(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0), (3.0, 5.0, 0), (5.0, 5.0, 1)], "a double, b double, is_fraud long")
    stats = {r["feature"]: r for r in evaluation.scaler_stats(df, ["a", "b"]).collect()}
    assert stats["a"]["std"] == pytest.approx(math.sqrt(8 / 3)) and stats["b"]["std"] == 0
    assert [r["b"] for r in evaluation.scaled(df, ["a", "b"]).collect()] == [0, 0, 0]
    weights = {r["is_fraud"]: r["weight"] for r in evaluation.class_weights(df).collect()}
    assert weights == {0: 0.75, 1: 1.5}
