"""Quality classifier: normal equations, isotonic steps, held-out accuracy, odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txquality.llm import quality
from txquality.llm.queries import QUERIES


def rows_and_labels(n=400, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = i % 2
        words = [rng.choice(["river", "mountain", "Forest", "lake", "stone"]) + str(rng.randrange(30)) for _ in range(rng.randrange(20, 60))]
        docs.append((i, " ".join(words) + "." if good else " ".join(w + rng.choice(["$$$", "%%%"]) for w in words)))
        labels.append((i, good))
    return docs, labels


@pytest.fixture(scope="module")
def case(spark, make_docs):
    docs, labels = rows_and_labels()
    return make_docs(docs), spark.createDataFrame(labels, "doc_id bigint, quality int"), dict(labels)


def test_sums_equal_numpy(spark):
    rng = np.random.default_rng(0)
    stats = rng.normal(size=(200, len(quality.STATISTICS))).astype(np.float32)
    label = rng.integers(0, 2, 200).astype(float)
    model = quality.KernelRidge(stats.mean(0), stats.std(0))
    df = spark.createDataFrame([(s.tolist(), float(y)) for s, y in zip(stats, label)], "stats array<float>, label double").repartition(5)
    gram, target = quality.normal_equations(df, model)
    f = model.expand(stats.astype(float))
    assert np.allclose(gram, f.T @ f) and np.allclose(target, f.T @ label)


def test_pooling_gives_the_best_monotone_fit():
    x, n, pos = np.arange(6.0), np.array([2.0, 1, 1, 4, 1, 1]), np.array([1.0, 1, 0, 2, 0, 1])
    centres, share = quality.pooled(x, n, pos)
    assert (np.diff(share) > 0).all() and (np.diff(centres) > 0).all()
    assert np.isclose(share[0], 4 / 9) and share[-1] == 1


def test_held_out_accuracy(case):
    docs, labels, truth = case
    held = F.pmod(F.col("doc_id"), F.lit(4)) == 2
    found = quality.classify(docs, labels, held).collect()
    out = [r for r in found if r.held_out]
    assert len(found) == 400 and len(out) == 100
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)


def test_accept_equals_scores(case):
    docs, labels, truth = case
    held = F.lit(False)
    model = quality.train(docs, labels, held)
    kept = {r.doc_id for r in quality.accept(docs, model).collect()}
    assert 0.95 * 200 <= len(kept) <= 1.05 * 200 and all(truth[i] for i in kept)


def test_odd_rows(spark, case, make_docs):
    docs, labels, _ = case
    odd = make_docs([(-1, None), (-2, ""), (None, "some text here"), (-3, "word " * 200_000), (-4, "a"), (-4, "a")])
    labels = labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (0, 0), (0, 1)], "doc_id bigint, quality int"))
    found = quality.classify(docs.unionByName(odd), labels, F.lit(False)).collect()
    assert len(found) == 406 and all(0 <= r.score <= 1 for r in found)


def test_without_labels_and_without_rows(spark, case, make_docs):
    docs, labels, _ = case
    found = quality.classify(docs, labels.where("quality = 1"), F.lit(False))
    assert {(r.score, r.predicted) for r in found.collect()} == {(0.5, 0)}
    assert quality.accept(docs, quality.train(docs, labels.limit(0), F.lit(False))).count() == 400
    assert quality.classify(make_docs([]), labels, F.lit(False)).count() == 0


def test_query_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in QUERIES["op6_quality"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.93
