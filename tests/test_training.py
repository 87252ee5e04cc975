from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from txquality import schema as S
from txquality.plans import marts, resample, training
from txquality.sources import files
from txquality.streaming import jobs


@pytest.fixture(scope="module")
def feats(spark):
    """Fixture rows whose first component depends on the label."""
    raw = resample.fixture_rows(spark, 600, 0.2).withColumn("v1", F.col("v1") + 2.0 * F.col("class"))
    return marts.features_from_raw(files.with_lineage(raw, "load-1")).cache()


@pytest.fixture(scope="module")
def split(feats):
    return training.split_features(feats).cache()


def test_logistic_regression_is_the_optimum(split):
    """The gradient of the balanced sum-of-losses objective with C = 1 vanishes at the fitted weights."""
    train = split.filter("fold = 'train'")
    model, _ = training.fit("logreg_baseline", train)
    w, b = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    pdf = train.select(*S.FEATURES, "is_fraud").toPandas()
    x = pdf[S.FEATURES].to_numpy(float)
    x = (x - x.mean(0)) / x.std(0)
    y = pdf["is_fraud"].to_numpy(float)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (weight * (p - y)) + w).max() < 1e-2
    assert abs((weight * (p - y)).sum()) < 1e-2


def test_train_evaluate_save_and_load(spark, split, tmp_path):
    model, run = training.train_and_evaluate("logreg_baseline", split)
    row = run.first()
    assert (row["n_train"], row["n_test"]) == (480, 120) and row["pr_auc"] > 0.5
    assert row["params"]["maxIter"] == "1000" and len(row["tags"]["code_version"]) == 12
    training.save_model(model, run, str(tmp_path / "m"))
    loaded, threshold = training.load_model(spark, str(tmp_path / "m"))
    assert threshold == row["threshold"]
    test = split.filter("fold = 'test'")
    first = training.score(model, test).select("transaction_id", "probability_fraud")
    assert first.exceptAll(training.score(loaded, test).select("transaction_id", "probability_fraud")).count() == 0
    shown = files.rounded_predictions(training.score(model, test), threshold)
    assert shown.filter("decision").count() == row["true_positives"] + row["false_positives"]


def test_forest(split):
    _, run = training.train_and_evaluate("rf_balanced_v1", split, trees=10, depth=4)
    assert run.first()["pr_auc"] > 0.5


def test_skill_checks_refuse_a_constant_model(split):
    train = split.filter("fold = 'train'")
    model, _ = training.fit("logreg_baseline", train)
    fine = training.skill(model, train).first()
    assert fine["above_share"] and fine["ranks_better"]
    row = training.logistic_gradient(model, train).first()
    assert row["largest_gradient"] < 1e-2 and abs(row["weighted_probability"] - train.count() / 2) < 0.05

    class Constant(training.BalancedForest):
        def score(self, df):
            return df.withColumn("probability_fraud", F.lit(0.5))

    row = training.skill(Constant([], None), train).first()
    assert not row["above_share"] and not row["ranks_better"]


def test_balanced_forest_weights_each_bootstrap(split):
    train = split.filter("fold = 'train'")
    weighted, totals = training.tree_weights(train, "transaction_id", 3, 5)
    for k in range(3):
        mass = {r["is_fraud"]: r["w"] for r in weighted.groupBy("is_fraud").agg(F.sum(f"_w{k}").alias("w")).collect()}
        drawn = sum(r[f"d{k}"] for r in totals.collect())
        assert mass[0] == pytest.approx(drawn / 2) and mass[1] == pytest.approx(drawn / 2)
    forest = training.fit_balanced_forest(train, "transaction_id", trees=4, depth=4, seed=5)
    test = split.filter("fold = 'test'")
    scored = forest.score(test)
    assert scored.columns == [*test.columns, "probability_fraud"]
    row = training.skill(forest, test).first()
    assert row["above_share"] and row["ranks_better"]


def test_unknown_model(split):
    with pytest.raises(ValueError):
        training.fit("svm", split)


def test_stream_restart_counts_a_batch_once(spark, tmp_path):
    rows = resample.fixture_rows(spark, 120).withColumnRenamed("class", "is_fraud")
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows.filter("id < 60").coalesce(1).write.parquet(source)

    def once():
        stream = jobs.file_stream(spark, source, rows.schema)
        jobs.ingest(stream, out, mark).awaitTermination()

    once()
    once()
    assert jobs.admitted(spark, out).count() == 60
    rows.filter("id >= 60").withColumn("amount", F.when(F.col("id") == 60, -1.0).otherwise(F.col("amount"))).coalesce(
        1
    ).write.mode("append").parquet(source)
    once()
    assert jobs.admitted(spark, out).count() == 119
    assert jobs.refused(spark, out).first()["reasons"] == ["amount_negative"]
    states = jobs.pending_state(spark, out, 100).orderBy("batch_id").collect()
    assert [(r["row_count"], r["triggered"]) for r in states] == [(60, False), (59, True)]


def test_rows_of_a_forest_are_dealt_to_tasks(spark, monkeypatch):
    """Rows of one partition go to as many tasks as they need, each row once; few rows stay where they are, and a forest grows on what was dealt."""
    rows = spark.range(0, 1000, 1, 1).select(F.col("id"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).alias("is_fraud"))
    assert training.dealt(rows, 1000).rdd.getNumPartitions() == 1
    spread = training.dealt(rows, 100)
    sizes = [n for n, in spread.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 10 and max(sizes) <= 110 and sorted(spread.collect()) == sorted(rows.collect())
    seen, plain = [], training.dealt
    monkeypatch.setattr(training, "dealt", lambda df: seen.append(plain(df, 100)) or seen[-1])
    training.fit("rf_balanced_v1", rows, ["x"], trees=2, depth=2)
    assert seen[0].count() == 1000


def test_tasks_of_a_forest_follow_the_cores_where_rows_are_many(spark):
    """Each task sends the statistics of all nodes, so tasks do not grow with the rows alone."""
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 100 * cores, 1, 1).withColumn("x", F.col("id") % 7)
    for most, tasks in ((1000, cores), (30, 4 * cores)):
        spread = training.dealt(rows, 10, most)
        sizes = [n for n, in spread.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert spread.rdd.getNumPartitions() == len(sizes) == tasks and max(sizes) <= 1.2 * 100 * cores / tasks
        assert sorted(spread.collect()) == sorted(rows.collect())


def test_a_forest_grown_in_groups_holds_all_trees(spark, split, tmp_path, monkeypatch):
    monkeypatch.setattr(training, "FOREST_ROWS", 100)
    asked, plain = [], training.grown
    monkeypatch.setattr(training, "grown", lambda forest, rows: asked.append(rows.count()) or plain(forest, rows, 2))
    model, logged = training.fit("rf_balanced_v1", split.filter("fold = 'train'"), trees=5, depth=4)
    forest = model.stages[-1]
    assert asked == [480] and forest.getNumTrees == len(forest.trees) == 5 and logged["numTrees"] == "5" and logged["seed"] == "42"
    assert len({t.toDebugString.split("\n", 1)[1] for t in forest.trees}) == 5
    test = split.filter("fold = 'test'")
    scored = training.score(model, test).select("transaction_id", "probability_fraud")
    assert scored.columns == ["transaction_id", "probability_fraud"] and scored.count() == 120
    ready = model.stages[1].transform(model.stages[0].transform(test))
    for tree in forest.trees:
        tree.setFeaturesCol("features").setProbabilityCol("p")
    votes = [{r["transaction_id"]: r["p"][1] for r in t.transform(ready).select("transaction_id", "p").collect()} for t in forest.trees]
    assert all(r["probability_fraud"] == pytest.approx(sum(v[r["transaction_id"]] for v in votes) / 5) for r in scored.collect())
    row = training.skill(model, test).first()
    assert row["above_share"] and row["ranks_better"]
    training.save_model(model, spark.range(1).withColumn("threshold", F.lit(0.5)), str(tmp_path / "m"))
    loaded, _ = training.load_model(spark, str(tmp_path / "m"))
    assert sorted(training.score(loaded, test).select("transaction_id", "probability_fraud").collect()) == sorted(scored.collect())
