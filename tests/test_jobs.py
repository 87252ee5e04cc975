"""From a raw file to tested marts, a registered model, logged predictions and a drift history."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from txquality import schema as S
from txquality.plans import jobs, quality, registry, resample
from txquality.streaming import jobs as streams


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("warehouse"))


@pytest.fixture(scope="module")
def built(spark, folder):
    raw = resample.fixture_rows(spark, 500, 0.2).withColumn("v1", F.col("v1") + 2.0 * F.col("class"))
    upper = [F.col("time").alias("Time"), *[F.col(v).alias(v.upper()) for v in S.V_COLUMNS], F.col("amount").alias("Amount")]
    raw.select(*upper, F.col("class").alias("Class")).coalesce(1).write.option("header", True).csv(f"{folder}/csv")
    return jobs.batch_job(spark, f"{folder}/csv", folder, "load-1")


def test_batch_job(spark, built, folder):
    assert built["tests"] == "23/23 PASS"
    assert spark.table("stg_transactions").count() == 500
    hourly = built["models"]["agg_fraud_hourly_summary"]
    assert hourly.agg(F.sum("nb_transactions"), F.sum("nb_fraud")).first() == (500, 100)
    assert spark.read.parquet(f"{folder}/transactions_raw").agg(F.max("id")).first()[0] == 499


def test_gate_stops_the_job(spark, tmp_path):
    spark.createDataFrame([(1.0, 2.0)], "Time double, V1 double").write.option("header", True).csv(str(tmp_path / "c"))
    with pytest.raises(quality.QualityError, match="required columns are missing"):
        jobs.batch_job(spark, str(tmp_path / "c"), str(tmp_path), "load-1")


def test_train_register_score_and_drift(spark, built, folder):
    feats = built["models"]["fct_transactions_features"]
    result = jobs.train_job(spark, feats, folder, built["tests"], ("logreg_baseline",))
    assert result["promoted"] and result["version"] == 1
    again = jobs.train_job(spark, feats, folder, built["tests"], ("logreg_baseline",))
    assert not again["promoted"] and again["production_metric"] == result["pr_auc"]
    staged = registry.ModelTable(spark, f"{folder}/model_versions").staged()
    assert {r["version"]: r["stage"] for r in staged.collect()} == {1: "Production", 2: "Staging"}
    rows = spark.read.parquet(f"{folder}/transactions_raw").drop("class")
    bad = rows.withColumn("amount", F.when(F.col("id") == 0, -10.0).otherwise(F.col("amount")))
    scored = jobs.score_job(spark, bad, result["path"], f"{folder}/predictions", "v1")
    assert scored.count() == 499
    logged = spark.read.schema(S.PREDICTION_SCHEMA).json(f"{folder}/predictions")
    assert logged.count() == 499 and logged.filter("fraud_probability between 0 and 1").count() == 499
    assert jobs.drift_job(feats, folder, "manual") is True
    assert jobs.drift_job(feats, folder, "manual") is False
    assert jobs.drift_job(feats.limit(400), folder, "manual") is True
    assert spark.read.schema(S.DRIFT_SCHEMA).json(f"{folder}/drift_history").count() == 2
    lines = [r["line"] for r in jobs.live_report(feats, f"{folder}/predictions", f"{folder}/report").collect()]
    assert any(line.startswith("| amount (live, n=499)") for line in lines)


def test_metric_samples_of_a_stream(spark, tmp_path):
    rows = resample.fixture_rows(spark, 50).withColumnRenamed("class", "is_fraud").withColumn("load_id", F.lit("a"))
    rows = rows.withColumn("ts", F.timestamp_seconds(F.col("time").cast("long")))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), rows.schema)
    streams.metric_samples(stream, "load_id", str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = {r["metric"]: r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["batch_rows"] == 50 and got["batch_frauds"] == 2
    last = rows.agg(F.max("ts")).first()[0]
    assert {r["ts"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {last}
