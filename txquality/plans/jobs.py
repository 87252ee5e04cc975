"""Batch jobs: load to marts with gate and tests, and continuous training on top of it."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from txquality import schema as S
from txquality.operators import admission
from txquality.plans import drift, marts, quality, registry, training
from txquality.session import checkpointed
from txquality.sources import files

#: Refused files that an error message names; all of them are in ``RawFiles.unfit``.
NAMED_FILES = 20


def build_marts(spark: SparkSession, raw: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Staging as a view, marts as Parquet tables; each mart is read back by the next one."""
    stg = marts.staging(raw)
    stg.createOrReplaceTempView("stg_transactions")
    models = {"stg_transactions": stg}
    steps = [
        ("fct_transactions_clean", "stg_transactions", marts.clean),
        ("fct_transactions_features", "fct_transactions_clean", marts.features),
        ("agg_fraud_hourly_summary", "fct_transactions_features", marts.hourly_summary),
    ]
    for name, source, build in steps:
        files.replace_table(build(models[source]), f"{folder}/{name}")
        models[name] = spark.read.parquet(f"{folder}/{name}")
    return models


def load_raw(spark: SparkSession, csv_paths: str | list[str], folder: str, load_id: str) -> DataFrame:
    """Replace-load of the raw table with row numbers and lineage; blocked by the gate.

    Files may differ in the order of their columns; rows are numbered in order of path and line. Files without a required column are
    refused by name before anything is written. The table keeps the file and the columns whose text was no number;
    ``load_report`` has one row per file.
    """
    source = files.RawFiles(spark, csv_paths)
    unfit = source.unfit().orderBy("path").limit(NAMED_FILES).collect()
    if unfit:
        named = "; ".join(f"{r['path']}: missing {list(r['missing'])}, repeated {list(r['repeated'])}" for r in unfit)
        raise quality.QualityError(f"required columns are missing or named twice, first {len(unfit)} files: {named}")
    rows = source.rows().withColumnsRenamed({"position": "id", "path": "source_file"})
    files.replace_table(files.with_lineage(rows, load_id), f"{folder}/transactions_raw")
    raw = spark.read.parquet(f"{folder}/transactions_raw")
    bad = F.explode_outer("bad_columns").alias("column")
    per_file = raw.select("source_file", bad).groupBy("source_file").agg(F.count("column").alias("bad_fields"), F.collect_set("column").alias("names"))
    listed = F.array_join(F.array_intersect(F.array(*[F.lit(c) for c in S.RAW_TYPES]), "names"), ",")
    report = per_file.select(F.lit(load_id).alias("load_id"), F.col("source_file").alias("path"), "bad_fields", listed.alias("columns"))
    files.append_jsonl(report, f"{folder}/load_report")
    quality.enforce_gate(raw)
    return raw


def batch_job(spark: SparkSession, csv_paths: str | list[str], folder: str, load_id: str) -> dict:
    """Raw file to tested marts; the first failing stage raises and stops the job."""
    raw = load_raw(spark, csv_paths, folder, load_id)
    models = build_marts(spark, raw, folder)
    summary = quality.enforce_suite(spark, models)
    return {"models": models, "tests": summary}


def train_job(
    spark: SparkSession,
    feats: DataFrame,
    folder: str,
    tests: str = "unknown",
    names: tuple[str, ...] = ("logreg_baseline", "rf_balanced_v1"),
    promote: bool = True,
    model_name: str = "fraud-classifier",
    **forest,
) -> dict:
    """Train the candidates, keep the better one by PR-AUC, register it and decide on promotion."""
    split = checkpointed(training.split_features(feats))  # read by every fit and evaluation below
    tags = {"data_version": f"{feats.count()}_rows", "trained_by": "txquality", "test_status": tests}
    fitted: dict[str, tuple[PipelineModel, DataFrame, str]] = {}
    for name in names:
        model, run = training.train_and_evaluate(name, split, tags=tags, **(forest if name.startswith("rf") else {}))
        run_id = uuid.uuid4().hex[:12]
        path = f"{folder}/models/{run_id}"
        training.save_model(model, run, path)
        fitted[name] = (model, spark.read.parquet(f"{path}/run"), run_id)
    best = max(fitted, key=lambda n: fitted[n][1].first()["pr_auc"])
    _, run, run_id = fitted[best]
    table = registry.ModelTable(spark, f"{folder}/model_versions")
    decision = table.register(run, model_name, run_id, promote)
    return {"best": best, "path": f"{folder}/models/{run_id}", **decision}


def learning_steps(
    spark: SparkSession, folder: str, name: str = "logreg_baseline", model_name: str = "fraud-classifier", promote: bool = True, **params
) -> list[tuple]:
    """Steps of ``continuous.Chain``: train on the rows of a version, check drift, register the model that was trained.

    The model lies in a folder named after the batch, and a registered run is found by that name, so a repeat adds nothing.
    """

    def features(rows: DataFrame) -> DataFrame:
        staged = rows.withColumn("time_seconds", F.col("time"))
        return marts.with_features(staged)

    def train(rows: DataFrame, batch: str) -> float:
        split = checkpointed(training.split_features(features(rows), "id"))
        model, run = training.train_and_evaluate(name, split, tags={"batch": batch}, **params)
        training.save_model(model, run, f"{folder}/models/{batch}")
        return spark.read.parquet(f"{folder}/models/{batch}/run").first()["pr_auc"]

    def check(rows: DataFrame, batch: str) -> bool:
        return drift_job(features(rows), folder, batch)

    def register(rows: DataFrame, batch: str) -> str:
        table = registry.ModelTable(spark, f"{folder}/model_versions")
        there = table.versions().filter((F.col("model") == model_name) & (F.col("run_id") == batch)).agg(F.max("version")).first()[0]
        if there is None:
            there = table.register(spark.read.parquet(f"{folder}/models/{batch}/run"), model_name, batch, promote)["version"]
        return f"version {there}"

    return [("train", train), ("drift", check), ("register", register)]


def drift_job(feats: DataFrame, folder: str, source: str, new_data_after: float | None = None) -> bool:
    """Check drift of the current version and add it to the history once per version."""
    rows = feats.select("time_seconds", "amount")
    mark = files.checksum(rows, ["time_seconds", "amount"]).first()
    fingerprint = f"{mark['row_count']}-{mark['digest_xor']}-{mark['digest_sum']}"
    return drift.record_check(drift.summary(rows, new_data_after), fingerprint, source, f"{folder}/drift_history")


def score_job(spark: SparkSession, rows: DataFrame, model_path: str, log_path: str, version: str) -> DataFrame:
    """Score admissible rows with a saved model and its own threshold, and log the predictions."""
    model, threshold = training.load_model(spark, model_path)
    judged = admission.judged(rows, label=None).filter("is_valid").drop("is_valid", "reasons")
    feats = marts.with_features(judged.withColumn("time_seconds", F.col("time")))
    scored = training.score(model, feats)
    files.log_predictions(scored, log_path, version, threshold)
    return files.rounded_predictions(scored, threshold).withColumn("threshold", F.lit(threshold))


def live_report(feats: DataFrame, log_path: str, report_path: str) -> DataFrame:
    """Drift report with the logged amounts, written as text."""
    spark = feats.sparkSession
    rows = feats.select("time_seconds", "amount")
    logged = files.read_jsonl(spark, log_path, S.PREDICTION_SCHEMA)
    lines = drift.report_lines(drift.drift_by_feature(rows), drift.live_drift(rows, logged))
    files.write_lines(lines, report_path)
    return lines
