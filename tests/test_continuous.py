"""The chain below, at and above its threshold, and its two failure rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from txquality.plans import continuous, jobs, resample


@pytest.fixture
def rows(spark):
    return resample.fixture_rows(spark, 60).withColumnRenamed("class", "is_fraud")


def steps(df):
    return [(r["step"], r["status"], r["row_count"]) for r in df.orderBy("step_no").collect()]


def test_pending_then_learned(spark, rows, tmp_path):
    seen = []
    chain = continuous.Chain(spark, str(tmp_path), 100, [("train", lambda df, key: seen.append((key, df.count()))), ("drift", lambda df, key: None)])
    bad = rows.withColumn("amount", F.when(F.col("id") < 10, -1.0).otherwise(F.col("amount")))
    assert steps(chain.run(bad, 0)) == [("admit", "completed", 60), ("append", "completed", 50), ("count", "pending", 50)]
    second = [("admit", "completed", 60), ("append", "completed", 50), ("count", "reached", 100)]
    second += [("version", "completed", 100), ("train", "completed", 100), ("drift", "completed", 100)]
    for _ in range(3):  # a repeated batch finds its version and what it has learned
        assert steps(chain.run(bad, 1)) == second
    assert seen == [("batch-1", 100)] and chain.pending(2) == 0 and chain.store.manifest().count() == 1
    assert steps(chain.run(bad, 2))[-1] == ("count", "pending", 50)
    assert steps(chain.run(bad, 2))[-1] == ("count", "pending", 50)


def test_busy_keeps_the_version_and_starts_over(spark, rows, tmp_path):
    chain = continuous.Chain(spark, str(tmp_path), 10, [("train", lambda df, key: 1 / 0)], busy=lambda: True)
    assert steps(chain.run(rows, 0))[-2:] == [("version", "completed", 60), ("train", "versioned", 0)]
    assert chain.pending(1) == 0 and chain.store.current()["version"] == 1
    chain.busy = lambda: False
    assert steps(chain.run(rows, 0))[-1] == ("train", "versioned", 0)
    out = chain.run(rows, 1)
    assert steps(out)[-1] == ("train", "failed", 120)
    assert out.filter("step = 'train'").first()["error"] == "ZeroDivisionError: division by zero"


def test_a_repeat_tries_what_failed_and_skips_what_is_done(spark, rows, tmp_path):
    calls = []

    def drift(df, key):
        calls.append("drift")
        if len(calls) < 3:
            raise OSError("no space\nleft")
        return "checked"

    chain = continuous.Chain(spark, str(tmp_path), 10, [("train", lambda df, key: calls.append("train")), ("drift", drift), ("register", lambda df, key: calls.append("register"))])
    first = chain.run(rows, 0)
    assert steps(first)[-2:] == [("train", "completed", 60), ("drift", "failed", 60)]
    assert first.filter("step = 'drift'").first()["error"] == "OSError: no space"
    again = chain.run(rows, 0)
    assert steps(again)[-3:] == [("train", "completed", 60), ("drift", "completed", 60), ("register", "completed", 60)]
    assert again.filter("step = 'drift'").first()["result"] == "checked" and calls == ["train", "drift", "drift", "register"]


def test_failed_version_keeps_the_rows_pending(spark, rows, tmp_path):
    chain = continuous.Chain(spark, str(tmp_path), 10, [("train", lambda df, key: None)])
    rows.write.parquet(str(tmp_path / "versions" / "version=1"))  # in the way
    out = chain.run(rows, 0)
    assert steps(out)[-1] == ("version", "failed", 60) and chain.pending(1) == 60
    assert out.filter("step = 'version'").first()["error"]


def test_learning_steps(spark, rows, tmp_path):
    """Train, drift and register from one batch, run twice: one model, one version of it, one drift record."""
    known = rows.withColumn("is_fraud", (F.col("id") % 3 == 0).cast("long"))
    chain = continuous.Chain(spark, str(tmp_path), 10, jobs.learning_steps(spark, str(tmp_path)))
    first, again = (chain.run(known, 0).orderBy("step_no").collect() for _ in range(2))
    assert first == again and [r["step"] for r in first[3:]] == ["version", "train", "drift", "register"]
    assert all(r["status"] == "completed" for r in first[3:]) and first[-1]["result"] == "version 1"
    assert spark.read.parquet(str(tmp_path / "model_versions")).count() == 1
    assert spark.read.json(str(tmp_path / "drift_history")).count() == 1
