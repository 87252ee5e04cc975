from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from txquality import schema as S
from txquality.functions import columns as C
from txquality.operators import admission
from txquality.plans import marts, quality


@pytest.fixture(scope="module")
def raw(spark):
    """Ten sound rows."""
    return spark.range(10).select(
        F.col("id").cast("double").alias("time"),
        F.lit(10.0).alias("amount"),
        F.lit(0).cast("long").alias("class"),
        *[F.lit(0.1).alias(v) for v in S.V_COLUMNS],
        F.lit("load-1").alias("load_id"),
        F.col("id").cast("string").alias("row_uid"),
    )


def test_gate_passes_sound_rows(raw):
    assert quality.enforce_gate(raw) == 10


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda df: df.drop("amount"), r"required columns are missing: \['amount'\]"),
        (lambda df: df.withColumn("amount", F.when(F.col("time") > 0, F.col("amount"))), "amount is NULL in 1 of 10"),
        (lambda df: df.withColumn("class", F.lit(2).cast("long")), "class is neither 0 nor 1 in 10"),
        (lambda df: df.withColumn("amount", F.lit(-5.0)), "amount is below zero in 10"),
    ],
)
def test_gate_blocks(raw, change, message):
    with pytest.raises(quality.QualityError, match=message):
        quality.enforce_gate(change(raw))


def test_suite_has_23_checks_and_passes(spark, raw):
    assert len(quality.declared_checks()) == 23
    assert quality.enforce_suite(spark, quality.suite_models(raw)) == "23/23 PASS"


def test_suite_reports_failures(spark, raw):
    broken = raw.withColumn("row_uid", F.lit("same")).withColumn("class", F.lit(3).cast("long"))
    results = quality.run_suite(quality.suite_models(broken))
    failed = {(r["model"], r["test"]): r["failures"] for r in results.filter("status = 'fail'").collect()}
    assert failed[("stg_transactions", "unique")] == 1
    assert failed[("fct_transactions_clean", "accepted_values")] == 10
    with pytest.raises(quality.QualityError):
        quality.enforce_suite(spark, quality.suite_models(broken))


def test_range_needs_a_limit_and_passes_null(spark):
    df = spark.createDataFrame([(1,), (5,), (None,), (9,)], "a int")
    assert [r["a"] for r in quality.out_of_range(df, "a", max_value=5).collect()] == [9]
    assert [r["a"] for r in quality.out_of_range(df, "a", 2, 9).collect()] == [1]
    with pytest.raises(ValueError):
        quality.out_of_range(df, "a")


def test_contract_and_documentation(raw):
    feats = marts.features_from_raw(raw)
    assert quality.contract_check(feats).filter("not ok").count() == 0
    assert quality.documentation_gaps(feats) == []
    assert quality.documentation_gaps(feats.withColumn("secret", F.lit(1))) == ["secret"]
    wrong = feats.withColumn("hour_of_day", F.col("hour_of_day").cast("long")).drop("v7")
    bad = {r["column_name"] for r in quality.contract_check(wrong).filter("not ok").collect()}
    assert bad == {"hour_of_day", "v7"}


def test_clean_drops_null_and_keeps_nan(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (None,), (float("nan"),), (0.0,)], "amount double")
    assert marts.clean(df).count() == 3


def test_feature_columns(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0), (3599.9, 9.99), (86399.0, 99.0), (90000.0, 999.0), (172800.0, 1000.0), (1.0, None)],
        "time_seconds double, amount double",
    )
    rows = marts.with_features(df).collect()
    assert [r["hour_of_day"] for r in rows] == [0, 0, 23, 1, 0, 0]
    assert [r["amount_bucket"] for r in rows] == ["zero", "low", "medium", "high", "very_high", "very_high"]
    assert rows[0]["log_amount"] == 0.0


def test_labels(spark):
    df = spark.createDataFrame([(123, 93784.9), (1234567, 0.0)], "id long, time double")
    got = df.select(C.transaction_label(F.col("id")).alias("a"), C.clock_label(F.col("time")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("TX-000123", "J2 02:03:04"), ("TX-1234567", "J1 00:00:00")]


def test_admission_rules(spark):
    base = {"time": 100.0, **{v: 0.0 for v in S.V_COLUMNS}, "amount": 25.0, "is_fraud": 0}
    cases = [
        ({}, []),
        ({"is_fraud": 2}, ["label_out_of_domain"]),
        ({"amount": -10.0, "is_fraud": None}, ["amount_negative", "label_missing"]),
        ({"v28": None}, ["component_missing"]),
        ({"time": float("nan")}, ["time_missing"]),
    ]
    columns = list(base)
    rows = [tuple({**base, **change}[c] for c in columns) for change, _ in cases]
    schema = ", ".join(f"{c} {'long' if c == 'is_fraud' else 'double'}" for c in columns)
    df = spark.createDataFrame(rows, schema)
    assert [r["reasons"] for r in admission.judged(df).collect()] == [want for _, want in cases]
    unlabelled = [r["is_valid"] for r in admission.judged(df, label=None).collect()]
    assert unlabelled == [True, True, False, False, False]
    assert not admission.batch_verdict(df.withColumn("b", F.lit(1)), ["b"]).first()["accepted"]
