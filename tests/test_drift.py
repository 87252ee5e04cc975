from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from txquality.operators import psi
from txquality.plans import drift, resample


def brute_force(reference, current, bins=10):
    edges = np.unique(pd.Series(reference).quantile(np.linspace(0, 1, bins + 1)).values)
    if len(edges) < 3:
        return 0.0
    edges[0], edges[-1] = -np.inf, np.inf
    share = [np.clip(np.histogram(x, bins=edges)[0] / max(len(x), 1), 1e-6, None) for x in (reference, current)]
    return float(np.sum((share[1] - share[0]) * np.log(share[1] / share[0])))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    time = np.sort(rng.uniform(0, 172_792, 1500))
    amount = np.round(rng.exponential(80, 1500), 2)
    amount[::3] = 1.0  # a third of the rows share one amount
    amount[900:] *= 1.5
    return pd.DataFrame({"time_seconds": time, "amount": amount})


def features(pdf):
    return pdf.assign(log_amount=np.log(pdf.amount + 1), hour_of_day=np.floor((pdf.time_seconds % 86400) / 3600))


def test_halves_equal_brute_force(spark, rows):
    got = {r["feature"]: r["psi"] for r in drift.drift_by_feature(spark.createDataFrame(rows)).collect()}
    f = features(rows)
    cut = f.time_seconds.median()
    for c in ("amount", "log_amount", "hour_of_day"):
        want = brute_force(f[f.time_seconds < cut][c], f[f.time_seconds >= cut][c])
        assert got[c] == pytest.approx(want, abs=1e-9)


def test_levels_are_the_numerical_library_ones():
    assert psi.quantile_levels() == list(np.linspace(0, 1, 11) * 100 / 100)


def test_distribution_shares_and_labels(spark, rows):
    table = drift.distribution(spark.createDataFrame(rows), features=["amount"]).orderBy("bin").collect()
    assert sum(r["reference"] for r in table) == pytest.approx(1) and sum(r["recent"] for r in table) == pytest.approx(1)
    f = rows[rows.time_seconds < rows.time_seconds.median()].amount
    edges = np.unique(f.quantile(np.linspace(0, 1, 11)).values)
    assert table[0]["bucket"] == f"< {edges[1]:.3g}" and table[-1]["bucket"] == f"≥ {edges[-2]:.3g}"
    assert table[1]["bucket"] == f"{edges[1]:.3g}–{edges[2]:.3g}"


def test_uniform_reference_has_no_index(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(50)], "time_seconds double, amount double")
    got = {r["feature"]: r for r in drift.drift_by_feature(df).collect()}
    assert got["amount"]["psi"] == 0.0 and got["amount"]["level"] == "green"
    assert got["hour_of_day"]["psi"] == 0.0 and got["amount"]["reference_rows"] == 25
    assert drift.distribution(df).count() == 0


def test_nulls_count_in_the_divisor_only(spark):
    ref, cur = [float(i) for i in range(20)], [1.0, 5.0, None, 15.0]
    rows = [(False, v) for v in ref] + [(True, v) for v in cur]
    df = spark.createDataFrame(rows, "is_recent boolean, amount double")
    edges = psi.bin_edges(df.filter("not is_recent"), ["amount"])
    table = psi.two_sided(df, edges).collect()
    assert sum(r["recent"] for r in table) == pytest.approx(0.75) and table[0]["recent_rows"] == 4


def test_strong_drift_is_flagged_in_new_data_mode(spark):
    base = resample.fixture_rows(spark, 1000).withColumnRenamed("class", "is_fraud").cache()
    new = resample.synthetic_rows(base, spark.range(300).withColumnRenamed("id", "draw_id"), "strong", 1)
    both = base.select("time", "amount").unionByName(new.select("time", "amount")).withColumnRenamed("time", "time_seconds")
    last = base.agg({"time": "max"}).first()[0]
    row = drift.summary(both, new_data_after=last).first()
    assert row["mode"] == "new_data" and row["recent_rows"] == 300 and row["alert"]
    levels = {r["feature"]: r["level"] for r in drift.drift_by_feature(both, new_data_after=last).collect()}
    assert levels["amount"] == "red"
    thin = drift.summary(both.limit(1000), new_data_after=last * 100).first()
    assert thin["mode"] == "new_data" and thin["recent_rows"] == 0
    assert drift.summary(both.limit(1000)).first()["mode"] == "halves"


def test_grouped_index_equals_single_groups(spark, rows):
    pdf = rows.assign(load_id=np.where(np.arange(len(rows)) % 4 == 0, "a", "b"))
    got = {r["load_id"]: r["psi_amount"] for r in drift.drift_by_group(spark.createDataFrame(pdf), ["load_id"]).collect()}
    ref = pdf[pdf.time_seconds < pdf.time_seconds.median()].amount
    for load in "ab":
        assert got[load] == pytest.approx(brute_force(ref, pdf[pdf.load_id == load].amount), abs=1e-9)


def test_two_checks_of_one_version_leave_one_record(spark):
    checks = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "ts long, fingerprint string")
    kept = drift.history(checks, "fingerprint", "ts").orderBy("ts").collect()
    assert [r["ts"] for r in kept] == [1, 3, 4]


def test_report_has_a_line_per_feature(spark, rows):
    lines = [r["line"] for r in drift.report_lines(drift.drift_by_feature(spark.createDataFrame(rows))).collect()]
    assert lines[0] == "# Drift report" and sum(line.startswith("| amount |") for line in lines) == 1
