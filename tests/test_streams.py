"""Sinks of the streams: two-sided scoring, alerts by sessions, drift per day with bounded state, late rows."""

from __future__ import annotations

import datetime

import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from txquality import schema as S
from txquality.operators import psi
from txquality.plans import drift, training
from txquality.streaming import jobs

START = datetime.datetime(2024, 1, 1)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def arrive(spark, folder, rows, schema, run):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    query = run(jobs.file_stream(spark, folder, spark.createDataFrame([], schema).schema))
    query.awaitTermination()
    return query


def test_alert_sessions_fire_only_after_their_hold(spark, tmp_path):
    """drift_moderate holds for 300 seconds: seven minutes fire, three do not, an inactive sample breaks the stretch, a late one joins it."""
    schema = "series string, ts timestamp, max_psi double, psi_threshold double"
    out, mark, folder = (str(tmp_path / n) for n in ("out", "mark", "in"))

    def run(stream):
        return jobs.alert_sessions(stream, ["series"], "90 seconds", out, mark, "30 minutes")

    def sample(minute, value, series="a"):
        return (series, at(minute), value, 0.25)

    arrive(spark, folder, [sample(m, 0.2) for m in range(8) if m != 5] + [sample(m, 0.2, "b") for m in (0, 1, 2, 3)], schema, run)
    late = [sample(5, 0.2), sample(8, 0.05), *[sample(m, 0.2) for m in (9, 10, 11)], sample(4, 0.05, "b")]
    arrive(spark, folder, late, schema, run)
    arrive(spark, folder, [sample(300, 0.2)], schema, run)
    got = {(r["series"], r["alert"], r["active_since"], r["last_active"], r["samples"], r["fired"]) for r in spark.read.parquet(out).collect()}
    assert got == {
        ("a", "drift_moderate", at(0), at(7), 8, True),
        ("a", "drift_moderate", at(9), at(11), 3, False),
        ("b", "drift_moderate", at(0), at(3), 4, False),
    }


def test_daily_drift_state_is_bounded(spark, tmp_path):
    schema = "ts timestamp, time_seconds double, amount double"
    out, mark, folder = (str(tmp_path / n) for n in ("out", "mark", "in"))
    reference = drift.drift_features(spark.createDataFrame([(float(i * 97 % 86400), float(i % 50)) for i in range(400)], "time_seconds double, amount double"))
    edges = psi.bin_edges(reference, S.MONITORED)
    bins = sum(len(e) + 1 for e in edges.values() if e)
    for day in range(6):
        rows = [(at(day * 1440 + i), float(i * 60), float(i % 50)) for i in range(0, 1440, 20)]
        query = arrive(spark, folder, rows, schema, lambda stream: jobs.daily_drift_counts(stream, edges, out, mark))
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= 3 * bins
    counts = jobs.newest_per_key(spark, out, ["day", "feature", "bin"])
    totals = {(r["day"], r["feature"], r["n"]) for r in counts.groupBy("day", "feature").agg(F.sum("n").alias("n")).collect()}
    assert totals == {(at(day * 1440), c, 72) for day in range(6) for c in S.MONITORED if edges[c]}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(float(i * 900), float(i), i % 2) for i in range(1, 80)]
    known = drift.drift_features(spark.createDataFrame(rows, "time_seconds double, amount double, is_fraud int"))
    return training.fit("logreg_baseline", known, S.MONITORED)[0]


def test_every_row_is_scored_or_refused_once(spark, tmp_path, model):
    schema = "id long, time_seconds double, amount double"
    out, mark, folder = (str(tmp_path / n) for n in ("out", "mark", "in"))
    for k in range(2):
        rows = [(10 * k + i, None if i == 3 else 50.0 * i, None if i in (3, 4) else float(i)) for i in range(10)]
        arrive(spark, folder, rows, schema, lambda s: jobs.score_or_refuse(drift.drift_features(s), model, 0.5, "v1", out, mark))
    got = {r["id"]: (r["is_scored"], r["reasons"], r["probability_fraud"] is not None) for r in jobs.scored_and_refused(spark, out).collect()}
    assert sorted(got) == list(range(20))
    assert all(got[i] == (True, None, True) for i in range(20) if i % 10 not in (3, 4))
    assert got[3][1] == S.MONITORED and got[14][1] == ["amount", "log_amount"] and not got[3][2]


def test_late_rows_are_kept_beside_the_windows(spark, tmp_path):
    schema = "ts timestamp, id long"
    out, mark, folder = (str(tmp_path / n) for n in ("out", "mark", "in"))
    for k, minutes in enumerate(([0, 30, 200], [10, 100, 150, 210], [400])):
        arrive(spark, folder, [(at(m), 10 * k + i) for i, m in enumerate(minutes)], schema, lambda s: jobs.late_and_on_time(s, out, mark))
    got = {r["id"]: r["is_late"] for r in spark.read.parquet(out).collect()}
    # the watermark of the second batch is minute 140: windows that end at 60 and 120 are closed
    assert got == {0: False, 1: False, 2: False, 10: True, 11: True, 12: False, 13: False, 20: False}


def test_state_is_written_by_a_task_for_each_of_its_partitions(spark, tmp_path):
    """No task goes through the state of several partitions one after the other; the files are few all the same."""

    def task(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().taskAttemptId()], pa.int64())})

    batch = spark.range(0, 64, 1, 16).mapInArrow(task, "task bigint")
    jobs._state_per_batch(str(tmp_path / "state"))(batch, 0)
    assert jobs.newest(spark, str(tmp_path / "state")).distinct().count() == 16
    assert len(list((tmp_path / "state").rglob("*.parquet"))) <= jobs.STATE_FILES
