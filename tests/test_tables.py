"""Files, search, change batches, snapshots, runs, registry, metrics and resampling on small fixtures."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from txquality import schema as S
from txquality.plans import metrics, registry, resample, runs, search, versions
from txquality.sources import files

HEADER = ",".join(f'"{c}"' for c in ["Time", *[f"V{i}" for i in range(1, 29)], "Amount", "Class"])


def line(i):
    return ",".join([str(i * 100.0), *["0.5"] * 28, str(float(i)), f'"{1 if i % 10 == 0 and i else 0}"'])


@pytest.fixture(scope="module")
def csv_path(tmp_path_factory):
    """Forty rows over three files with LF and CRLF ends."""
    folder = tmp_path_factory.mktemp("raw")
    for part, (lo, hi, end) in enumerate([(0, 17, "\n"), (17, 20, "\r\n"), (20, 40, "\n")]):
        text = end.join([HEADER, *[line(i) for i in range(lo, hi)]]) + end
        (folder / f"part-{part}.csv").write_text(text, newline="")
    return str(folder)


@pytest.fixture(scope="module")
def tx(spark, csv_path):
    return files.read_raw_csv(spark, csv_path).withColumnRenamed("class", "is_fraud").cache()


def test_csv_positions_follow_the_files(tx):
    rows = tx.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(40)) and [r["amount"] for r in rows] == [float(i) for i in range(40)]
    assert sum(r["is_fraud"] for r in rows) == 3


def test_text_that_is_no_number_becomes_null(spark):
    df = spark.createDataFrame([("1.5", "x", "1")], "time string, amount string, class string")
    assert tuple(files.typed(df).first()) == (1.5, None, 1)


def test_lineage_is_repeatable_and_loads_append(spark, tx, tmp_path):
    stamped = files.with_lineage(tx.select("id", "amount"), "load-1")
    again = files.with_lineage(tx.select("id", "amount").repartition(3), "load-1")
    assert stamped.exceptAll(again).count() == 0
    path = str(tmp_path / "t")
    files.append_load(stamped, path)
    files.append_load(files.with_lineage(tx.select("id", "amount"), "load-2"), path)
    assert files.read_table(spark, path, ["load_id"]).distinct().count() == 2
    files.replace_table(stamped, path)
    assert spark.read.parquet(path).count() == 40


def test_checksum_ignores_order_and_sees_changes(spark, tx):
    a = files.checksum(tx, ["id", "amount"]).first()
    assert files.checksum(tx.orderBy(F.desc("id")), ["id", "amount"]).first() == a
    assert files.checksum(tx.withColumn("amount", F.when(F.col("id") == 3, 9.0).otherwise(F.col("amount"))), ["id", "amount"]).first() != a
    assert files.checksum(tx.unionByName(tx.limit(1)).unionByName(tx.limit(1)), ["id", "amount"]).first() != a


def test_file_fingerprint_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "f")
    spark.range(5).coalesce(1).write.parquet(path)
    first = files.file_fingerprint(spark.read.parquet(path)).first()
    assert files.file_fingerprint(spark.read.parquet(path)).first() == first and first["file_count"] == 1
    spark.range(5).coalesce(1).write.mode("append").parquet(path)
    assert files.file_fingerprint(spark.read.parquet(path)).first()["total_size"] > first["total_size"]


def test_json_lines_skip_blanks(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text(json.dumps({"run_id": "a", "rows_added": 3}) + "\n\n" + json.dumps({"run_id": "b"}) + "\n")
    assert [r["run_id"] for r in files.read_jsonl(spark, str(path), S.RUN_SCHEMA).collect()] == ["a", "b"]


def test_pages_and_filters(tx):
    rows = search.page(tx, 2, 15, "amount", "desc").collect()
    assert rows[0]["amount"] == 24.0 and len(rows) == 15
    assert search.total(tx).first()["total"] == 40
    assert search.page(tx, limits={"is_fraud": search.Between(1, 1)}).count() == 3
    assert search.page(tx, limits={"amount": search.Between(10, 12)}).count() == 3
    assert search.page(tx, limits={"time": search.Between(500, 800)}).count() == 4
    assert search.page(tx, page_size=100_000).count() == 40
    assert search.page(tx, limits={"amount": search.Between(low=38)}).count() == 2 and search.page(tx, limits={"amount": search.Between()}).count() == 40
    with pytest.raises(ValueError, match="start at 1"):
        search.page(tx, 0)
    assert search.lookup(tx, 99).count() == 0
    with pytest.raises(ValueError, match="unknown sort column"):
        search.page(tx, sort="id; drop table tx")


def test_keyset_page_equals_offset_page(tx):
    last = search.page(tx, 2, 7, "is_fraud", "desc").collect()[-1]
    by_key = search.page_after(tx, last["is_fraud"], last["id"], 7, "is_fraud", "desc").collect()
    assert by_key == search.page(tx, 3, 7, "is_fraud", "desc").collect()


def test_export(spark, tx, tmp_path):
    search.export_csv(tx, [7, 3, 99], str(tmp_path / "e"))
    text = spark.read.option("header", True).csv(str(tmp_path / "e"))
    assert text.columns[0] == "transaction_id" and [r[0] for r in text.collect()] == ["3", "7"]
    assert search.selection(tx, []).count() == 0
    assert search.selection(tx, tx.sparkSession.range(100_000)).count() == 40


FIELDS = ["time", *S.V_COLUMNS, "amount", "is_fraud"]


def batch(spark, updates=(), deletes=(), creates=()):
    fields = {c: "long" if c == "is_fraud" else "double" for c in FIELDS}
    schema = "id long, pos long, " + ", ".join(f"{c} {t}" for c, t in fields.items())
    rows = [(i, n, *[change.get(c) for c in FIELDS]) for n, (i, change) in enumerate(updates)]
    ups = spark.createDataFrame(rows, schema)
    dels = spark.createDataFrame([(i,) for i in deletes], "id long")
    new = [(n, *[{**{c: 0.0 for c in FIELDS}, "is_fraud": 0, **c_}[c] for c in FIELDS]) for n, c_ in enumerate(creates)]
    return ups, dels, spark.createDataFrame(new, schema.replace("id long, ", ""))


def test_corrections_rollback_and_locks(spark, tx, tmp_path):
    store = versions.Snapshots(spark, str(tmp_path / "v"))
    store.publish(tx, "ingest")
    changes = batch(
        spark,
        [(2, {"amount": 1.0}), (2, {"amount": 999.5, "is_fraud": 1}), (5, {"amount": 3.0})],
        [5],
        [{"amount": 77.0}],
    )
    got = store.correct(0, *changes, FIELDS)
    assert (got["rows_created"], got["rows_updated"], got["rows_deleted"], got["version"]) == (1, 2, 1, 2)
    assert got["message"] == "1 row created, 2 rows updated, 1 row deleted"
    now = {r["id"]: r for r in store.read().collect()}
    assert sorted(now) == list(range(40)) and now[2]["amount"] == 999.5 and now[2]["is_fraud"] == 1
    assert now[2]["time"] == 200.0 and now[5]["amount"] == 6.0 and now[39]["amount"] == 77.0
    with pytest.raises(versions.Refused, match="another batch"):
        store.correct(0, *changes, FIELDS)
    with pytest.raises(versions.Refused, match="unknown ids"):
        store.correct(1, *batch(spark, [(40, {"amount": 1.0})]), FIELDS)
    assert store.current()["version"] == 2
    pending = tx.limit(2)
    assert store.roll_back(1, pending=pending, pending_rows=2) == 4
    assert [r["kind"] for r in store.manifest().orderBy("version").collect()] == ["ingest", "dashboard_edit", "pre_rollback", "rollback"]
    assert store.read().exceptAll(tx).count() == 0 and store.read(3).count() == 42
    assert store.current()["epoch"] == 2
    with pytest.raises(ValueError):
        store.read(9)


def test_append_keeps_the_epoch(spark, tx, tmp_path):
    store = versions.Snapshots(spark, str(tmp_path / "v"))
    store.publish(tx.limit(3), "ingest")
    store.publish(tx.limit(5), "ingest")
    assert store.current()["epoch"] == 0


def test_failed_publish_leaves_the_versions_alone(spark, tx, tmp_path):
    store = versions.Snapshots(spark, str(tmp_path / "v"))
    store.publish(tx.limit(3), "ingest")
    broken = tx.withColumn("amount", F.raise_error(F.lit("boom")).cast("double"))
    with pytest.raises(Exception, match="boom"):
        store.publish(broken, "ingest")
    assert store.current()["version"] == 1 and store.read().count() == 3


def test_staged_count(spark):
    ups, dels, new = batch(spark, [(1, {"amount": 1.0}), (1, {"amount": 2.0}), (2, {})], [2, 3], [{}, {}])
    assert versions.staged_count(ups, dels, new).first()[0] == 5


def test_version_history(spark):
    sha = ["a" * 40, "b" * 40]
    commits = spark.createDataFrame(
        [(sha[0], "2026-01-02", "bot", "x"), (sha[1], "2026-01-01", "bot", "data: +500 transactions (simulate)")],
        "commit_sha string, timestamp string, author string, subject string",
    )
    recorded = spark.createDataFrame(
        [(sha[0], 1, "u", 1, 9, "old", "ingest"), (sha[0], 2, "u", 3, 40, "edit", "dashboard_edit")],
        "commit_sha string, pos int, user string, rows_changed long, rows_total long, summary string, kind string",
    )
    listed = {r["commit_sha"]: r for r in versions.version_list(commits, recorded, "pos").collect()}
    assert (listed[sha[0]]["rows_changed"], listed[sha[0]]["summary"]) == (3, "edit")
    assert (listed[sha[1]]["rows_changed"], listed[sha[1]]["kind"]) == (500, None)
    assert versions.known_version(commits, "aaaaaaa").count() == 1
    assert versions.known_version(commits, "aaa").count() == 0 and versions.known_version(commits, "AAAAAAA").count() == 0


def log(spark, *records):
    rows = [(n, *r) for n, r in enumerate(records)]
    return spark.createDataFrame(rows, "pos long, run_id string, timestamp string, trigger string, status string, job_kind string")


def test_run_log(spark):
    df = log(
        spark,
        ("r1", "t1", "simulate", "completed", "continuous"),
        ("r2", "t2", "ingest", "failed", None),
        ("r3", "t3", "dashboard_edit", "versioned", None),
        ("r1", "t1", "simulate", "failed", "continuous"),
        (None, "t4", "ingest", "running", "pipeline"),
    )
    assert [r["run_id"] for r in runs.runs_by_group(df, "failed").collect()] == ["r1", "r2"]
    assert [r["run_id"] for r in runs.runs_by_group(df, "completed").collect()] == ["r3"]
    assert [r["run_id"] for r in runs.latest_runs(df, 2).collect()] == ["r3", "legacy-4"]
    assert runs.last_finished_run(df).first()["run_id"] == "r1"
    assert {r["run_id"]: r["job_kind"] for r in runs.rerunnable(df).collect()} == {
        "r1": "continuous",
        "r2": "continuous",
        "legacy-4": "pipeline",
    }
    assert runs.last_record(df).first()["pos"] == 4


def steps(spark, *events):
    rows = [("abc", n, f"2024-01-01 00:00:{n:02d}", f"2026 - job - abc - 1 - {op} - {event} - message") for n, (op, event) in enumerate(events)]
    return spark.createDataFrame([*rows, ("abc", 99, "t99", "RuntimeError: boom")], "run_id string, pos long, ts string, line string")


def test_stages_of_runs(spark):
    start, ok, bad = "STEP_START", "STEP_SUCCESS", "STEP_FAILURE"
    all_ok = steps(spark, *[(op, e) for op in S.PIPELINE_STAGES for e in (start, ok)])
    rows = runs.run_stages(all_ok, S.PIPELINE_STAGES).orderBy("stage_no").collect()
    assert [r["status"] for r in rows] == ["completed"] * 4
    assert [r["stage"] for r in rows] == ["Ingestion", "Validation", "Transformation", "Tests"]
    assert (rows[0]["started_at"], rows[0]["ended_at"]) == ("2024-01-01 00:00:00", "2024-01-01 00:00:01")
    failed = runs.run_stages(steps(spark, ("ingest", start), ("ingest", ok), ("validate", start), ("validate", bad)), S.PIPELINE_STAGES)
    assert [r["status"] for r in failed.orderBy("stage_no").collect()] == ["completed", "failed", "pending", "pending"]
    assert runs.run_outcome(failed).first()["status"] == "failed"
    silent = runs.run_stages(steps(spark), S.PIPELINE_STAGES)
    outcome = spark.createDataFrame([("abc", True)], "run_id string, succeeded boolean")
    assert [(r["stage"], r["status"]) for r in runs.with_fallback_stage(silent, outcome).collect()] == [("Pipeline", "completed")]


def test_registry_gate(spark):
    def decide(*values, promote=True):
        df = spark.createDataFrame(
            [("m", i + 1, f"r{i}", v, None, None, None, None) for i, v in enumerate(values)],
            "model string, version int, run_id string, pr_auc double, roc_auc double, f1 double, precision double, recall double",
        )
        return registry.stages(registry.gate_replay(df, promote=promote))

    def stage(*values, **kw):
        return [r["stage"] for r in decide(*values, **kw).orderBy("version").collect()]

    assert stage(0.5) == ["Production"] and stage(0.7, 0.4) == ["Production", "Staging"]
    assert stage(0.5, 0.9) == ["Archived", "Production"] and stage(0.5, 0.5) == ["Production", "Staging"]
    assert stage(0.5, promote=False) == ["Staging"]
    row = registry.compare(decide(0.84, 0.8)).first()
    assert (row["candidate_version"], row["production_version"]) == (2, 1)
    assert row["delta_pr_auc"] == pytest.approx(-0.04) and row["delta_f1"] is None
    assert registry.compare(decide()).count() == 0
    assert registry.best_run(decide(0.1, 0.9, 0.9)).first()["run_id"] == "r1"


def test_alerts_hold(spark):
    psi = [0.05] * 4 + [0.40] * 4
    df = spark.createDataFrame(
        [("s", i * 60, p, 0.25, u) for i, (p, u) in enumerate(zip(psi, [1, 1, 0, 0, 0, 1, 1, 1]))],
        "series string, second long, max_psi double, psi_threshold double, scoring_up int",
    )
    states = {(r["alert"], r["second"] // 60): r["state"] for r in metrics.all_alerts(df, ["series"]).collect()}
    assert states[("drift_high", 3)] == "inactive" and states[("drift_high", 4)] == "pending"
    assert states[("drift_high", 7)] == "firing"
    assert states[("scoring_down", 1)] == "inactive" and states[("scoring_down", 4)] == "firing"
    assert states[("scoring_down", 5)] == "inactive"


def test_counter_restart_and_quantile(spark):
    df = spark.createDataFrame([("h", 0, 5), ("h", 10, 8), ("h", 20, 2)], "handler string, second long, total long")
    rows = metrics.counter_increase(df, ["handler"], "second", "total").orderBy("second").collect()
    assert [r["increase"] for r in rows] == [None, 3, 2] and rows[1]["rate"] == pytest.approx(0.3)
    lat = spark.createDataFrame([("h", v) for v in [0.05] * 50 + [0.3] * 40 + [0.8] * 10] + [("g", 5.0)], "handler string, latency double")
    q = {r["handler"]: r["quantile"] for r in metrics.histogram_quantile(metrics.latency_histogram(lat), 0.95).collect()}
    assert q["h"] == pytest.approx(0.75) and q["g"] == 1.0


def test_shown_status_and_gauges(spark):
    status = spark.createDataFrame(
        [(40, 5, 100, 0, None, None)],
        "dataset_rows long, pending long, threshold long, running int, last_success int, last_epoch double",
    )
    rows = {r["metric"]: r["value"] for r in metrics.gauges(status, None).collect()}
    assert rows["fraud_drift_available"] == 0 and rows["fraud_pending_share"] == 5
    assert "fraud_pipeline_last_run_success" not in rows
    lines = [r["line"] for r in metrics.exposition_lines(metrics.gauges(status, None)).collect()]
    assert "fraud_dataset_rows 40" in lines
    shown = spark.createDataFrame([(None,), (0,), (1,)], "v int").select(runs.shown_status(F.col("v"))).collect()
    assert [r[0] for r in shown] == ["AUCUN RUN", "ÉCHEC", "SUCCÈS"]


def test_fixture_and_bootstrap(spark):
    base = resample.fixture_rows(spark).withColumnRenamed("class", "is_fraud").cache()
    assert base.count() == 500 and base.agg(F.sum("is_fraud")).first()[0] == 25
    assert base.filter("amount < 0 or time < 0 or time >= 172792").count() == 0
    draws = spark.range(2000).withColumnRenamed("id", "draw_id")
    none = resample.synthetic_rows(base, draws, "none", 1)
    again = resample.synthetic_rows(base.repartition(3), draws.repartition(5), "none", 1)
    assert none.count() == 2000 and none.exceptAll(again).count() == 0
    joined = none.join(base.select(F.col("id").alias("source_id"), F.col("v1").alias("w1"), F.col("time").alias("t0")), "source_id")
    assert joined.filter("v1 <> w1").count() == 0
    assert joined.filter(F.col("time") % 86400 != F.col("t0") % 86400).count() == 0
    assert none.filter("time < 172800").count() == 0
    shifted = resample.synthetic_rows(base, draws, "strong", 1)
    noise = shifted.join(base.select(F.col("id").alias("source_id"), F.col("v1").alias("w1")), "source_id")
    std = noise.agg(F.stddev(F.col("v1") - F.col("w1"))).first()[0]
    assert math.isclose(std, 2.5, rel_tol=0.1)
    assert noise.agg(F.avg("is_fraud")).first()[0] == pytest.approx(0.4, abs=0.05)


def test_deep_pages_equal_pages(spark):
    rows = [(i, [None, float("nan"), 1.0, 1.0, -0.0, 5.5, float(i)][i % 7], i % 3 == 0) for i in range(0, 300, 2)]
    df = spark.createDataFrame(rows, "id long, amount double, odd boolean")
    for sort, order in (("amount", "asc"), ("amount", "desc"), ("id", "desc")):
        for page_no in (1, 4, 9, 14, 15, 16, 40):
            want = [r["id"] for r in search.page(df, page_no, 10, sort, order).collect()]
            assert [r["id"] for r in search.deep_page(df, page_no, 10, sort, order).collect()] == want
    assert search.deep_page(df.limit(0), 1).collect() == []


def test_diff_joins_only_ranges_that_differ(spark):
    rows = [(i, None if i % 5 == 0 else "a", "a" if i % 5 == 0 else None) for i in range(400)]
    before = spark.createDataFrame([*rows, (None, "n", "n")], "id long, f string, g string")
    # Row 10 swaps the places of value and NULL, row 399 goes, row 900 comes; NULL equals nothing.
    edited = [(i, g, f) if i == 10 else (i, f, g) for i, f, g in rows if i != 399]
    after = spark.createDataFrame([*edited, (900, "x", "x"), (None, "n", "n")], "id long, f string, g string")
    want = [(None, "added"), (None, "removed"), (10, "changed"), (399, "removed"), (900, "added")]
    for key in ("id", "name"):
        sides = [d.withColumn("name", F.col("id").cast("string")) for d in (before, after)]
        got = versions.diff(*sides, key, ["f", "g"], 20).collect()
        assert sorted((str(r[0]), r[1]) for r in got) == sorted((str(k), c) for k, c in want)
    marks = [versions.range_digests(d, "id", ["f", "g"], 20) for d in (before, after)]
    wrong = versions.differing_ranges(*marks).collect()
    assert sorted((r[0] is None, r[0]) for r in wrong if r[0] is not None) == [(False, 0), (False, 19), (False, 45)] and len(wrong) == 4
    assert versions.diff(before, before.limit(0), "id", ["f", "g"]).count() == 401


def test_draws_survive_gaps(spark):
    base = resample.fixture_rows(spark, 200).withColumnRenamed("class", "is_fraud").filter(F.col("id") % 3 != 0)
    draws = spark.range(500).withColumnRenamed("id", "draw_id")
    assert resample.synthetic_rows(base, draws, "none", 1).count() == 500
