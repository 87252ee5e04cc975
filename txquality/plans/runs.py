"""Run log: current state of runs, filters, stages from event lines, and triggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from txquality import schema as S
from txquality.operators import sequences

def latest_runs(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Current record of every run, with ``first_pos`` for first-seen order; the last ``limit`` runs when given.

    A record without run id, or with an empty one, is a run of its own, named after its position.
    """
    own = F.concat(F.lit("legacy-"), F.col("pos").cast("string"))
    named = log.withColumn("run_id", F.coalesce(F.nullif(F.col("run_id"), F.lit("")), own))
    latest = sequences.latest_per_key(named, ["run_id"], "pos", "first_pos")
    return latest if limit is None else sequences.tail(latest, "first_pos", limit)


def runs_by_group(log: DataFrame, group: str, limit: int = 50) -> DataFrame:
    """Last ``limit`` runs of a status group, however far back they lie."""
    return sequences.tail(latest_runs(log).filter(F.col("status").isin(S.STATUS_GROUPS[group])), "first_pos", limit)


def status_counts(log: DataFrame) -> DataFrame:
    """Runs per status group."""
    group = F.lit("other")
    for name, statuses in S.STATUS_GROUPS.items():
        group = F.when(F.col("status").isin(statuses), F.lit(name)).otherwise(group)
    return latest_runs(log).groupBy(group.alias("status_group")).agg(F.count(F.lit(1)).alias("run_count"))


def last_finished_run(log: DataFrame) -> DataFrame:
    """Newest finished run that has a job kind (none: no row)."""
    finished = latest_runs(log).filter(F.col("job_kind").isNotNull() & F.col("status").isin(S.FINISHED))
    return finished.orderBy(F.col("first_pos").desc()).limit(1)


def last_record(log: DataFrame) -> DataFrame:
    """Last line of the log."""
    others = [c for c in log.columns if c != "pos"]
    one = log.agg(F.max_by(F.struct(*others), F.col("pos")).alias("_last"), F.max("pos").alias("pos"))
    return one.filter(F.col("pos").isNotNull()).select("pos", "_last.*")


def rerunnable(log: DataFrame) -> DataFrame:
    """Runs that may be started again, with the job kind a new run would have."""
    return (
        latest_runs(log)
        .filter(~F.col("trigger").isin(S.NOT_RERUNNABLE))
        .withColumn("job_kind", F.coalesce("job_kind", F.lit("continuous")))
    )


def parsed_steps(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines that carry a step event, with ``op`` and ``event``."""
    return lines.filter(F.col(line).rlike(S.STEP_PATTERN)).withColumns(
        {
            "op": F.regexp_extract(line, S.STEP_PATTERN, 1),
            "event": F.regexp_extract(line, S.STEP_PATTERN, 2),
        }
    )


def run_stages(lines: DataFrame, stages: list[str] | None = None) -> DataFrame:
    """(run_id, stage_no, stage, status, started_at, ended_at): every expected stage of every run in the log.

    The lines are scanned once and aggregated per run; the expected stages are a short literal list.
    """
    stages = stages or list(S.STAGES)
    op = F.regexp_extract("line", S.STEP_PATTERN, 1)
    event = F.regexp_extract("line", S.STEP_PATTERN, 2)
    steps = lines.select("run_id", "pos", "ts", op.alias("op"), F.when(event != "", event).alias("event"))
    # Per stage the last event, start and end as positions with a code: one hash aggregate over whole numbers.
    codes = {"STEP_START": 1, "STEP_SUCCESS": 2, "STEP_FAILURE": 3}
    code = F.lit(0)
    for name, number in codes.items():
        code = F.when(F.col("event") == name, F.lit(number)).otherwise(code)
    second = F.unix_timestamp(F.try_to_timestamp("ts", F.lit("yyyy-MM-dd HH:mm:ss")))
    steps = steps.select("run_id", "pos", "op", code.alias("code"), second.alias("second"))
    known = F.col("code") > 0
    aggs = []
    for i, name in enumerate(stages):
        own = known & (F.col("op") == name)
        for label, value, here in (
            ("code", F.col("code"), own),
            ("start", F.col("second"), own & (F.col("code") == 1)),
            ("end", F.col("second"), own & (F.col("code") > 1)),
        ):
            aggs.append(F.max_by(F.when(here, value), F.when(here, F.col("pos"))).alias(f"_{label}_{i}"))
    states = steps.groupBy("run_id").agg(*aggs)
    rows = [
        F.struct(
            F.lit(i + 1).alias("stage_no"),
            F.lit(S.STAGES[name]).alias("stage"),
            F.col(f"_code_{i}").alias("code"),
            F.col(f"_start_{i}").alias("start"),
            F.col(f"_end_{i}").alias("end"),
        )
        for i, name in enumerate(stages)
    ]
    status = F.lit("pending")
    for shown, number in (("running", 1), ("completed", 2), ("failed", 3)):
        status = F.when(F.col("code") == number, F.lit(shown)).otherwise(status)

    def text(seconds: str) -> Column:
        return F.from_unixtime(F.col(seconds), "yyyy-MM-dd HH:mm:ss")

    return states.select("run_id", F.inline(F.array(*rows))).select(
        "run_id", "stage_no", "stage", status.alias("status"), text("start").alias("started_at"), text("end").alias("ended_at")
    )


def with_fallback_stage(stage_rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Replace the stages of a successful run without any known step event by one stage ``Pipeline``."""
    seen = stage_rows.groupBy("run_id").agg((F.count_if(F.col("status") != "pending") > 0).alias("seen"))
    silent = outcomes.filter("succeeded").join(seen.filter(~F.col("seen")).select("run_id"), "run_id", "left_semi")
    kept = stage_rows.join(silent.select("run_id"), "run_id", "left_anti")
    single = silent.select(
        "run_id",
        F.lit(1).alias("stage_no"),
        F.lit("Pipeline").alias("stage"),
        F.lit("completed").alias("status"),
        F.lit(None).cast("string").alias("started_at"),
        F.lit(None).cast("string").alias("ended_at"),
    )
    return kept.unionByName(single)


def run_outcome(stage_rows: DataFrame) -> DataFrame:
    """Status of a run from its stages: failed if one failed, completed if all completed, else running."""
    failed = F.count_if(F.col("status") == "failed") > 0
    done = F.count_if(F.col("status") != "completed") == 0
    return stage_rows.groupBy("run_id").agg(
        F.when(failed, F.lit("failed")).when(done, F.lit("completed")).otherwise(F.lit("running")).alias("status")
    )


def volume_trigger(batches: DataFrame, series: str, order: str, size: str, threshold: int) -> DataFrame:
    return sequences.counter_with_reset(batches, series, order, size, threshold)


def version_trigger(versions: DataFrame, processed: DataFrame, series: str, order: str, md5: str) -> DataFrame:
    """Fire for a version that differs from the one before it and was not processed; the first sight never fires."""
    w = Window.partitionBy(series).orderBy(order)
    seen = versions.withColumn("cursor", F.lag(md5).over(w))
    changed = seen.filter(F.col("cursor").isNotNull() & (F.col("cursor") != F.col(md5)))
    return changed.join(processed.select(md5).distinct(), md5, "left_anti")


def shown_status(value: Column) -> Column:
    """Text of the last-run panel; -1 stands for no run at all."""
    shown = F.coalesce(value, F.lit(-1))
    expr = F.lit(None).cast("string")
    for number, text in S.LAST_RUN_TEXTS.items():
        expr = F.when(shown == number, F.lit(text)).otherwise(expr)
    return expr
