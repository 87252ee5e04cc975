"""Run log, stages and triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from txquality import schema as S
from txquality.catalog.registry import query
from txquality.plans import runs
from txquality.sources import star_tables as st

_LOG = """log_ as (
  select event_id as pos, case when event_type = 'signup' and k < 20 then 'legacy-' || event_id
                                 else 'run-' || user_id || '-' || cast(cast(ts as date) as varchar) end as run_id,
         strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp,
         case when k < 20 then 'ingest' when k < 40 then 'simulate' when k < 60 then 'manual_retrain'
              when k < 80 then 'dashboard_edit' else 'rollback' end as trigger,
         case event_type when 'error' then 'failed' when 'purchase' then 'completed' when 'view' then 'running'
              when 'click' then 'pipeline_running' else 'versioned' end as status,
         case when k % 3 <> 0 then case when k < 50 then 'pipeline' else 'continuous' end end as job_kind,
         trunc(value)::bigint as rows_added
  from (select *, cast(props->>'$.k' as integer) as k from events)),
latest as (
  select *, min(pos) over (partition by run_id) as first_pos from log_
  qualify row_number() over (partition by run_id order by pos desc) = 1)"""
_OUT = "run_id, pos, first_pos, timestamp, trigger, status, job_kind, rows_added"
_FIELDS = ["run_id", "pos", "first_pos", "timestamp", "trigger", "status", "job_kind", "rows_added"]


@query("latest_runs", f"with {_LOG} select {_OUT} from latest")
def latest_runs(spark, sf_dir):
    return runs.latest_runs(st.run_log(spark, sf_dir)).select(*_FIELDS)


def _group_sql(group: str) -> str:
    statuses = ", ".join(f"'{s}'" for s in S.STATUS_GROUPS[group])
    return (
        f"with {_LOG} select {_OUT} from latest where status in ({statuses}) order by first_pos desc limit 50"
    )


@query("runs_failed", _group_sql("failed"))
def runs_failed(spark, sf_dir):
    return runs.runs_by_group(st.run_log(spark, sf_dir), "failed").select(*_FIELDS)


@query("runs_completed", _group_sql("completed"))
def runs_completed(spark, sf_dir):
    return runs.runs_by_group(st.run_log(spark, sf_dir), "completed").select(*_FIELDS)


@query("runs_running", _group_sql("running"))
def runs_running(spark, sf_dir):
    return runs.runs_by_group(st.run_log(spark, sf_dir), "running").select(*_FIELDS)


@query(
    "runs_status_counts",
    f"""with {_LOG} select case when status in ('completed', 'versioned') then 'completed'
      when status in ('running', 'pipeline_running') then 'running' when status = 'failed' then 'failed' else 'other' end as status_group,
      count(*) as run_count from latest group by 1""",
)
def runs_status_counts(spark, sf_dir):
    return runs.status_counts(st.run_log(spark, sf_dir))


@query(
    "last_finished_run",
    f"with {_LOG} select {_OUT} from latest where job_kind is not null and status in ('completed', 'failed') order by first_pos desc limit 1",
)
def last_finished_run(spark, sf_dir):
    return runs.last_finished_run(st.run_log(spark, sf_dir)).select(*_FIELDS)


@query(
    "last_log_record",
    f"with {_LOG} select pos, case when run_id like 'legacy%' then null else run_id end as run_id, timestamp, trigger, status, job_kind, rows_added "
    "from log_ order by pos desc limit 1",
)
def last_log_record(spark, sf_dir):
    return runs.last_record(st.run_log(spark, sf_dir))


@query(
    "rerunnable_runs",
    f"with {_LOG} select run_id, trigger, status, coalesce(job_kind, 'continuous') as job_kind from latest where trigger not in ('dashboard_edit', 'rollback')",
)
def rerunnable_runs(spark, sf_dir):
    return runs.rerunnable(st.run_log(spark, sf_dir)).select("run_id", "trigger", "status", "job_kind")


_NAMES = ", ".join(f"'{n}'" for n in [*S.STAGES, "other_step"])
_EXPECTED = ", ".join(f"({i + 1}, '{op}', '{label}')" for i, (op, label) in enumerate(S.STAGES.items()))
_STAGES = f"""lines as (
  select 'run-' || user_id as run_id, event_id as pos, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts,
         strftime(ts, '%Y-%m-%d %H:%M:%S') || ' - job - ' || user_id || ' - 1 - '
         || [{_NAMES}][cast(props->>'$.k' as integer) % 8 + 1] || ' - '
         || case when event_type = 'error' then 'STEP_FAILURE' when event_type in ('purchase', 'signup') then 'STEP_SUCCESS'
                 when event_type = 'view' then 'STEP_START' else 'STEP_OUTPUT' end || ' - message' as line
  from events),
parsed as (
  select *, regexp_extract(line, ' - (\\w+) - (STEP_START|STEP_SUCCESS|STEP_FAILURE) - ', 1) as op,
         regexp_extract(line, ' - (\\w+) - (STEP_START|STEP_SUCCESS|STEP_FAILURE) - ', 2) as event from lines),
states as (
  select run_id, op, arg_max(event, pos) as last_event, arg_max(ts, pos) filter (where event = 'STEP_START') as started_at,
         arg_max(ts, pos) filter (where event <> 'STEP_START') as ended_at
  from parsed where op <> '' group by 1, 2),
expected(stage_no, op, stage) as (values {_EXPECTED}),
stages as (
  select r.run_id, stage_no, stage, case last_event when 'STEP_START' then 'running' when 'STEP_SUCCESS' then 'completed'
         when 'STEP_FAILURE' then 'failed' else 'pending' end as status, started_at, ended_at
  from (select distinct run_id from lines) r cross join expected e left join states s on s.run_id = r.run_id and s.op = e.op)"""


@query("run_stages", f"with {_STAGES} select * from stages")
def run_stages(spark, sf_dir):
    return runs.run_stages(st.step_lines(spark, sf_dir))


@query(
    "run_outcomes",
    f"""with {_STAGES} select run_id, case when count(*) filter (where status = 'failed') > 0 then 'failed'
      when count(*) filter (where status <> 'completed') = 0 then 'completed' else 'running' end as status from stages group by 1""",
)
def run_outcomes(spark, sf_dir):
    return runs.run_outcome(runs.run_stages(st.step_lines(spark, sf_dir)))


VOLUME_THRESHOLD = 1000


@query(
    "volume_trigger",
    f"""with recursive batches as (
      select event_type as dataset, date_trunc('hour', ts) as batch, count(*) as row_count from events group by 1, 2),
    numbered as (select *, row_number() over (partition by dataset order by batch) as rn from batches),
    folded as (
      select dataset, batch, rn, row_count, 0::bigint as pending_before,
             case when row_count >= {VOLUME_THRESHOLD} then 0 else row_count end as pending_after, row_count >= {VOLUME_THRESHOLD} as triggered
      from numbered where rn = 1
      union all
      select n.dataset, n.batch, n.rn, n.row_count, f.pending_after,
             case when f.pending_after + n.row_count >= {VOLUME_THRESHOLD} then 0 else f.pending_after + n.row_count end,
             f.pending_after + n.row_count >= {VOLUME_THRESHOLD}
      from folded f join numbered n on n.dataset = f.dataset and n.rn = f.rn + 1)
    select dataset, strftime(batch, '%Y-%m-%d %H') as batch, row_count, pending_before, pending_after, triggered from folded""",
)
def volume_trigger(spark, sf_dir):
    """Hourly batches per dataset."""
    events = st.table(spark, sf_dir, "events")
    batches = events.groupBy(
        F.col("event_type").alias("dataset"), F.date_trunc("hour", F.col("ts")).alias("batch")
    ).agg(F.count(F.lit(1)).alias("row_count"))
    judged = runs.volume_trigger(batches, "dataset", "batch", "row_count", VOLUME_THRESHOLD)
    return judged.withColumn("batch", F.date_format("batch", "yyyy-MM-dd HH"))


@query(
    "version_trigger",
    """with versions as (
      select event_type as dataset, date_trunc('hour', ts) as hour_, md5(event_type || ':' || cast(max(cast(props->>'$.k' as integer)) // 10 as varchar)) as md5
      from events group by 1, 2),
    seen as (select *, lag(md5) over (partition by dataset order by hour_) as cursor_ from versions),
    processed as (select distinct md5('view:' || cast(cast(props->>'$.k' as integer) // 10 as varchar)) as md5 from events
                  where event_type = 'purchase' and cast(props->>'$.k' as integer) % 3 <> 0)
    select dataset, strftime(hour_, '%Y-%m-%d %H') as hour, md5, cursor_ as "cursor" from seen
    where cursor_ is not null and cursor_ <> md5 and md5 not in (select md5 from processed)""",
)
def version_trigger(spark, sf_dir):
    events = st.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    tens = F.floor(F.max(k) / F.lit(10)).cast("string")
    versions = events.groupBy(
        F.col("event_type").alias("dataset"), F.date_format(F.date_trunc("hour", F.col("ts")), "yyyy-MM-dd HH").alias("hour")
    ).agg(F.md5(F.concat_ws(":", F.col("event_type"), tens).cast("binary")).alias("md5"))
    # Versions that a completed run with a job kind has seen.
    processed = events.filter((F.col("event_type") == "purchase") & (k % 3 != 0)).select(
        F.md5(F.concat_ws(":", F.lit("view"), F.floor(k / F.lit(10)).cast("string")).cast("binary")).alias("md5")
    )
    return runs.version_trigger(versions, processed, "dataset", "hour", "md5")


@query(
    "last_run_text",
    """with per_user as (
      select user_id, arg_max(event_type, event_id) filter (where event_type in ('error', 'purchase') and cast(props->>'$.k' as integer) % 3 <> 0) as last_
      from events group by 1)
    select user_id, case last_ when 'purchase' then 'SUCCÈS' when 'error' then 'ÉCHEC' else 'AUCUN RUN' end as shown from per_user""",
)
def last_run_text(spark, sf_dir):
    events = st.table(spark, sf_dir, "events")
    finished = F.col("event_type").isin("error", "purchase") & (F.get_json_object("props", "$.k").cast("int") % 3 != 0)
    outcome = F.when(finished, F.when(F.col("event_type") == "purchase", 1).otherwise(0))
    last = events.groupBy("user_id").agg(F.max_by(outcome, F.when(finished, F.col("event_id"))).alias("success"))
    return last.select("user_id", runs.shown_status(F.col("success")).alias("shown"))
